"""Chat formatting by incremental rendering of a black-box template.

A template is a function from a list of turns to one string.  Nothing is known
of its marks: successive prefixes of a conversation are rendered, and what the
output of k turns adds to that of k - 1 is the span of turn k.  Where the text
lies within its span is found by rendering the turn once more with a probe as
its text.  A template whose output for k turns doesn't begin with that for
k - 1 rewrites history; such conversations are flagged, and have no spans.

Conversations stream through their task turn by turn.  Every prefix is rendered
whole: a conversation's turns are held, and time grows with the square of their
number.  ``context`` is an explicit exception, allowed only for templates
declared to render each turn by itself (``independent_turns``): the prefix is
then cut to its first ``anchor`` and its latest turns, ``context`` in all,
which adds the same span as long as the declaration is true.  Given up is the
detection of a declaration that is false only for longer prefixes.  Digests and
counts are carried on, not the turns, so memory and time stay bounded.

Defined cases: null text or role is an empty string; turns of one conversation
are ordered by turn (null first), role and text, so repeated rows are turns of
their own and ties have one order; a null conversation id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import bounded_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

HEAD, TAIL = "### ", "</turn>"
#: Names of the known roles in the output; others are written as they are, marked.
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {name: role for role, name in ROLE_NAMES.items()}
#: Escapes of control strings; none contains one, nor makes one with its neighbours.
_ESCAPES = {"\\": "\\\\", HEAD: "\\h", TAIL: "\\t"}
_CONTROL = re.compile("|".join(map(re.escape, _ESCAPES)))
_UNESCAPES = {v[1]: k for k, v in _ESCAPES.items()} | {"c": ":"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A text that occurs in no template: private-use characters.
PROBE = "\uf8ff\ue000\uf8ff"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m.group(1)], text)


def independent_turns(template: Template) -> Template:
    """Declares that a template's output is that of its turns one by one, in order."""
    template.independent_turns = True
    return template


@independent_turns
def marked_template(turns: list[Turn]) -> str:
    """The production template: ``### Role: text</turn>`` and a line end for each turn."""
    out = []
    for role, text in turns:
        name = ROLE_NAMES.get(role) or "=" + escape(role).replace(":", "\\c")
        out.append(f"{HEAD}{name}: {escape(text)}{TAIL}\n")
    return "".join(out)


def read_turn(span: str) -> Turn:
    """Role and text of one turn of ``marked_template``."""
    if not (span.startswith(HEAD) and span.endswith(TAIL + "\n")):
        raise ValueError("not a turn")
    name, _, text = span[len(HEAD) : -len(TAIL) - 1].partition(": ")
    role = unescape(name[1:]) if name.startswith("=") else _ROLES[name]
    return role, unescape(text)


class IncrementalRenderer:
    """Feeds turns one by one and yields each turn's span and the place of its text.

    Prefixes are whole unless ``context`` is given, which a template must be
    declared for.
    """

    def __init__(self, template: Template, context: int | None = None, anchor: int = 2):
        if context is not None:
            if not getattr(template, "independent_turns", False):
                raise ValueError("only templates declared to render each turn by itself take a context")
            if not 0 <= anchor < context:
                raise ValueError("anchor must be less than context")
        self.template, self.anchor, self.context = template, anchor, context
        self.turns: list[Turn] = []
        self.before = template([])
        self.rewrites = False

    def add(self, turn: Turn) -> tuple[str, int, int] | None:
        """(span, start, end) of the turn, its text at [start, end); None once history is rewritten."""
        if self.rewrites:
            return None
        if self.context is not None and len(self.turns) >= self.context:
            del self.turns[self.anchor]
            self.before = self.template(self.turns)
        after = self.template([*self.turns, turn])
        probed = self.template([*self.turns, (turn[0], PROBE)])
        if not (after.startswith(self.before) and probed.startswith(self.before)):
            self.rewrites = True
            return None
        span, probe = after[len(self.before) :], probed[len(self.before) :]
        self.turns.append(turn)
        self.before = after
        start = probe.find(PROBE)
        if start < 0:  # the template drops this text
            return span, len(span), len(span)
        return span, start, len(span) - (len(probe) - start - len(PROBE))


def format_conversations(conversations: DataFrame, template: Template = marked_template, context: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted turns: ``(conv_id, place, role, formatted, text_start, text_end, in_loss, rewrites)``.

    A conversation is the concatenation of ``formatted`` by place; offsets are
    code points within the turn; ``in_loss`` marks texts under the loss mask.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def turns(key, rows: Iterator[Turn]):
        renderer = IncrementalRenderer(template, context)
        for place, turn in enumerate(rows):
            got = renderer.add(turn)
            span, start, end = got or ("", 0, 0)
            yield key, place, turn[0], span, start, end, turn[0] in learn and got is not None, renderer.rewrites

    schema = pa.schema([("place", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_()), ("rewrites", pa.bool_())])
    return _by_conversation(conversations, turns, f"conv_id {kind}, place long, role string, formatted string, text_start long, text_end long, in_loss boolean, rewrites boolean", schema)


#: Turns that a prefix of the production template is cut to.
CONTEXT = 64


def conversation_digests(conversations: DataFrame, context: int | None = CONTEXT, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation, all of it read back from the formatted output of ``marked_template``."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def digest(key, rows: Iterator[Turn]):
        renderer = IncrementalRenderer(marked_template, context)
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = loss_chars = 0
        for turn in rows:
            n += 1
            got = renderer.add(turn)
            if got is None:
                continue
            span, start, end = got
            role, text = read_turn(span)
            chars += len(span)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role in learn:
                masked = unescape(span[start:end])
                loss_chars += len(masked)
                loss.update(masked.encode("utf-8", "surrogatepass"))
        yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, renderer.rewrites

    schema = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
    return _by_conversation(conversations, digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean", schema)


def _by_conversation(conversations: DataFrame, each: Callable, ddl: str, rest: pa.Schema) -> DataFrame:
    """Streams ``each(key, turns)`` over the sorted turns of every conversation.

    A conversation needs its turns in order in one place; they pass through a
    sorted partition as a stream, never as a group held in memory.
    """
    bounded_batches(conversations.sparkSession)
    blank = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def stream():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        from itertools import groupby

        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, f.type) for c, f in zip(columns[1:], rest, strict=True))], names=["conv_id", *rest.names])

        for key, group in groupby(stream(), lambda r: r[0]):
            for row in each(key, ((role, text) for _, role, text in group)):
                out.append(row)
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(out) >= 1000 or size > 4_000_000:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, ddl)
