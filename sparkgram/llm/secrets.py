"""Secret scans with linking of multipart credentials.

Base findings are what their pattern alone makes likely: assignments to secret
names, access identifiers and long hex runs.  They are always reported.

Weak candidates (an account or client name, an opaque token, a service
address) mean little alone.  They are reported only where complementary parts
lie in one scope.  Scopes are paragraphs; the join of the parts' intervals with
the scopes is one sweep over both in order, so neither pairs nor a product of
the candidates is made, however many a text holds.  What a scope holds is one
credential: its identifiers, its secrets and its endpoints.  With ``window``
(off by default) parts in a scope belong to one credential only if no gap
between neighbours is wider than so many code points.

Defined cases: null text is an empty text without findings; very long texts
and tokens are scanned whole; equal rows get equal rows; only id and text are
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import bounded_batches

ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Order of kinds among findings of equal start.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

IDENTIFIER = re.compile(r"""(?ia)(?<![A-Za-z0-9])(?:access|account|client|application|app|tenant|user)[_-]?(?:key)?[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?a)(?<![A-Za-z0-9+.-])(?:[a-z][a-z0-9+.-]*+://[^\s"'<>]{4,}|[a-z0-9-]++(?:\.[a-z0-9-]++)++:\d{2,5}\b)""")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

#: Bits a character that an opaque token needs at least.
OPAQUE_BITS = 3.5
MASK = "[secret]"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Assignments, access identifiers and hex runs, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _opaque(token: str) -> bool:
    """Whether a token mixes digits and both cases with high entropy, as keys do."""
    if not (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= OPAQUE_BITS


class Credential(NamedTuple):
    """Complementary parts in one scope, each list by start."""

    scope: tuple[int, int]
    identifiers: list[Span]
    secrets: list[Span]
    endpoints: list[Span]

    def spans(self) -> list[Span]:
        return in_order([*self.identifiers, *self.secrets, *self.endpoints])


_PART = {"access": 0, "identifier": 0, "assign": 1, "hex": 1, "opaque": 1, "endpoint": 2}


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates outside the base findings; a token within an identifier is its value."""
    if not any(k == "access" for k, _, _ in base) and IDENTIFIER.search(text) is None:
        return []  # a secret or an address without an identifier links nothing
    taken = [(s, e) for _, s, e in base]
    outside = _outside(taken)
    identifiers = [x for m in IDENTIFIER.finditer(text) if outside(x := m.span())]
    beyond = _outside(taken + identifiers)
    out = [("identifier", *x) for x in identifiers]
    out += [("opaque", *m.span()) for m in OPAQUE.finditer(text) if beyond(m.span()) and _opaque(m.group())]
    return out + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text) if beyond(m.span())]


def credentials(text: str, base: list[Span], window: int | None = None) -> list[Credential]:
    """Credentials of a text: scopes with an identifier and a secret, and the
    endpoints that have both beside them."""
    parts = in_order(base + candidates(text, base))
    ends = [m.start() for m in PARAGRAPH.finditer(text)] + [len(text)]
    out, lo, i = [], 0, 0
    for hi in ends:
        group: list[Span] = []
        reach = lo
        while i < len(parts) and parts[i][1] < hi:
            if window is not None and group and parts[i][1] - reach > window:
                out += _credential((lo, hi), group)
                group = []
            group.append(parts[i])
            reach = max(reach, parts[i][2])
            i += 1
        out += _credential((lo, hi), group)
        lo = hi
    return out


def _credential(scope: tuple[int, int], group: list[Span]) -> list[Credential]:
    held: tuple[list[Span], list[Span], list[Span]] = ([], [], [])
    for part in group:
        held[_PART[part[0]]].append(part)
    identifiers, secrets, endpoints = held
    if not identifiers or not secrets:
        return []
    # an address that holds the only secret has none beside it
    first_end, last_start = min(e for _, _, e in secrets), secrets[-1][1]
    endpoints = [x for x in endpoints if first_end <= x[1] or last_start >= x[2]]
    return [Credential(scope, identifiers, secrets, endpoints)]


def _outside(taken: list[tuple[int, int]]):
    starts = sorted(taken)
    firsts = [s for s, _ in starts]
    furthest, far = [], 0
    for _, e in starts:
        far = max(far, e)
        furthest.append(far)

    def outside(span: tuple[int, int]) -> bool:
        i = bisect_left(firsts, span[1])
        return not (i and furthest[i - 1] > span[0])

    return outside


def find_secrets(text: str | None, window: int | None = None) -> tuple[list[Span], list[Span], list[Credential]]:
    """(base findings, all findings, credentials) of a text, each in order."""
    text = text or ""
    base = base_spans(text)
    linked = credentials(text, base, window)
    weak = [x for c in linked for x in c.spans() if x[0] in ("identifier", "opaque", "endpoint")]
    return base, in_order(base + weak), linked


def redact(text: str | None) -> str | None:
    """The text with every finding replaced by ``MASK``; overlapping ones count as one."""
    if not text:
        return text
    _, spans, _ = find_secrets(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _linked(found: list[Credential]) -> str:
    """``scope start-scope end=kind:start:end,...`` of each credential, by semicolons."""
    return ";".join(f"{c.scope[0]}-{c.scope[1]}={_joined(c.spans())}" for c in found)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<kind:string,start:long,end:long>>"
_PARTS = ("identifiers", "secrets", "endpoints")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None) -> DataFrame:
    """One row a document: counts, digest of the base findings, all findings, credentials.

    ``findings`` holds (kind, start, end) in code points and ``groups`` the
    parts of each credential with its scope; ``spans`` and ``credentials`` are
    the same as strings.  A single pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    parts_ddl = ",".join(f"{p}:{_SPANS_DDL}" for p in _PARTS)
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, credentials string, findings {_SPANS_DDL}, groups array<struct<scope_start:long,scope_end:long,{parts_ddl}>>"
    group_type = pa.list_(pa.struct([("scope_start", pa.int64()), ("scope_end", pa.int64()), *((p, _SPANS) for p in _PARTS)]))
    fields = lambda found: [{"kind": k, "start": s, "end": e} for k, s, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
            digest, spans, linked, findings, groups = [], [], [], [], []
            for value in batch.column(1):
                base, every, found = find_secrets(value.as_py(), window)
                n = Counter(k for k, _, _ in base)
                for k, held in counts.items():
                    held.append(n[k])
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                linked.append(_linked(found))
                findings.append(fields(every))
                groups.append([{"scope_start": c.scope[0], "scope_end": c.scope[1]} | {p: fields(getattr(c, p)) for p in _PARTS} for c in found])
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in counts.values()), *(pa.array(x, pa.string()) for x in (digest, spans, linked)), pa.array(findings, _SPANS), pa.array(groups, group_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "credentials", "findings", "groups"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the findings masked; all columns stay, the length follows the text."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(F.coalesce(text_col, F.lit(""))).cast(docs.schema[length_col].dataType))
    return out
