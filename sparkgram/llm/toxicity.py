"""Toxicity scores from a misspelling-tolerant lexicon and the context of its hits.

The lexicon is learned: words whose presence in the labelled training texts
speaks for label 1 beyond chance.  Texts are matched against it by Levenshtein
automata intersected with the lexicon's trie.  The product automaton is made
deterministic step by step: a state is a set of (trie node, edits so far), and
a transition is computed once and remembered, so an ordinary word is left after
the two or three letters that kill all its states.

Every hit is judged in a window of words: whether quotation marks enclose it,
whether reporting or second-person words stand near, and how many other hits
do.  Quoted and reported hits make features of their own, apart from abuse.  A
logistic model over these features gives the score.

Labels are read from training rows only, and nothing but the text is scored.
The training sample is bounded by ``MAX_TRAIN`` rows (picked by a hash of the
id among all labelled rows), and with it the words that lexicon and ordinary
words are taken from; neither has a cap of its own, and every text is scored
whole.

Defined cases: null text is an empty text; texts without hits get one score,
the model's for no hits; without labels of both kinds nothing is learned, and
the score is the smoothed share of label 1 for all, but less than one half, so
that nothing is rejected; equal texts have equal scores; labels of
ids without a document, and null labels, are ignored; of several labels of one
id the greatest counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import bounded_batches, cut

MAX_TRAIN = 12_000
#: Nats by which a word's split between the labels must beat the base rate.
LEAST_EVIDENCE = 8.0
#: Least log-odds of a term, and the most that one counts for.
LEAST_ODDS, MOST_ODDS = 1.5, 6.0
#: Words on each side of a hit that make its context.
CONTEXT = 8
FOLDS = 5

#: Letters, marks and digits: the same words in learning and in scoring.
WORD = r"[\p{L}\p{M}\p{N}]+"
_WIDE, _NARROW = regex.compile(WORD), re.compile(r"[^\W_]+")
# fixed values: words that report speech, and words that address a person
REPORTING = frozenset("said says quote quoted quotes called calls wrote writes term word words slur dit disait écrit mot citation sagte sagt schrieb wort zitat dijo dice escribió palabra cita".split())
ADDRESSING = frozenset("you your youre ya u tu te toi vous ton ta du dich dir ihr dein deine tú ti usted ustedes eres".split())
_MARKS = re.compile('["“”„«»]')


def finder(text: str):
    """The pattern of words; Latin-1 texts, which hold no marks, take the standard module, which is faster."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE
    return _NARROW


class Trie:
    """Children by letter, and the terms that end at a node."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, term in enumerate(terms):
            node = 0
            for letter in term:
                node = self.children[node].setdefault(letter, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = i


class FuzzyAutomaton:
    """Terms of a trie within ``edits`` insertions, deletions or substitutions.

    A state is the set of (node, least edits so far), closed under skipping
    letters of the term.  States are numbered as they come up, and each keeps
    its transitions; beyond ``limit`` transitions all but the start is forgotten.
    """

    DEAD = -1

    def __init__(self, terms: list[str], edits: int, limit: int = 200_000):
        self.trie, self.edits, self.limit = Trie(terms), edits, limit
        lengths = [len(t) for t in terms] or [0]
        self.shortest, self.longest = min(lengths) - edits, max(lengths) + edits
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.known = 0
        self._number(self._closed({0: 0}))

    def _number(self, least: dict[int, int]) -> int:
        if not least:
            return self.DEAD
        state = frozenset(least.items())
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.ids[state]

    def _closed(self, least: dict[int, int]) -> dict[int, int]:
        """Adds what skipping term letters reaches; keeps the least edits of a node."""
        stack = list(least.items())
        while stack:
            node, used = stack.pop()
            if used > least.get(node, self.edits) or used >= self.edits:
                continue
            for child in self.trie.children[node].values():
                if used + 1 < least.get(child, self.edits + 1):
                    least[child] = used + 1
                    stack.append((child, used + 1))
        return least

    def _move(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}
        for node, used in self.states[state]:
            children = self.trie.children[node]
            same = children.get(letter)
            if same is not None and used < least.get(same, self.edits + 1):
                least[same] = used
            if used < self.edits:
                for child in (node, *children.values()):  # a letter too many, or another letter
                    if used + 1 < least.get(child, self.edits + 1):
                        least[child] = used + 1
        self.moves[state][letter] = out = self._number(self._closed(least))
        self.known += 1
        return out

    def match(self, word: str) -> dict[int, int]:
        """Edits of every term within reach of ``word``."""
        if not self.shortest <= len(word) <= self.longest:
            return {}
        if self.known > self.limit:
            self._forget()
        state, moves = 0, self.moves
        for letter in word:
            after = moves[state].get(letter)
            state = self._move(state, letter) if after is None else after
            if state < 0:
                return {}
        ends = self.trie.ends
        return {ends[node]: used for node, used in self.states[state] if ends[node] >= 0}


def edits_for(term: str) -> int:
    """Misspellings that a term of this length tolerates."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """Weighted terms; ``find`` tells the weight and edits of a word's best term."""

    def __init__(self, weights: dict[str, float], ordinary: frozenset[str] = frozenset(), cache: int = 200_000):
        self.weights, self.ordinary, self.cache = weights, ordinary, cache
        by_edits: dict[int, list[str]] = {}
        for term in sorted(weights):
            by_edits.setdefault(edits_for(term), []).append(term)
        self.automata = [(terms, FuzzyAutomaton(terms, k)) for k, terms in by_edits.items() if k]
        self.known: dict[str, tuple[float, int] | None] = {}

    def find(self, word: str) -> tuple[float, int] | None:
        try:
            return self.known[word]
        except KeyError:
            pass
        exact = self.weights.get(word)
        if exact is not None:
            out = (exact, 0)
        elif word in self.ordinary:
            out = None
        else:
            near = [(used, -self.weights[terms[i]]) for terms, automaton in self.automata for i, used in automaton.match(word).items()]
            out = (-min(near)[1], min(near)[0]) if near else None
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[word] = out
        return out


FEATURES = ("exact", "strongest", "kinds", "misspelt", "quoted", "reported", "addressed", "densest", "share")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the hits of a text and their contexts amount to; all zero without hits."""
    if not text or not lexicon.weights:
        return [0.0] * len(FEATURES)
    text = text.lower()
    pattern = finder(text)
    words = pattern.findall(text)
    found = lexicon.find
    hits = [(i, got) for i, got in ((i, found(w)) for i, w in enumerate(words)) if got is not None]
    if not hits:
        return [0.0] * len(FEATURES)
    quoted_words = _quoted(text, pattern, {i for i, _ in hits})
    exact = misspelt = quoted = reported = addressed = 0.0
    strongest = 0.0
    kinds = set()
    places = np.array([i for i, _ in hits])
    for i, (weight, used) in hits:
        around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
        in_quotes = i in quoted_words
        told = any(w in REPORTING for w in around)
        if used:
            misspelt += weight
        elif in_quotes or told:
            pass  # told of rather than said; counted below
        else:
            exact += weight
            strongest = max(strongest, weight)
            kinds.add(words[i])
        quoted += weight * in_quotes
        reported += weight * told
        addressed += weight * any(w in ADDRESSING for w in around)
    densest = int((np.searchsorted(places, places + 2 * CONTEXT, side="right") - np.arange(len(places))).max())
    squeeze = math.log1p
    return [squeeze(exact), strongest, squeeze(len(kinds)), squeeze(misspelt), squeeze(quoted), squeeze(reported), squeeze(addressed), squeeze(densest - 1), 10.0 * len(kinds) / len(words)]


def _quoted(text: str, pattern: re.Pattern, places: set[int]) -> set[int]:
    """Which word places lie between a pair of quotation marks of one line, however far apart."""
    marks = [m.start() for m in _MARKS.finditer(text)]
    if not marks:
        return set()
    inside: list[tuple[int, int]] = []
    opened = None
    for at in marks:
        if opened is None or text.find("\n", opened, at) >= 0:  # what a line doesn't close isn't quoted
            opened = at
        else:
            inside.append((opened, at))
            opened = None
    out, k = set(), 0
    for i, m in enumerate(pattern.finditer(text)):
        while k < len(inside) and inside[k][1] < m.start():
            k += 1
        if i in places and k < len(inside) and inside[k][0] < m.start():
            out.add(i)
    return out


@dataclass
class ToxicityModel:
    """A lexicon and a logistic model over the features of its hits."""

    weights: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = 0.0
    _lexicon: Lexicon | None = None

    def score(self, text: str | None) -> float:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.weights, self.ordinary)
        z = self.bias + sum(c * x for c, x in zip(self.coefficients, features(text, self._lexicon), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return {"weights": self.weights, "ordinary": self.ordinary, "coefficients": self.coefficients, "bias": self.bias, "_lexicon": None}


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> DataFrame:
    """``(text, label)`` of at most about ``most`` labelled rows outside fold 0, texts distinct.

    The sample's ids are bounded by ``most`` and so broadcast to the scan.
    """
    usable = labels.where((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = cut(usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")), "labels")
    share = min(1.0, most / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 53)) < int(share * (1 << 53)))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("text", "label")
    return cut(rows.groupBy("text").agg(F.max("label").alias("label")), "training")


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, p, n)``: training texts of label 1 and of label 0 with the word."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))))
    return rows.select("label", words.alias("word")).groupBy("word").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))


def learn_lexicon(counts: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Log-odds of the words that tell label 1 from label 0 beyond chance; of the
    bounded sample's words, so they fit the driver."""
    total = F.col("p") + F.col("n")
    base = positives / (positives + negatives)
    part = lambda k, rate: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (total * rate))).otherwise(0.0)
    evidence = part("p", base) + part("n", 1 - base)
    odds = F.log((F.col("p") + 0.5) / (positives + 1)) - F.log((F.col("n") + 0.5) / (negatives + 1))
    best = counts.where(F.length("word") >= 3).select("word", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
    return {r.word: min(MOST_ODDS, r.odds) for r in best.collect()}


def learn_ordinary(counts: DataFrame, weights: dict[str, float], positives: int, negatives: int) -> frozenset[str]:
    """Words near a term that the labels tell for words of their own, not
    misspellings: those that label-0 texts have at least as often as label-1 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            near = [w not in weights and lexicon.find(w) is not None for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    fair = counts.where(F.col("n") * positives >= F.col("p") * negatives)
    return frozenset(r.word for r in fair.select("word", "n").mapInArrow(run, "word string, n long").collect())


def fit_monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic fit in which no hit of abuse lowers the score: features whose
    coefficient comes out negative, but for those of quotation, are left out."""
    free = {FEATURES.index("quoted"), FEATURES.index("reported")}
    used = list(range(x.shape[1]))
    while True:
        w, bias = fit_logistic(x[:, used], y)
        bad = [i for i, c in zip(used, w, strict=True) if c < 0 and i not in free]
        if not bad:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out, bias
        used = [i for i in used if i not in bad]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised likelihood; the bias is not penalised."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> ToxicityModel:
    """Learns lexicon and model from a bounded sample of the labelled rows."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positives, negatives = count.get(1, 0), count.get(0, 0)
    if not positives or not negatives:
        rate = min(0.49, (positives + 0.5) / (positives + negatives + 2))
        return ToxicityModel({}, bias=math.log(rate / (1 - rate)))
    counts = cut(word_counts(rows), "words")
    weights = learn_lexicon(counts, positives, negatives)
    ordinary = learn_ordinary(counts, weights, positives, negatives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, ordinary)
        for batch in batches:
            made = [features(value.as_py(), lexicon) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()  # at most ``most`` short rows
    got = got.assign(k=got.x.map(tuple)).sort_values(["k", "label"])  # the sums don't depend on the rows' order
    coefficients, bias = fit_monotone(np.array(got.x.tolist()), got.label.to_numpy(float))
    return ToxicityModel(weights, ordinary, coefficients.tolist(), bias)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row; no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(value.as_py()) for value in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
