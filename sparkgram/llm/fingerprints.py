"""Document fingerprints: one-permutation MinHash in packed low-order bits.

Each word shingle is hashed once.  The top bits of the hash name a bin, and a
bin keeps its least hash; as the hashes are sorted, that is the first of them
at or after the bin's lower edge.  Empty bins are filled by optimal
densification: bin i tries the bins h(i, 1), h(i, 2), ... of one hash family
that all texts share, and copies the first that is not empty.  Of every minimum
the low ``BITS`` bits are kept and packed.

Two such fingerprints agree in a bin with probability J + (1 - J) / 2^BITS, so
the share m of agreeing bins gives the estimate (m - c) / (1 - c), c = 2^-BITS,
cut to [0, 1].

Defined cases: a text without words (null, empty, white space) has the empty
fingerprint, alike (1.0) to an empty one and unlike (0.0) any other; a text of
fewer than five words has one shingle; equal texts have equal fingerprints;
repeated keys are ordered by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgram.llm.common import WordHashes, bounded_batches, mix64, range_bounds, range_of, ranges_for, shingle_hashes

BINS = 512  # a power of two
BITS = 4
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
#: Attempts drawn at once for the bins that are still empty.
_ROUND = 64


def _attempts(bins: np.ndarray, first: int) -> np.ndarray:
    """[bin, attempt]: the bins that each of ``bins`` tries, from attempt ``first`` on."""
    tries = np.arange(first, first + _ROUND, dtype=np.uint64)
    return (mix64((bins.astype(np.uint64)[:, None] << np.uint64(32)) ^ tries[None, :]) >> _SHIFT).astype(np.int64)


_FIRST = _attempts(np.arange(BINS), 0)


def bin_minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin after densification; ``hashes`` sorted, not empty."""
    at = np.searchsorted(hashes, _EDGES)
    minima = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((minima >> _SHIFT) == (_EDGES >> _SHIFT))
    source = np.arange(BINS)
    empty, first = np.flatnonzero(~full), 0
    while len(empty):
        tried = _FIRST[empty] if not first else _attempts(empty, first)
        good = full[tried]
        found = good.any(axis=1)
        source[empty[found]] = tried[found, np.argmax(good[found], axis=1)]
        empty, first = empty[~found], first + _ROUND
    return minima[source]


_BIN_KEYS = mix64(np.arange(BINS, dtype=np.uint64))


def pack(minima: np.ndarray) -> bytes:
    """Low-order bits of the minima, two bins a byte.

    A minimum that fills several bins is hashed again with each bin's key, so
    that two different minima agree by chance in each bin independently.
    """
    low = (mix64(minima ^ _BIN_KEYS) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


class Fingerprinter:
    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> bytes:
        s = shingle_hashes(text, self.hashes)
        return pack(bin_minima(s)) if len(s) else b""


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    agree = int(np.count_nonzero(x & 15 == 0) + np.count_nonzero(x >> 4 == 0))
    c = 2.0**-BITS
    return min(1.0, max(0.0, (agree / BINS - c) / (1 - c)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` in lowercase hex for every row; no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        for batch in batches:
            prints = pa.array([make(value.as_py()).hex() for value in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, following: str, own: bytes, other: bytes, make: Fingerprinter) -> tuple:
    changed = edited(text, following)
    of_changed = own if changed == text else make(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own.hex(), of_changed.hex(), likeness(own, of_changed), likeness(own, other)


def in_order_with_next(rows: DataFrame, parts: int) -> DataFrame:
    """(id, text) in descending order of id, then by text, in ranges of ids; the
    rows of a range are followed by a copy of the row that comes next, marked
    ``guest``: the first row of the next range, after the last range of the first.

    The ranges come from one column.  The first row of each is found by an
    aggregate on ids, one row a range, which is small enough to broadcast; so
    the texts move once, and nothing of them is kept apart.
    """
    ranged = rows.withColumn("part", range_of(F.col("id"), range_bounds(rows, "id", parts)))
    by_part = Window.orderBy("part")  # over one row a range
    heads = ranged.groupBy("part").agg(F.max("id").alias("head"))
    heads = heads.withColumn("above", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())))
    placed = ranged.join(F.broadcast(heads), "part")
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    twice = F.array(own, F.struct(F.col("above").alias("part"), F.lit(True).alias("guest")))
    stands = F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), twice).otherwise(F.array(own)))
    dealt = placed.select("id", "text", stands.alias("at")).select("at.part", "at.guest", "id", "text")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next
    document, by descending id; after the last comes the first.

    One shuffle puts documents in order; each meets its next as the rows stream
    by, two texts at a time.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        at, before = None, None  # the range, and (id, text, fingerprint) of the row in hand
        for batch in batches:
            ids, out = [], []
            for part, guest, key, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if part != at:
                    at, before = part, None
                if guest and before is None:
                    continue  # of several next rows with one id the first has come
                text = value.as_py()
                row = (key, text, make(text))
                if before is not None:
                    ids.append(before[0])
                    out.append(_compared(before[1], text, before[2], row[2], make))
                before = None if guest else row
            columns = [pa.array(ids, batch.schema.field("id").type), *(pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_FIELDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(name for name, _ in _FIELDS)])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = in_order_with_next(rows, ranges_for(docs))
    return ordered.mapInArrow(run, f"id {kind}, {_DDL}").withColumnRenamed("id", id_col)
