"""What the operators of this package share: tables, scratch storage, words and hashes."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgram.sources.scratch import cut, release, scratch_path
from sparkgram.sources.session import importable

__all__ = ["cut", "release", "scratch_path"]

#: Bytes of an Arrow batch handed to Python: memory follows the longest text, not the number of rows.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python stages by bytes, and lets
    workers find this package.  All operators ask for the same bound, so it
    holds whenever a plan runs."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ranges_for(docs: DataFrame) -> int:
    """Tasks for a shuffle of the texts by ranges: as many as the planner's size of
    the input has splits, and one for each core at least; the session's number
    where the size is unknown."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    by_size = size // split + 1
    if by_size > 1 << 24:
        by_size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, by_size)


def range_bounds(docs: DataFrame, id_col: str, parts: int) -> list:
    """Upper bounds of ``parts`` ranges of about equal numbers of ids; one column is read."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull())
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        shares = [i / parts for i in range(1, parts)]
        return sorted({int(b) for b in ids.stat.approxQuantile(id_col, shares, 0.2 / parts)}) if shares else []
    # other kinds: a bounded sample of distinct ids, by hash
    picked = sorted(r[0] for r in ids.distinct().orderBy(F.xxhash64(id_col)).limit(parts * 20).collect())
    return [picked[i * len(picked) // parts] for i in range(1, parts)] if len(picked) >= parts else []


def range_of(key: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    whole = all(isinstance(b, int) for b in bounds)
    held = F.lit(np.array(bounds, np.int64)) if whole else F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < key, at + step).otherwise(at))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def piece_finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern of the ``regex`` module.

    Texts of Latin-1 characters take the standard module, which is twice as
    fast: there the Unicode classes are small, and are spelled out by asking
    ``regex`` for each of the 256 characters.
    """
    general = regex.compile(pattern).findall
    members = {c: "".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}
    spelled = re.sub(r"\[([^\]]*)\]", lambda m: "[" + _replaced(m[1], members, "") + "]", pattern)
    spelled = re.sub(r"(\[[^\]]*\])|([^\[]+)", lambda m: m[1] or _replaced(m[2], members, "[]"), spelled).replace(r"\S", f"[^{members[chr(92) + 's']}]")
    narrow = re.compile(spelled).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return narrow(text)

    return find


def _replaced(part: str, members: dict[str, str], around: str) -> str:
    for name, chars in members.items():
        part = part.replace(name, around[:1] + chars + around[1:])
    return part


class _Codes(dict):
    """Numbers keys by first appearance; ``order`` lists them."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self.order)
        self.order.append(key)
        return code


#: Pieces remembered by a Python worker.
PIECES = 500_000


class PieceTable:
    """Encodes each distinct piece of texts once.

    ``find`` splits a text, and ``learn`` gives for new pieces their ids, one
    after the other, and how many each has.  Pieces are numbered; the ids of
    number k are ``flat[start[k] : start[k] + length[k]]``, so a run of texts is
one gather.  Beyond ``keys`` pieces only those stay that came up again, the
    latest half at most; that bounds memory, and most pieces of a corpus come up
    once.
    """

    def __init__(self, find: Callable, learn: Callable, dtype: str, keys: int = PIECES):
        self.find, self.learn, self.type, self.keys = find, learn, np.dtype(dtype), keys
        self.codes = _Codes()
        #: By number: where its ids are, whether it came up again, and in which run of texts it came up last.
        self.start, self.length, self.again, self.last = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool), np.zeros(1024, np.int64)
        self.flat, self.used, self.run = np.zeros(1 << 16, self.type), 0, 0

    def _forget(self) -> None:
        n = len(self.codes.order)
        at = np.flatnonzero(self.again[:n])
        at = np.sort(at[np.argsort(-self.last[at], kind="stable")[: self.keys // 2]])
        while int(self.length[at].sum()) > 8 * self.keys:  # pieces of very many ids
            at = at[: len(at) // 2]
        flat, order, lengths = self._gather(at), self.codes.order, self.length[at]
        self.codes = _Codes()
        for i in at.tolist():
            self.codes[order[i]]
        k = len(at)
        self.start[:k], self.length[:k], self.last[:k] = np.cumsum(lengths) - lengths, lengths, self.last[at]
        self.again[:] = False
        self.flat[: len(flat)] = flat
        self.used = len(flat)

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        lengths = self.length[codes]
        upto = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[codes] - (upto - lengths), lengths) + np.arange(int(upto[-1]) if len(upto) else 0)]

    def _put(self, pieces: list[str], first: int) -> None:
        """Takes in new pieces, numbered from ``first``."""
        ids, lengths = self.learn(pieces)
        upto = first + len(pieces)
        for name in ("start", "length", "again", "last"):
            setattr(self, name, _with_room(getattr(self, name), first, upto))
        self.flat = _with_room(self.flat, self.used, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first:upto] = self.used + np.cumsum(lengths) - lengths
        self.length[first:upto] = lengths
        self.again[first:upto] = False
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """(ids of all texts, where each text's ids end)."""
        found = [self.find(t) if t else [] for t in texts]
        if len(self.codes.order) > self.keys or self.used > 16 * self.keys:
            self._forget()
        known = len(self.codes.order)
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64, int(ends[-1]) if len(ends) else 0)
        if len(self.codes.order) > known:
            self._put(self.codes.order[known:], known)
        self.run += 1
        self.again[codes[codes < known]] = True
        self.last[codes] = self.run
        upto = np.concatenate([[0], np.cumsum(self.length[codes])])
        return self._gather(codes), upto[ends].tolist()


def _with_room(held: np.ndarray, used: int, upto: int) -> np.ndarray:
    """``held``, or a longer array with its first ``used`` values."""
    if upto <= len(held):
        return held
    room = np.zeros(max(2 * len(held), upto), held.dtype)
    room[:used] = held[:used]
    return room


#: Odd multipliers, one for each place of a shingle (splitmix64 of 1, 2, ...).
def _odd_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values with full avalanche."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    With fewer than ``width`` words the whole sequence is the one shingle;
    without words the set is empty.
    """
    h = hashes.of(ascii_words(text))
    if not len(h):
        return h
    width = min(width, len(h))
    places = _odd_constants(width, width)
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for i in range(width):
            s += mix64(h[i : i + n] ^ places[i]) * places[i]
    return np.unique(mix64(s))


def empty_string_for_null(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
