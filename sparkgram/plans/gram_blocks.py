"""N-grams counted in blocks of numbers instead of rows of strings.

A task takes a run of texts, numbers its words, packs each n-gram into 64 bits
and counts by sorting.  What it found goes out in blocks, one for each bucket
that the hash of a whole n-gram falls into, so a bucket has every n-gram at most
once from each run, however often it occurs.  A bucket's blocks are merged in
the same way.  Words travel as numbers of their characters, longer ones as they
are, so the counts are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkgram.functions.alphabet import NAMED
from sparkgram.sources.config import LanguageModelConfig
from sparkgram.sources.session import importable

#: Longest n-grams that pack into 64 bits, and the positions of a run, so that its words can be numbered in BITS.
MOST_ORDER, BITS = 3, 21
POSITIONS = (1 << BITS) - 8
#: Bytes of a run of texts and of lists, of an Arrow batch, and of the (compressed) input for each bucket.
RUN_BYTES, ASKED_BYTES, BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20, 2 << 20, 12 << 20
MOST_BUCKETS = (1 << 16) - 1
#: Codes of the marks and of longer words (with their place in a list); all others are below.
START, END, LONG = 1 << 62, (1 << 62) + 1, 1 << 63

#: Kinds of blocks, and the bytes that name a run of lists.
_COUNTED, _ASKED, _HOME, RUN_SIZE = b"c", b"a", b"h", 16

BLOCKS = "bucket int, block binary"
ANSWERS = "run binary, bucket int, block binary"
TOTALS = "n int, n_grams long, total long, most long"


def _characters(names: Iterable[str]) -> list[int]:
    spans = [range(ord(s[0]), ord(s[2]) + 1) if (s := NAMED.get(name)) else map(ord, name) for name in names]
    out = list(dict.fromkeys(c for span in spans for c in span))
    return [*out, ord("ё")] if "russian" in names and ord("ё") not in out else out


def supported(config: LanguageModelConfig) -> bool:
    """Whether blocks give what the string functions give: separators that lower-casing
    neither changes nor makes, no letters whose lower case depends on their neighbours, no
    trimmed spaces, marks that are no words."""
    letters = set(_characters(config.alphabet))
    marks = (config.start, config.end)
    plain = all(c.isascii() and not c.isalnum() for c in "".join(config.separators))
    apart = marks[0] != marks[1] and all(" " not in m and any(ord(c) not in letters for c in m) for m in marks)
    return config.order <= MOST_ORDER and bool(letters) and bool("".join(config.separators)) and plain and apart and not letters & set(map(ord, " σς"))


def buckets_for(texts: DataFrame) -> int:
    """Buckets for the n-grams of a table: by the planner's size of it, one for each core at
    least; the session's number of shuffle partitions where the size is unknown."""
    spark = texts.sparkSession
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 1 << 50 else size // BUCKET_BYTES + 1
    return max(spark.sparkContext.defaultParallelism, min(by_size, MOST_BUCKETS))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words as numbers: their characters as digits, as many as 62 bits hold."""

    def __init__(self, config: LanguageModelConfig):
        self.config = config
        self.letters = _characters(config.alphabet)
        self.base = len(self.letters) + 1
        self.short = next(k for k in range(62, 0, -1) if self.base**k <= 1 << 62)
        self.separator = self.base
        known = [*self.letters, *map(ord, "".join(config.separators))]
        #: UTF-8 can be read byte by byte where all that counts is ASCII
        self.bytewise = max(known) < 128
        self.digit = np.zeros(256 if self.bytewise else 0x110000, np.uint8 if self.base < 255 else np.uint32)
        self.digit[self.letters] = np.arange(1, self.base)
        self.digit[known[len(self.letters) :]] = self.separator

    def _read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
        """(digits of all characters, where texts start, bytes of a span)."""
        if not len(texts):
            return np.zeros(0, self.digit.dtype), np.zeros(0, np.int64), lambda a, b: b""
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = (held.to_pybytes() if held else b"")[offsets[0] : offsets[-1]]
        if self.bytewise:
            return self.digit[np.frombuffer(data, np.uint8)], offsets[:-1] - offsets[0], lambda a, b: data[a:b]
        parts = [data[a:b].decode("utf-8", "replace") for a, b in zip((offsets - offsets[0])[:-1].tolist(), (offsets - offsets[0])[1:].tolist(), strict=True)]
        text = "".join(parts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.digit[points], np.cumsum([0, *map(len, parts)])[:-1], lambda a, b: text[a:b].encode()

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(start, end, sentence, code) of the words of texts, and the longer words."""
        digits, rows, span = self._read(texts)
        rows = rows[rows < len(digits)]
        within = (digits > 0) & (digits < self.separator)
        before = np.concatenate([[False], within[:-1]]) if len(within) else within
        before[rows] = False
        starts = np.flatnonzero(within & ~before)
        after = np.concatenate([within[1:], [False]]) if len(within) else within
        after[rows[1:] - 1] = False
        ends = np.flatnonzero(within & ~after) + 1
        bounds = np.sort(np.concatenate([np.flatnonzero(digits == self.separator), rows]))
        sentence = np.searchsorted(bounds, starts, side="right")
        codes = np.zeros(len(starts), np.uint64)
        lengths = ends - starts
        at = np.flatnonzero(lengths <= self.short)
        base = np.uint64(self.base)
        for k in range(self.short):
            if not len(at):
                break
            codes[at] = codes[at] * base + digits[starts[at] + k]
            at = at[lengths[at] > k + 1]
        long: dict[bytes, int] = {}
        for i in np.flatnonzero(lengths > self.short).tolist():
            codes[i] = LONG | long.setdefault(span(int(starts[i]), int(ends[i])), len(long))
        return starts, ends, sentence, codes, list(long)


def _encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, number of each)."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)


def _wrapped(ids: np.ndarray, first: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with marks around each sentence, where sentences end); ``first`` tells which words begin one."""
    number = np.cumsum(first)
    seq = np.full(len(ids) + 2 * (int(number[-1]) if len(ids) else 0), end, np.int64)
    places = np.arange(len(ids)) + 2 * number - 1
    seq[places] = ids
    seq[places[first] - 1] = start
    last = np.zeros(len(seq), bool)
    last[places[first][1:] - 2] = True
    last[-1:] = True
    return seq, last


def _hashes(codes: np.ndarray, long: list[bytes]) -> np.ndarray:
    hashes = codes.copy()
    if long:
        at = np.flatnonzero(codes >= LONG)
        hashes[at] = np.array([LONG | zlib.crc32(long[int(c) - LONG]) for c in codes[at]], np.uint64)
    return _mixed(hashes)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[firsts], np.diff(np.append(firsts, len(keys)))


def _text_blocks(words: Words, texts: pa.Array, order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the n-grams of the wrapped sentences of a run of texts."""
    _, _, sentence, codes, long = words.tokens(texts)
    distinct, ids = _encoded(codes)
    seq, last = _wrapped(ids, np.diff(sentence, prepend=-1) != 0, len(distinct), len(distinct) + 1)
    distinct = np.append(distinct, np.array([START, END], np.uint64))
    seq = np.append(seq, np.zeros(order, np.int64))
    for lo in range(0, len(last), POSITIONS):
        size = min(POSITIONS, len(last) - lo)
        part, codes = seq[lo : lo + size + order], distinct
        if len(codes) >= 1 << BITS:
            numbers, part = np.unique(part, return_inverse=True)
            codes = codes[numbers]
        part, hashes = part.astype(np.uint64), _hashes(codes, long)
        at = np.arange(size)
        keys = part[:size]
        found = []
        for n in range(1, order + 1):
            if n > 1:
                goes_on = ~last[lo + at + n - 2]
                at, keys = at[goes_on], keys[goes_on]
                keys = (keys << np.uint64(BITS)) | part[at + n - 1]
            grams, counts = _counted(keys)
            columns = [((grams >> np.uint64(BITS * (n - 1 - k))) & np.uint64((1 << BITS) - 1)).astype(np.uint32) for k in range(n)]
            dealt, upto = _dealt(columns, hashes, buckets)
            found.append(([c[dealt] for c in columns], counts[dealt], upto))
        at, blocks = _written(found, codes, long, buckets, None)
        yield _batch(at, blocks)


def _asked_blocks(words: Words, rows: pa.RecordBatch, order: int, buckets: int, wrap: bool) -> pa.RecordBatch:
    """Blocks of the n-grams of a run of (id, list of words, any words), one for each bucket, and one
    that tells how the answers make up the scores: sizes of the lists, the place of each position's
    n-grams in the answers (-1 where there is none), the ids."""
    lists = rows.column(1)
    null = lists.is_null().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.fill_null(lists.flatten(), "").dictionary_encode()
    spelled, ids = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends, _, codes, long = words.tokens(spelled)
    # words that are one whole run of the alphabet's characters, or marks; all others have code 0
    spans = np.zeros(len(spelled) + 1, np.int64)
    spans[1:] = np.cumsum((pc.binary_length if words.bytewise else pc.utf8_length)(spelled).to_numpy(zero_copy_only=False))
    row = np.searchsorted(spans, starts, side="right") - 1
    whole = (starts == spans[row]) & (ends == spans[row + 1])
    of = np.zeros(len(spelled) + 2, np.uint64)
    of[row[whole]] = codes[whole]
    of[:-2][pc.equal(spelled, words.config.start).to_numpy(zero_copy_only=False)] = START
    of[:-2][pc.equal(spelled, words.config.end).to_numpy(zero_copy_only=False)] = END
    of[-2:] = START, END
    marks = np.where(null | (not wrap), 0, 1)
    lengths = sizes + 2 * marks
    firsts = np.cumsum(lengths) - lengths
    seq = np.full(int(lengths.sum()), len(of) - 1, np.int64)
    seq[firsts[marks > 0]] = len(of) - 2
    seq[np.arange(len(ids)) + np.repeat(firsts + marks - (np.cumsum(sizes) - sizes), sizes)] = ids
    codes, number = _encoded(of)
    seq = number[seq].astype(np.int64)
    left = np.repeat(firsts + lengths, lengths) - np.arange(len(seq))
    foreign = codes[seq] == 0
    hashes = _hashes(codes, long)
    at = np.flatnonzero(~foreign)
    keys, columns = seq[at], []
    found, places = [], []
    for n in range(1, order + 1):
        if n > 1:
            goes_on = np.flatnonzero(left[at] >= n)
            goes_on = goes_on[~foreign[at[goes_on] + n - 1]]
            at = at[goes_on]
            keys = inverse[goes_on] * len(codes) + seq[at + n - 1]
        grams, inverse = np.unique(keys, return_inverse=True)
        columns = [c[grams // len(codes)] for c in columns] + [(grams % len(codes) if n > 1 else grams).astype(np.uint32)]
        dealt, upto = _dealt(columns, hashes, buckets)
        rank = np.empty(len(grams), np.int32)
        rank[dealt] = np.arange(len(grams), dtype=np.int32)
        place = np.full(len(seq), -1, np.int32)
        place[at] = rank[inverse]
        places.append(place)
        found.append(([c[dealt] for c in columns], np.ones(len(grams), np.int64), upto))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([rows.schema.field(0)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([rows.column(0)], schema=pa.schema([rows.schema.field(0)])))
    home = b"".join([np.array([len(lengths), len(seq)], np.int64).tobytes(), lengths.astype(np.int64).tobytes(), *[p.tobytes() for p in places], sink.getvalue().to_pybytes()])
    run = hashlib.blake2b(home, digest_size=16).digest()
    numbers, blocks = _written(found, codes, long, buckets, run)
    return _batch([*numbers, run[0] * buckets >> 8], [*blocks, _HOME + run + home])


def _batch(numbers: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _dealt(ids: list[np.ndarray], hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by buckets, and where buckets start in it."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for column in ids:
            h = (h ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _of_planes(block: bytes, itemsize: int, size: int, at: int) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8, itemsize * size, at).reshape(itemsize, size)
    return np.ascontiguousarray(planes.T).view(f"u{itemsize}").reshape(size)


def _written(found: list, codes: np.ndarray, long: list[bytes], buckets: int, run: bytes | None) -> tuple[list[int], list[bytes]]:
    """A block for each bucket that has n-grams: sizes, codes of its words, numbers of the
    words of its n-grams, their counts, the longer words.  A ``run`` that asks has a block for every bucket, without counts."""
    asked = run is not None
    rank, there = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    numbers, blocks = [], []
    for b in range(buckets):
        cut = [([c[upto[b] : upto[b + 1]] for c in ids], counts[upto[b] : upto[b + 1]]) for ids, counts, upto in found]
        if not asked and not any(len(counts) for _, counts in cut):
            continue
        for ids, _ in cut:
            for c in ids:
                there[c] = True
        own = np.flatnonzero(there)
        there[own] = False
        rank[own] = np.arange(len(own))
        own_codes = codes[own]
        at_long = np.flatnonzero(own_codes >= LONG)
        own_long = [long[int(c) - LONG] for c in own_codes[at_long]]
        own_codes[at_long] = np.uint64(LONG) | np.arange(len(at_long), dtype=np.uint64)
        width = np.uint16 if len(own) <= 1 << 16 else np.uint32
        most = [int(counts.max()) if len(counts) else 0 for _, counts in cut]
        sizes = [np.uint8 if m < 256 else np.uint32 for m in most]
        head = np.array([len(own), len(own_long), np.dtype(width).itemsize, *[x for (_, counts), s in zip(cut, sizes, strict=True) for x in (len(counts), np.dtype(s).itemsize)]], np.int32)
        parts = [head.tobytes(), _planes(own_codes)]
        for (ids, counts), s in zip(cut, sizes, strict=True):
            parts += [_planes(rank[c].astype(width)) for c in ids]
            if not asked:
                parts.append(_planes(counts.astype(s)))
        parts += [np.array([len(w) for w in own_long], np.int32).tobytes(), *own_long]
        numbers.append(b)
        body = b"".join(parts)
        blocks.append((_ASKED + run if asked else _COUNTED) + np.int64(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True))
    return numbers, blocks


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to at least ``most`` bytes but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _of_texts(texts: DataFrame, text_col: str, config: LanguageModelConfig, buckets: int) -> DataFrame:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(config)
        for run in _runs(batches, RUN_BYTES):
            yield from _text_blocks(words, run.column(0), config.order, buckets)

    importable(texts.sparkSession)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return texts.select(F.lower(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(blocks, BLOCKS)


class _Merged:
    """The n-grams of a bucket: their ``counts`` by order, and what runs ask for."""

    def __init__(self, blocks: Iterable[bytes], order: int):
        codes, long, first = [], {}, 0
        ids: list[list[list[np.ndarray]]] = [[[] for _ in range(n)] for n in range(1, order + 1)]
        counts: list[list[np.ndarray]] = [[] for _ in range(order)]
        #: (run, where its n-grams of each order are)
        self.asked: list[tuple[bytes, list[tuple[int, int]]]] = []
        upto = [0] * order
        for block in blocks:
            asked = block[:1] == _ASKED
            name = block[1 : 1 + RUN_SIZE * asked]
            at = 9 + len(name)
            block = pa.decompress(block[at:], int(np.frombuffer(block, np.int64, 1, at - 8)[0]), "zstd", asbytes=True)
            at = 0
            head = np.frombuffer(block, np.int32, 3 + 2 * order, at).tolist()
            at += 4 * len(head)
            n_own, n_long, width = head[:3]
            own = _of_planes(block, 8, n_own, at).copy()
            at += own.nbytes
            for n in range(order):
                size, bytes_of = head[3 + 2 * n : 5 + 2 * n]
                for k in range(n + 1):
                    ids[n][k].append(_of_planes(block, width, size, at).astype(np.uint32) + np.uint32(first))
                    at += size * width
                if asked:
                    counts[n].append(np.zeros(size, np.int64))
                else:
                    counts[n].append(_of_planes(block, bytes_of, size, at).astype(np.int64))
                    at += size * bytes_of
            if asked:
                self.asked.append((name, [(upto[n], head[3 + 2 * n]) for n in range(order)]))
            upto = [u + head[3 + 2 * n] for n, u in enumerate(upto)]
            lengths = np.frombuffer(block, np.int32, n_long, at).tolist()
            at += 4 * n_long
            for i, length in zip(np.flatnonzero(own >= LONG).tolist(), lengths, strict=True):
                own[i] = LONG | long.setdefault(block[at : at + length], len(long))
                at += length
            codes.append(own)
            first += n_own
        distinct, number = _encoded(np.concatenate(codes)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        summed = [_summed([number[np.concatenate(c)] for c in ids[n]], np.concatenate(counts[n]), len(distinct), bool(self.asked)) if codes else (counts[n], None) for n in range(order)]
        self.counts, self.group = [c for c, _ in summed], [g for _, g in summed]

    def answers(self) -> Iterator[tuple[bytes, bytes]]:
        """(run, the number of all words and marks here and the counts of what it asks for)."""
        total = np.array([self.counts[0].sum()], np.int64).tobytes()
        for run, spans in self.asked:
            sizes = np.array([size for _, size in spans], np.int64).tobytes()
            yield run, b"".join([total, sizes, *[c[g[a : a + size]].tobytes() for (a, size), c, g in zip(spans, self.counts, self.group, strict=True)]])


def _summed(ids: list[np.ndarray], counts: np.ndarray, words: int, asked: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(counts of the distinct n-grams, which of them each n-gram is, if ``asked``)."""
    bits = max(words - 1, 1).bit_length()
    if bits * len(ids) <= 64:
        keys = np.zeros(len(counts), np.uint64)
        for c in ids:
            keys = (keys << np.uint64(bits)) | c.astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        new = keys[1:] != keys[:-1]
    else:
        order = np.lexsort(ids[::-1])
        new = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in ids])
    new = np.concatenate([[True], new])[: len(order)]
    group = None
    if asked:
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    return np.add.reduceat(counts[order], firsts) if len(firsts) else counts, group


def totals(texts: DataFrame, text_col: str, config: LanguageModelConfig) -> DataFrame:
    """``(n, n_grams, total, most)`` by order: distinct n-grams, the sum and the largest of their counts."""

    def merge(table: pa.Table) -> pa.Table:
        counts = _Merged((b.as_py() for b in table["block"]), config.order).counts
        full = [(n, c) for n, c in enumerate(counts, 1) if len(c)]
        values = [[len(c) for _, c in full], [int(c.sum()) for _, c in full], [int(c.max()) for _, c in full]]
        return pa.table([pa.array([n for n, _ in full], pa.int32()), *[pa.array(v, pa.int64()) for v in values]], names=["n", "n_grams", "total", "most"])

    merged = _of_texts(texts, text_col, config, buckets_for(texts)).groupBy("bucket").applyInArrow(merge, TOTALS)
    return merged.groupBy("n").agg(F.sum("n_grams").alias("n_grams"), F.sum("total").alias("total"), F.max("most").alias("most"))


def scores(texts: DataFrame, text_col: str, config: LanguageModelConfig, lists: DataFrame, id_col: str, wrap: bool, backoff: float, unknown: float) -> DataFrame:
    """``lists`` (id, words) -> (id, score) by the n-grams of texts, with prefix back-off.

    Wrapped lists are the sum over their full windows, 0.0 if they are shorter than
    the order; others are scored as one window.  Lists ask for their n-grams in the
    buckets of the texts' n-grams, and the answers of all buckets meet again by runs of lists.
    """
    order, buckets = config.order, buckets_for(texts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(config)
        for run in _runs(batches, ASKED_BYTES):
            yield _asked_blocks(words, run, order, buckets, wrap)

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        blocks = table["block"].to_pylist()
        out = [(b[1 : 1 + RUN_SIZE], -1, b[1 + RUN_SIZE :]) for b in blocks if b[:1] == _HOME]
        out += [(run, bucket, block) for run, block in _Merged((b for b in blocks if b[:1] != _HOME), order).answers()]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], names=["run", "bucket", "block"])

    id_type = to_arrow_type(lists.schema[id_col].dataType)

    def score(table: pa.Table) -> pa.Table:
        # equal runs (rows without ids of their own) come up together
        at = np.argsort(table["bucket"].to_numpy(), kind="stable")
        numbers, blocks = table["bucket"].to_numpy()[at], table["block"].take(pa.array(at)).to_pylist()
        copies = int((numbers == -1).sum())
        if not copies or numbers.tolist() != [b for b in range(-1, buckets) for _ in range(copies)]:
            raise RuntimeError("answers of a run of lists are missing: its rows came in another order when they were read again")
        ids, values = _scored(blocks[0], blocks[copies::copies], order, wrap, backoff, unknown)
        one = pa.table([ids.cast(id_type), pa.array(values, pa.float64())], names=[id_col, "score"])
        return pa.concat_tables([one] * copies)

    counted = _of_texts(texts, text_col, config, buckets)
    asked = lists.select(id_col, "words").mapInArrow(ask, BLOCKS)
    schema = StructType([StructField(id_col, lists.schema[id_col].dataType), StructField("score", DoubleType())])
    return counted.unionByName(asked).groupBy("bucket").applyInArrow(answer, ANSWERS).groupBy("run").applyInArrow(score, schema)


def _part(answer: np.ndarray, n: int, order: int) -> np.ndarray:
    """The counts of order n + 1 of an answer (total, sizes, counts)."""
    sizes = answer[1 : 1 + order]
    first = 1 + order + int(sizes[:n].sum())
    return answer[first : first + int(sizes[n])]


def _scored(home: bytes, answers: list[bytes], order: int, wrap: bool, backoff: float, unknown: float) -> tuple[pa.Array, np.ndarray]:
    rows, size = np.frombuffer(home, np.int64, 2).tolist()
    lengths = np.frombuffer(home, np.int64, rows, 16)
    at = 16 + lengths.nbytes
    places = [np.frombuffer(home, np.int32, size, at + 4 * size * n) for n in range(order)]
    ids = pa.ipc.open_stream(home[at + 4 * size * order :]).read_all().column(0)
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    heads = [np.frombuffer(a, np.int64) for a in answers]
    total = sum(int(h[0]) for h in heads)
    counts = []
    for n in range(order):
        known = np.concatenate([*[_part(h, n, order) for h in heads], np.zeros(1, np.int64)])
        counts.append(known[places[n]])  # -1 is the last: 0
    if wrap:
        longest = np.full(size, order)
    else:
        longest = np.minimum(np.repeat(ends, lengths) - np.arange(size), order)
    score = np.full(size, unknown)
    above = np.full(size, total, np.float64)
    discounts = np.array([backoff**k for k in range(order)])
    for n in range(1, order + 1):
        c = counts[n - 1].astype(np.float64)
        seen = np.flatnonzero((c > 0) & (above > 0) & (longest >= n))
        score[seen] = np.log(discounts[longest[seen] - n] * c[seen] / above[seen])
        above = c
    if wrap:
        full = np.repeat(ends, lengths) - np.arange(size) >= order
        return ids, np.bincount(np.repeat(np.arange(rows), lengths)[full], score[full], rows)
    return ids, np.where(lengths > 0, np.append(score, unknown)[np.where(lengths > 0, firsts, size)], unknown)
