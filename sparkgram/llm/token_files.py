"""Token-id files: shards of raw ids with a minimal perfect hash index.

A shard is one row of a Parquet table: the ids of consecutive documents
(ascending key) as raw little-endian integers, the offset of each document, and
an index from document keys to documents.  The index is a minimal perfect hash
function (one slot for each distinct key and none empty) stored as one pilot
for each small bucket of keys; a slot holds a fingerprint of its key, so keys
that the shard lacks are told apart, and the place of the key's documents.  A
lookup costs one pilot, one slot and one slice, however large the shard.

Writing goes through Spark's own writer: a shard appears only when its task
commits, lost executors repeat their tasks, and any Hadoop path will do.

Defined cases: null or empty texts hold the end id alone; repeated keys keep
all their documents, ordered by their ids; null keys come first; an empty table
gives no shards.  A document longer than a shard's target gets a shard of its
own, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgram.llm.bpe import slices
from sparkgram.llm.common import PIECES, PieceTable, bounded_batches, mix64, piece_finder, range_bounds, range_of, ranges_for, scratch_path

#: Ids a shard aims at.
SHARD_IDS = 1 << 17
#: Shards in a row group of a file, which bounds what its writer and readers hold.
GROUP_SHARDS = 16
#: Keys a bucket of the hash function holds on average.
BUCKET_KEYS = 4
FORMAT = 1

_SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("repeats", "<u4")])


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit key hashes.

    Buckets are placed largest first, those of one size together; each tries
    pilots until all its keys fall on free, distinct slots.  Buckets of one key take the slots that are left:
    their pilot is minus the slot, minus one.
    """

    def __init__(self, size: int, pilots: np.ndarray):
        self.size, self.pilots = size, pilots

    @staticmethod
    def _spread(hashes: np.ndarray, pilots: np.ndarray, size: int) -> np.ndarray:
        return (mix64(hashes ^ mix64(pilots.astype(np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        size = len(hashes)
        if not size:
            return cls(0, np.zeros(0, np.int64))
        n_buckets = size // BUCKET_KEYS + 1
        bucket = (mix64(hashes) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=n_buckets)
        starts = np.concatenate([[0], np.cumsum(counts)])
        pilots = np.zeros(n_buckets, np.int64)
        free = np.ones(size, bool)
        for width in range(int(counts.max()), 1, -1):
            left = np.flatnonzero(counts == width)
            keys = hashes[order[starts[left][:, None] + np.arange(width)]]
            pilot = 0
            while len(left) > 32:  # every bucket of this size tries the same pilot; the first to claim a slot wins
                at = cls._spread(keys, np.full((len(left), 1), pilot), size)
                ranked = np.sort(at, axis=1)
                good = np.flatnonzero(free[at].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
                _, first, back = np.unique(at[good], return_index=True, return_inverse=True)
                owner = (first // width)[back].reshape(len(good), width)
                won = good[(owner == np.arange(len(good))[:, None]).all(axis=1)]
                pilots[left[won]] = pilot
                free[at[won]] = False
                rest = np.ones(len(left), bool)
                rest[won] = False
                left, keys, pilot = left[rest], keys[rest], pilot + 1
            for bucket, own in zip(left, keys, strict=True):  # a few are left: many pilots at once for each
                for first in range(pilot, 1 << 40, 256):
                    at = cls._spread(own[None, :], np.arange(first, first + 256)[:, None], size)
                    ranked = np.sort(at, axis=1)
                    good = free[at].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                    if good.any():
                        chosen = int(np.argmax(good))
                        pilots[bucket] = first + chosen
                        free[at[chosen]] = False
                        break
        pilots[counts == 1] = -np.flatnonzero(free) - 1
        return cls(size, pilots)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each hash; of a key that was not built in, any slot."""
        pilots = self.pilots[(mix64(hashes) % np.uint64(len(self.pilots))).astype(np.int64)]
        return np.where(pilots < 0, np.minimum(-pilots - 1, self.size - 1), self._spread(hashes, np.maximum(pilots, 0), self.size))


def key_hashes(keys: list) -> np.ndarray:
    """64-bit hashes of document keys: integers, strings or null."""
    whole = [k if type(k) is int else 0 for k in keys]
    hashes = mix64(np.array(whole, np.int64).astype(np.uint64))
    for i, k in enumerate(keys):
        if type(k) is not int:
            hashes[i] = xxhash.xxh3_64_intdigest(repr(k).encode("utf-8", "surrogatepass"), 7)
    return hashes


class Shard:
    """One shard in memory: keyed access to the ids of its documents."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, hash_function: PerfectHash, slots: np.ndarray):
        self.ids, self.offsets, self.hash_function, self.table = ids, offsets, hash_function, slots

    @classmethod
    def build(cls, keys: list, ids: np.ndarray, lengths: list[int]) -> Shard:
        """``keys`` ascend; equal ones stand side by side."""
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64)
        first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        hashes = key_hashes([keys[i] for i in first])
        function = PerfectHash.build(hashes)
        slots = np.zeros(len(first), _SLOT)
        at = function.slots(hashes)
        slots["fingerprint"][at] = (hashes >> np.uint64(32)).astype(np.uint32)
        slots["first"][at] = first
        slots["repeats"][at] = np.diff([*first, len(keys)])
        return cls(ids, offsets, function, slots)

    def places(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; none for keys it lacks."""
        hashes = key_hashes(keys)
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        found = self.table[self.hash_function.slots(hashes)]
        known = found["fingerprint"] == (hashes >> np.uint64(32)).astype(np.uint32)
        return found["first"].astype(np.int64), np.where(known, found["repeats"], 0).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]

    def get(self, key) -> list[np.ndarray]:
        """Ids of every document of a key."""
        first, n = self.places([key])
        return [self.document(i) for i in range(first[0], first[0] + n[0])]


def shard_schema(kind: str) -> str:
    return f"part int, seq int, format int, width int, n_ids long, first_key {kind}, last_key {kind}, keys array<{kind}>, offsets binary, pilots binary, slots binary, ids binary"


def encode_ids(docs: DataFrame, load: Callable, end_id: int, width: int, bounds: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, part, ids binary)``: ids of each text and the end id, raw
    little-endian, and the range of ``bounds`` that the id falls in.

    ``load`` gives, once a Python process, a function from texts to the raw ids.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_ids = load()
        for batch in batches:
            raw = [x + end for part in slices(batch.column(1).to_pylist()) for x in raw_ids(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "ids"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids binary")
    return out.select(F.col("id").alias(id_col), range_of(F.col("id"), bounds).alias("part"), "ids")


def write_shards(encoded: DataFrame, path: str, width: int, parts: int, id_col: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of ``(id, part, ids)`` in ascending order of the id.

    Each range of ids is one task, so the ids move once and are stored once.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = -1, 0
        keys, payload, lengths, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = b"".join(payload)
            made = Shard.build(keys, np.frombuffer(data, f"<u{width}"), lengths)
            row = [part, seq, FORMAT, width, size, keys[0], keys[-1], keys, made.offsets.tobytes(), made.hash_function.pilots.tobytes(), made.table.tobytes(), data]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), key_type, key_type, pa.list_(key_type), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "seq", "format", "width", "n_ids", "first_key", "last_key", "keys", "offsets", "pilots", "slots", "ids"])

        for batch in batches:
            for key, of, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if keys and (of != part or size >= shard_ids):
                    yield shard()
                    keys, payload, lengths, size = [], [], [], 0
                    seq += 1
                if of != part:
                    part, seq = of, 0
                keys.append(key)
                payload.append(ids)
                lengths.append(len(ids) // width)
                size += lengths[-1]
        if keys:
            yield shard()

    dealt = encoded.select(id_col, "part", "ids").repartitionById(parts, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", F.col(id_col).asc_nulls_first(), "ids")
    # raw ids repeat nothing that a dictionary of whole values could save
    ordered.mapInArrow(run, shard_schema(kind)).write.option("parquet.block.row.count.limit", GROUP_SHARDS).option("parquet.enable.dictionary", "false").parquet(path)


def open_shards(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(shard_schema(kind)).parquet(path)


def shard_of_row(row: dict) -> Shard:
    if row["format"] != FORMAT:
        raise ValueError(f"shard format {row['format']}, expected {FORMAT}")
    slots = np.frombuffer(row["slots"], _SLOT)
    function = PerfectHash(len(slots), np.frombuffer(row["pilots"], np.int64))
    return Shard(np.frombuffer(row["ids"], f"<u{row['width']}"), np.frombuffer(row["offsets"], np.int64), function, slots)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``(part, seq, base)``: ids before each shard.

    Reads three small columns.  Totals are summed by part first, so the ordered
    window sees one row for each part of the write, and each part its shards.
    """
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, got through the index.

    ``start`` counts the ids of all documents before it.
    """
    kind = shards.schema["first_key"].dataType.simpleString()
    bounded_batches(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                shard, keys = shard_of_row(row), row["keys"]
                distinct = list(dict.fromkeys(keys))
                first, repeats = shard.places(distinct)
                out, offset, count, crc = [], [], [], []
                for key, f, n in zip(distinct, first.tolist(), repeats.tolist(), strict=True):
                    for d in range(f, f + n):
                        ids = shard.document(d)
                        out.append(key)
                        offset.append(int(shard.offsets[d]))
                        count.append(len(ids))
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(out, batch.schema.field("first_key").type), pa.array(offset, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "id", "offset", "n_tokens", "ids_crc32"],
                )

    found = shards.mapInArrow(run, f"part int, seq int, id {kind}, offset long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(shards), ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


class PieceEncoder:
    """A ``tokenizers`` tokenizer that encodes each distinct pre-token once.

    That holds for tokenizers whose pre-tokens ``pattern`` yields and that have
    no normaliser.  A text that holds the string of an added token is left to
    the library whole.
    """

    #: New pre-tokens encoded as one text.
    JOINED = 4000

    def __init__(self, path: str, pattern: str, width: int, keys: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes whole wherever they stand in a text.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.normalizer is not None:
            raise ValueError("a normaliser changes texts before they are split")
        self.type = np.dtype(f"<u{width}")
        self.table = PieceTable(piece_finder(pattern), self._learn, self.type, keys)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pre-tokens, and how many each has."""
        lengths = np.zeros(len(pieces), np.int64)
        joined, alone = [], []
        for i, piece in enumerate(pieces):
            # a space and letters: such pieces stay apart when they stand in one text
            (joined if piece[0] == " " and piece[1:].isalpha() else alone).append(i)
        parts, order = [], []
        for at in range(0, len(joined), self.JOINED):
            run = joined[at : at + self.JOINED]
            (got,) = self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in run])], add_special_tokens=False)
            ids = np.array(got.ids, self.type)
            begins = np.flatnonzero(self.spaced[ids])  # pieces have their one space in front
            if len(begins) != len(run):  # the tokenizer split them otherwise
                alone += run
                continue
            parts.append(ids)
            order += run
            lengths[run] = np.diff(begins, append=len(ids))
        got = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        parts.append(np.fromiter(chain.from_iterable(got), self.type))
        order += alone
        lengths[alone] = [len(x) for x in got]
        flat = np.concatenate(parts)
        # from the order of encoding to that of the pieces
        sizes = lengths[order]
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(sizes) - sizes
        upto = np.cumsum(lengths) - lengths
        return flat[np.repeat(start - upto, lengths) + np.arange(len(flat))], lengths

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Raw ids of each text."""
        whole = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        ids, ends = self.table.encode([None if i in whole else t for i, t in enumerate(texts)])
        data, at = ids.tobytes(), 0
        for i, end in enumerate(ends):
            if i in whole:  # added tokens split a text before its pre-tokens do
                yield np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.type).tobytes()
            else:
                yield data[at * self.type.itemsize : end * self.type.itemsize]
            at = end


_loaded: dict[tuple, PieceEncoder] = {}


def piece_encoder(path: str, pattern: str, width: int) -> PieceEncoder:
    """Loaded once a Python process."""
    if (path, pattern, width) not in _loaded:
        _loaded[path, pattern, width] = PieceEncoder(path, pattern, width)
    return _loaded[path, pattern, width]


def tokenize_to_files(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, width: int = 2, path: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes the shards under ``path`` (scratch if none) and opens them."""
    spark = docs.sparkSession
    parts = ranges_for(docs)
    bounds = range_bounds(docs, "doc_id", parts)
    path = path or scratch_path(spark, "shards")
    write_shards(encode_ids(docs, lambda: piece_encoder(tokenizer, pattern, width), end_id, width, bounds), path, width, parts)
    return open_shards(spark, path, docs.schema["doc_id"].dataType.simpleString())
