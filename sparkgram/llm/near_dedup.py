"""Near-duplicate detection with b-bit MinHash.

1. Each text becomes a set of word shingles and a signature of ``PERMUTATIONS``
   minima.  Runs of ``ROWS`` minima make band keys; of each minimum ``BITS`` low
   bits are kept and packed into bit planes.  Texts with equal sets are one
   class, represented by its least id, before anything is compared.
2. In every bucket of equal band keys each member is a candidate with the
   bucket's least member only: as many candidates as members.
3. A candidate must pass the sizes (100 times the smaller >= 75 times the
   larger), then the packed signatures: agreeing places are counted with xor,
   or and bit counts, and the similarity is corrected for chance collisions,
   J = (m - c) / (1 - c), c = 2^-BITS.  What is at least ``FLOOR`` (more than
   five standard deviations under the threshold) is confirmed on the full sets.
4. Links make components.  A bucket whose members are all in one component is
   finished.  The members of the others get signatures of ``LONG`` minima, whose
   estimates are far sharper, and their sets are kept at hand.
5. ``PIVOT_ROUNDS`` times each open bucket names a member by hash, and members of
   other components are its candidates; new links merge components.  That is
   linear too, and leaves little.
6. What is left is compared in full: members outside the pivot's component with
   all members of other components, by bit counts, in blocks of ``BLOCK`` so that
   no task holds a whole bucket; survivors are confirmed on the full sets.  Thus
   every pair that shares a band is compared or already joined, and no bucket or
   partner list is capped.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 < 1e-5.

Defined cases: a text without words has the empty set and is linked with
nothing; with fewer than five words the whole sequence is its one shingle;
rows with the same id are one document; rows with a null id are never linked;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import WordHashes, bounded_batches, cut, mix64, release, shingle_hashes
from sparkgram.llm.components import connected_components

WIDTH = 5
PERMUTATIONS, ROWS, BITS = 128, 4, 2
BANDS = PERMUTATIONS // ROWS
#: A link has 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
#: Least corrected similarity of signatures that is confirmed on the sets.
FLOOR = 0.5
#: Members of a bucket that a block holds.
BLOCK = 512
#: Minima of the long signatures, and the least similarity that they let pass:
#: more than four standard deviations under the threshold.
LONG, LONG_FLOOR = 1024, 0.68
PIVOT_ROUNDS = 2
#: Most numbers in the filter that keeps texts out of a shuffle; 2 MB.
ID_BUCKETS = 1 << 18

_MULTIPLIERS = mix64(np.arange(1, LONG + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix64(np.arange(1, LONG + 1, dtype=np.uint64) << np.uint64(32))
_BAND_KEYS = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(977))
_PLACE_KEYS = mix64(np.arange(ROWS, dtype=np.uint64) + np.uint64(7919)) | np.uint64(1)
#: Hash values computed at once.
_RUN = 1 << 17


def minima(hashes: np.ndarray, functions: int = PERMUTATIONS) -> np.ndarray:
    """The least value of each of the first ``functions`` hash functions over the shingles."""
    least = None
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _RUN // functions):
            values = np.multiply.outer(_MULTIPLIERS[:functions], hashes[at : at + _RUN // functions])
            values += _OFFSETS[:functions, None]
            part = values.min(axis=1)
            least = part if least is None else np.minimum(least, part)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    with np.errstate(over="ignore"):
        rows = (mix64(least.reshape(BANDS, ROWS)) * _PLACE_KEYS).sum(axis=1, dtype=np.uint64)
    return mix64(rows ^ _BAND_KEYS).view(np.int64)


def packed(least: np.ndarray) -> list[int]:
    """BITS planes with a bit for each minimum, each plane in 64-bit words."""
    low = mix64(least)
    out: list[int] = []
    for plane in range(BITS):
        bits = ((low >> np.uint64(plane)) & np.uint64(1)).astype(np.uint8)
        out += np.packbits(bits, bitorder="little").view(np.int64).tolist()
    return out


_WORDS = BITS * PERMUTATIONS // 64
_PLANES = [f"s{i}" for i in range(_WORDS)]
_LONG_PLANES = [f"l{i}" for i in range(BITS * LONG // 64)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, k0, k1, s0.., bands)``: the set's size, a 128-bit digest
    of the set, the packed signature and the band keys; nulls for an empty set."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_shingles", "k0", "k1", *_PLANES, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = shingle_hashes(value.as_py(), hashes, WIDTH)
                if not len(s):
                    rows.append([0] + [None] * (3 + _WORDS))
                    continue
                least = minima(s)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                rows.append([len(s), *digest, *packed(least), band_keys(least)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (4 + _WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.list_(pa.int64()))], names=names)

    ddl = f"id {kind}, n_shingles long, k0 long, k1 long, {', '.join(f'{s} long' for s in _PLANES)}, bands array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, ddl)


def _similarity(a: str, b: str, planes: list[str]) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    per_plane = len(planes) // BITS
    unlike = None
    for word in range(per_plane):
        differs = None
        for plane in range(BITS):
            s = planes[plane * per_plane + word]
            x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
            differs = x if differs is None else differs.bitwiseOR(x)
        n = F.bit_count(differs)
        unlike = n if unlike is None else unlike + n
    c = 2.0**-BITS
    return ((1 - unlike / F.lit(64.0 * per_plane)) - c) / (1 - c)


def _may_link(a: str, b: str, planes: list[str] = _PLANES, floor: float = FLOOR) -> Column:
    """Whether sizes and signatures allow a link."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (_similarity(a, b, planes) >= floor)


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` (_id, ..) without most rows whose ``_id`` is not in ``ids`` (id).

    Ids are hashed to ID_BUCKETS buckets, and the buckets in use are broadcast:
    at most that many numbers, whatever the data.  It spares the texts that no
    later join needs their shuffle; where all buckets are in use it spares none.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    used = ids.select(bucket("id").alias("_used")).distinct()
    return texts.join(F.broadcast(used), bucket("_id") == F.col("_used"), "left_semi")


def confirmed(candidates: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The candidates (a, b) whose full shingle sets are similar enough.

    Texts travel, not sets: they are half as large.  Both joins read the same
    exchange of the texts; a hot ``a`` is on the side that AQE can split.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    texts = _of_ids(texts, candidates.select(F.explode(F.array("a", "b")).alias("id")))
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b"))
    pairs = candidates.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    kind = candidates.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, of_last = WordHashes(), None, None
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_a != last or of_last is None:
                    last, of_last = text_a, shingle_hashes(text_a, hashes, WIDTH)
                other = shingle_hashes(text_b, hashes, WIDTH)
                common = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(common > 0 and 100 * common >= PERCENT * (len(of_last) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    found = cut(signatures(docs, id_col, text_col), "signatures")

    # classes of equal sets
    sets = found.where("k0 IS NOT NULL AND id IS NOT NULL")
    values = [F.first(c).alias(c) for c in ("n_shingles", *_PLANES, "bands")]
    classes = cut(sets.groupBy("k0", "k1").agg(F.min("id").alias("id"), *values), "classes")
    nodes = classes.select("id", "n_shingles", *_PLANES)

    # buckets and their least members
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # a rebalancing step between the aggregate and the join lets AQE split a hot bucket in the join
    buckets = buckets.select("key", "least").hint("rebalance")
    placed = cut(members.join(buckets, "key"), "placed")

    star = placed.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    candidates = cut(_filtered(star, nodes), "candidates")
    links = cut(confirmed(candidates, docs, id_col, text_col), "links")
    release(candidates)
    roots = connected_components(links)

    links, roots = _between_components(placed, links, roots, docs, id_col, text_col)

    of_class = _with_root(classes.select("k0", "k1", "id"), roots, "id", "component_id").select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), "component_id")
    of_class = cut(of_class, "of_class")
    release(placed, classes)
    rows = found.select("id", "n_shingles", "k0", "k1")
    out = rows.join(of_class, (rows.k0 == of_class._k0) & (rows.k1 == of_class._k1), "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _with_root(rows: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the root of ``key`` as ``name``: itself where it has no smaller one."""
    r = roots.select(F.col("id").alias("_vertex"), F.col("root").alias("_root"))
    return rows.join(r, rows[key] == r._vertex, "left").withColumn(name, F.coalesce("_root", key)).drop("_vertex", "_root")


def _filtered(pairs: DataFrame, nodes: DataFrame, planes: list[str] = _PLANES, floor: float = FLOOR) -> DataFrame:
    """The pairs (a, b) that sizes and signatures let pass.

    No aggregate follows the join in its stage, so AQE may split a hot ``a``.
    """
    joined = pairs.alias("p").join(nodes.alias("x"), F.col("p.b") == F.col("x.id")).join(nodes.alias("y"), F.col("p.a") == F.col("y.id"))
    return joined.where(_may_link("x", "y", planes, floor)).select("p.a", "p.b")


def _between_components(placed: DataFrame, links: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links between components whose members share a bucket: steps 4 to 6."""
    members = _open_members(placed, roots, 0)
    if not members.limit(1).count():
        return links, roots
    ids = cut(members.select("id").distinct(), "ids")
    at_hand = cut(_long_signatures(docs, ids, id_col, text_col), "long")
    nodes, sets = at_hand.drop("shingles"), at_hand.select("id", "n_shingles", "shingles")
    for turn in range(PIVOT_ROUNDS):
        to_pivot = members.where("root <> pivot_root").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        new = cut(_exact(cut(_filtered(to_pivot, nodes.drop("bands"), _LONG_PLANES, LONG_FLOOR), "pivots"), sets), "links")
        if new.limit(1).count():
            links = links.unionByName(new)
            roots = connected_components(links)
        members = _open_members(placed, roots, turn + 1)
    new = cut(_exact(cut(_across(members, nodes), "rest"), sets), "links")
    release(at_hand, ids)
    if new.limit(1).count():
        links = links.unionByName(new)
        roots = connected_components(links)
    return links, roots


def _open_members(placed: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """``(key, id, root, pivot, pivot_root, n)`` of the buckets with several components."""
    rooted = cut(_with_root(placed.select("key", "id"), roots, "id", "root"), "rooted")
    by_hash = F.xxhash64("id", "key", F.lit(turn))
    pivot = F.min(F.struct(by_hash.alias("h"), "id", "root")).alias("pivot")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pivot, F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.root").alias("pivot_root"), "n").hint("rebalance")
    return cut(rooted.join(mixed, "key"), "open")


def _long_signatures(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, l0.., bands, shingles)`` of the documents in ``ids``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_shingles", *_LONG_PLANES, "bands", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(text, hashes, WIDTH)
                if len(s):
                    keys.append(key)
                    least = minima(s, LONG)
                    rows.append([len(s), *packed(least), band_keys(least[:PERMUTATIONS]), s.view(np.int64)])
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[:-2]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[-2:])], names=names)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = _of_ids(texts, ids).join(ids, F.col("_id") == F.col("id"), "left_semi")
    return texts.mapInArrow(run, f"id {kind}, n_shingles long, {', '.join(f'{s} long' for s in _LONG_PLANES)}, bands array<long>, shingles array<long>")


def _exact(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) whose sets, which are at hand, are similar enough."""
    pairs = candidates.alias("p").join(sets.alias("y"), F.col("p.b") == F.col("y.id")).join(sets.alias("x"), F.col("p.a") == F.col("x.id"))
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return pairs.where(common * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - common) * PERCENT).select("p.a", "p.b")


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates between components within the buckets of ``members``.

    The minor side are the members outside the component of the bucket's pivot.
    A pair that shares several bands comes up in the first of them only.
    """
    minor = members.where("root <> pivot_root")
    counted = minor.groupBy("key").agg(F.count("*").alias("n_minor")).hint("rebalance")
    rows = members.join(counted, "key").join(nodes.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n")).drop("_n")
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    x = rows.where("root <> pivot_root").withColumn("i", own("n_minor")).withColumn("j", upto("n")).alias("x")
    y = rows.withColumn("j", own("n")).withColumn("i", upto("n_minor")).alias("y")
    same_block = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("y.root") == F.col("y.pivot_root")) | (F.col("x.id") < F.col("y.id"))
    shared = F.zip_with("x.bands", "y.bands", lambda p, q: p == q)
    first = F.array_position(shared, True) == F.array_position(F.col("x.bands"), F.col("x.key"))
    pairs = x.join(y, same_block & (F.col("x.root") != F.col("y.root")) & once & _may_link("x", "y", _LONG_PLANES, LONG_FLOOR) & first)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    Rows with a null id stay.  Where ids repeat, rows are compared by a key of
    their own: of linked rows the first as stored stays, and rows that share
    nothing but their id all stay.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n"))
    key = id_col
    if ids.where("_n > 1").limit(1).count():
        key = "_dedup_row"
        docs = cut(docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "keyed")
    verdict = near_duplicates(docs, key, text_col).where("NOT kept").select(F.col(key).alias("_dropped"))
    kept = docs.join(cut(verdict, "dropped"), docs[key] == F.col("_dropped"), "left_anti")
    return kept.drop("_dedup_row") if key != id_col else kept
