"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Encoding merges, again and again, the adjacent pair of lowest rank (the
leftmost among equals).  Here the pending pairs wait in one bucket per merge
rank.  A three-level bitmap over the ranks tells in three find-first-set steps
which bucket is the lowest that is not empty; the buckets hold positions of a
doubly linked list over the symbols.  A merge makes up to two new pairs and
leaves the old ones in their buckets: an entry whose pair has changed since is
stale and skipped when it comes up.  So a pre-token of n bytes costs O(n log n)
however long it is, where rescanning for the minimum costs O(n^2).

Defined cases: a null or empty text has no ids and decodes to no bytes; bytes
outside the vocabulary cannot occur, since every single byte is a token of it
(checked when the ranks are read); rows are independent, so repeated rows,
ties and extra columns do not matter; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgram.llm.common import PIECES, PieceTable, bounded_batches, piece_finder


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one ``base64(token) rank`` a line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not every single byte is a token")
    return ranks


class RankQueue:
    """Pending positions in buckets by small integer rank.

    Bit r of the lowest level says that bucket r is in use; a bit of the levels
    above says that the 64 bits it stands for are not all zero.
    """

    def __init__(self, ranks: int):
        self.leaf = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.leaf) // 64 + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Puts a whole bucket in; the rank has none yet."""
        self.bucket[rank] = positions
        word = rank >> 6
        self.leaf[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def lowest(self) -> int:
        """The lowest rank in use by three find-first-set steps, or -1."""
        if not self.top:
            return -1
        m = (self.top & -self.top).bit_length() - 1
        w = self.mid[m]
        w = (m << 6) + (w & -w).bit_length() - 1
        leaf = self.leaf[w]
        return (w << 6) + (leaf & -leaf).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Takes the bucket of ``rank`` out, positions ascending."""
        word = rank >> 6
        self.leaf[word] ^= 1 << (rank & 63)
        if not self.leaf[word]:
            self.mid[word >> 6] ^= 1 << (word & 63)
            if not self.mid[word >> 6]:
                self.top ^= 1 << (word >> 6)
        positions = self.bucket.pop(rank)
        positions.sort()
        return positions


class BytePairEncoder:
    """Encodes and decodes with one rank table; pre-tokens come from ``pattern``."""

    #: Bytes of new pre-tokens merged in one run of the queue.
    RUN_BYTES = 1 << 20

    def __init__(self, ranks: dict[bytes, int], pattern: str, keys: int = PIECES):
        self.ranks = ranks
        self.table = PieceTable(piece_finder(pattern), self._learn, "<u4", keys)
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.queue = RankQueue(size)
        #: Ranks of the pairs of single bytes, or -1.
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens.

        All of them lie in one list of symbols, with no links between two
        pre-tokens, so that one run of the queue serves them together: what
        happens to one never depends on the others.
        """
        ranks, queue = self.ranks, self.queue
        rank_of, bucket, lowest = ranks.get, queue.bucket, queue.lowest
        text = b"".join(pieces)
        n = len(text)
        part = [text[i : i + 1] for i in range(n)]  # empty once merged into the left neighbour
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        starts, at = [], 0
        for piece in pieces:
            starts.append(at)
            before[at] = -1
            at += len(piece)
            after[at - 1] = n
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        first = self.pairs[raw[:-1] << 8 | raw[1:]]
        first[np.array(starts[1:], np.int64) - 1] = -1  # no pair spans two pre-tokens
        at_pair = np.argsort(first, kind="stable")
        at_pair = at_pair[np.searchsorted(first[at_pair], 0) :]
        kinds, begins = np.unique(first[at_pair], return_index=True)
        positions = at_pair.tolist()
        edges = [*begins.tolist(), len(positions)]
        for i, r in enumerate(kinds.tolist()):
            queue.open(r, positions[edges[i] : edges[i + 1]])
        part.append(b"")
        while (r := lowest()) >= 0:
            positions = queue.take(r)
            token = self.token[r]
            for done, i in enumerate(positions, 1):
                j = after[i]
                if j >= n or not part[i] or part[i] + part[j] != token:
                    continue  # stale: the pair has changed since it was queued
                part[i], part[j] = token, b""
                after[i] = k = after[j]
                lower = False
                if k < n:
                    before[k] = i
                    if (q := rank_of(token + part[k])) is not None:
                        lower = q < r
                        if q in bucket:
                            bucket[q].append(i)
                        else:
                            queue.open(q, [i])
                if (h := before[i]) >= 0 and (q := rank_of(part[h] + token)) is not None:
                    lower = lower or q < r
                    if q in bucket:
                        bucket[q].append(h)
                    else:
                        queue.open(q, [h])
                if lower:  # a rank below this one goes first
                    if rest := positions[done:]:
                        queue.open(r, rest) if r not in bucket else bucket[r].extend(rest)
                    break
        out = []
        starts.append(n)
        for s, e in zip(starts, starts[1:], strict=False):
            out.append(tuple([ranks[p] for p in part[s:e] if p]))
        return out

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pre-tokens, and how many each has."""
        raw = [piece.encode("utf-8") for piece in pieces]
        whole = list(map(self.ranks.get, raw))
        out: list[tuple[int, ...]] = [() if r is None else (r,) for r in whole]
        run, size = [], 0
        for i, r in enumerate(whole):
            if r is None:
                run.append(i)
                size += len(raw[i])
            if run and (size >= self.RUN_BYTES or i == len(raw) - 1):
                for j, ids in zip(run, self.merge([raw[j] for j in run]), strict=True):
                    out[j] = ids
                run, size = [], 0
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(lengths.sum())), lengths

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, without special tokens."""
        ids, ends = self.table.encode(texts)
        every, at = ids.tolist(), 0
        for end in ends:
            yield every[at:end]
            at = end

    def encode(self, text: str | None) -> list[int]:
        return next(iter(list(self.encode_batch([text]))))

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


def slices(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters, at least one text each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


_loaded: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file, loaded once a Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairEncoder(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            ids = pa.array([ids for run in slices(batch.column(1).to_pylist()) for ids in bpe.encode_batch(run)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes binary)`` for every row of ids."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and returns digests of both, one row a row.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the decoded bytes).  One pass, no shuffle, no ids moved.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        decimal, sha = bpe.decimal, hashlib.sha256
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for run in slices(batch.column(1).to_pylist()):
                for ids in bpe.encode_batch(run):
                    counts.append(len(ids))
                    of_ids.append(sha(",".join([decimal[i] for i in ids]).encode("ascii")).hexdigest())
                    of_bytes.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
