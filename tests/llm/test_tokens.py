"""Byte-level BPE and token-id files, against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkgram.llm import bpe, token_files
from sparkgram.llm.common import piece_finder

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=80) | st.text(alphabet="ab 's\n\t1é漢", max_size=60))
def test_encoder_equals_the_library(text):
    enc = bpe.encoder(RANKS, P.PATTERN)
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    ids = enc.encode(text)
    assert ids == public.encode_ordinary(text)
    assert enc.decode(ids) == text.encode()


def test_long_pieces_and_batches(public):
    enc = bpe.encoder(RANKS, P.PATTERN)
    random.seed(5)
    texts = ["ab" * 40000, "".join(random.choice("abcdé") for _ in range(30000)), None, "", " " * 999 + "x"]
    assert list(enc.encode_batch(texts)) == [public.encode_ordinary(t or "") for t in texts]


def test_merge_follows_any_rank_order():
    """Ranks where a late token's merge is early: the queue must step back."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"cd": 310, b"ab": 320, b"abcd": 280}
    enc = bpe.BytePairEncoder(ranks, r"\S+")

    def plain(piece):
        part = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            options = [(ranks[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in ranks]
            if not options:
                return tuple(ranks[p] for p in part)
            _, i = min(options)
            part[i : i + 2] = [part[i] + part[i + 1]]

    random.seed(2)
    pieces = ["".join(random.choice("abcd") for _ in range(random.randint(2, 40))).encode() for _ in range(300)]
    assert enc.merge(pieces) == [plain(p) for p in pieces]


def test_rank_queue():
    q = bpe.RankQueue(50000)
    assert q.lowest() == -1
    for rank in (49999, 64, 4096, 63):
        q.open(rank, [rank])
    got = []
    while (r := q.lowest()) >= 0:
        got.append(r)
        assert q.take(r) == [r]
    assert got == [63, 64, 4096, 49999]


def test_narrow_finder_equals_the_general_one():
    import regex

    general, fast = regex.compile(P.PATTERN).findall, piece_finder(P.PATTERN)
    random.seed(4)
    for _ in range(500):
        text = "".join(chr(random.randrange(256)) for _ in range(40))
        assert fast(text) == general(text)


def test_digests(spark, odd, empty, public):
    got = bpe.token_digests(odd, RANKS, P.PATTERN).collect()
    want = sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), hashlib.sha256(",".join(map(str, public.encode_ordinary(r.text or ""))).encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.decoded_sha256, r.ids_sha256) for r in got) == want
    assert bpe.token_digests(empty, RANKS, P.PATTERN).collect() == []
    ids = bpe.encode_documents(odd, RANKS, P.PATTERN)
    back = {r.bytes.decode() for r in bpe.decode_documents(ids, RANKS, P.PATTERN).collect()}
    assert back == {t or "" for t in [*ODD_TEXTS, "no id at all"]}


def _brute(rows):
    t = Tokenizer.from_file(JSON)
    keyed = []
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u2")
        keyed.append(((r.doc_id is not None, r.doc_id or 0), ids.tobytes(), r.doc_id))
    out, at = [], 0
    for _, raw, key in sorted(keyed, key=lambda x: (x[0], x[1])):
        ids = np.frombuffer(raw, "<u2")
        out.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    return out


def test_files_equal_brute_force(spark, odd, empty, tmp_path):
    shards = token_files.tokenize_to_files(odd, JSON, P.PATTERN, path=str(tmp_path / "shards"))
    got = [tuple(r) for r in token_files.read_documents(shards).orderBy("start").collect()]
    assert got == _brute(odd.collect())
    assert token_files.read_documents(token_files.tokenize_to_files(empty, JSON, P.PATTERN)).collect() == []


def test_query_over_a_table(spark, tmp_path, tables):
    import __spark_entry__ as e

    rows = spark.createDataFrame([(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)], "doc_id long, text string")
    path = tables(spark, tmp_path / "t", documents=rows.repartition(5))
    got = sorted(map(tuple, e.queries()["op5_token_files"](spark, path).collect()), key=lambda r: r[1])
    assert got == _brute(rows.collect())


def test_strings_of_added_tokens_are_the_librarys(spark):
    enc = token_files.PieceEncoder(JSON, P.PATTERN, 2)
    special = enc.added[0]
    texts = [f"hi {special} there", special, f"{special}{special} x", f"a{special[:-1]} b", "plain words", None]
    public = Tokenizer.from_file(JSON)
    want = [public.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert public.token_to_id(special) in want[0]
    assert [np.frombuffer(raw, "<u2").tolist() for raw in enc(texts)] == want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, token_files.read_documents(token_files.tokenize_to_files(docs, JSON, P.PATTERN)).collect()))
    assert got == _brute(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 4000])
def test_perfect_hash_is_minimal(n):
    hashes = token_files.key_hashes(list(range(n))) if n else np.zeros(0, np.uint64)
    function = token_files.PerfectHash.build(hashes)
    if n:
        assert sorted(function.slots(hashes).tolist()) == list(range(n))


def test_shard_lookup():
    shard = token_files.Shard.build([None, 2, 2, 5], np.arange(11), [1, 3, 5, 2])
    assert [x.tolist() for x in shard.get(2)] == [[1, 2, 3], [4, 5, 6, 7, 8]]
    assert [x.tolist() for x in shard.get(None)] == [[0]]
    assert [x.tolist() for x in shard.get(5)] == [[9, 10]]
    assert sum(bool(shard.get(k)) for k in range(10_000, 30_000)) <= 1  # fingerprints tell strangers apart
    assert [x.tolist() for x in token_files.Shard.build(["a", "b"], np.arange(3), [1, 2]).get("b")] == [[1, 2]]


def test_encoders_start_over_when_full(public):
    enc = token_files.PieceEncoder(JSON, P.PATTERN, 2, keys=5)
    own = bpe.BytePairEncoder(bpe.read_ranks(RANKS), P.PATTERN, keys=5)
    for text in ("a b c d e f g h", "i j k", "a b z \n\n  q"):
        assert next(enc([text])) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        assert own.encode(text) == public.encode_ordinary(text)
