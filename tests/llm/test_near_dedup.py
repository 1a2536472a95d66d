"""MinHash near-dedup, components and fingerprints, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sparkgram.llm import fingerprints, near_dedup
from sparkgram.llm.common import WordHashes, shingle_hashes
from sparkgram.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{id: (sizes, component)} by comparing all pairs; rows of one id are one document."""
    sets = {}
    for key, text in rows:
        if key is not None:
            sets.setdefault(key, []).append(shingles(text))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {k: find(k) for k in keys}


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            rows.append(" ".join(edit(rng, base, rng.choice([0, 1, 1, 2, 3, 6]))))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_shingles == len(shingles(t)) and got[k].kept == (want[k] == k) for k, t in rows)
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({*want.values()})


def test_loose_cluster_needs_every_round(spark, monkeypatch):
    """Copies of one text edited so much that many link to some others only, in tiny blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(edit(rng, base, rng.choice([1, 2, 4, 6, 8])))) for i in range(90)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty).collect() == []
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({*want.values()})
    assert ids.count(None) == 1
    assert near_dedup.drop_near_duplicates(empty).collect() == []


def test_rows_that_share_an_id_are_told_apart(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, "a text of its own with enough words"), (1, "another one that shares nothing with it at all"), (2, " ".join(near)), (2, " ".join([*near[:-1], "x"])), (3, " ".join(near)), (None, " ".join(near)), (4, ""), (4, None)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[i] for i in (0, 1, 2, 5, 6, 7)], "doc_id long, text string").collect()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(100, 200)] + [(500, 500), (7, 3), (7, 3)]
    rng.shuffle(edges)
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 61), 0) | dict.fromkeys(range(101, 201), 100)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signature_estimates(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:2400]), np.unique(pool[800:3200])  # similarity 0.5
    same = [near_dedup.packed(near_dedup.minima(x, near_dedup.LONG)) for x in (a, b)]
    words = len(same[0]) // 2
    unlike = sum(((same[0][w] ^ same[1][w]) | (same[0][w + words] ^ same[1][w + words])).__and__(2**64 - 1).bit_count() for w in range(words))
    estimate = ((1 - unlike / near_dedup.LONG) - 0.25) / 0.75
    assert abs(estimate - 0.5) < 0.08


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_fingerprints_beside_the_next(spark, odd, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "ranges_for", lambda docs: ranges)
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in odd.collect()] + corpus()[:40] + [(40, "a tie"), (40, "tie b")], "doc_id long, text string")
    got = fingerprints.compare_with_next(rows.repartition(3)).collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = []
    for i, (key, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(shingles(text), shingles(changed)), likeness(shingles(text), shingles(following))))
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(str(w[:3]) for w in want)
    exact = {w[:3]: w[3:] for w in want}
    for r in got:
        near_edited, near_next = exact[r.doc_id, r.n_chars, r.edited_sha256]
        assert abs(r.near_edited - near_edited) < 0.15
        assert 0 <= r.near_next <= 1
        assert abs(r.near_next - near_next) < 0.15
    by_text = {}
    make = fingerprints.Fingerprinter()
    for r in rows.collect():
        by_text.setdefault(r.text or "", set()).add(make(r.text))
    assert all(len(v) == 1 for v in by_text.values())


def test_bins_and_densification_equal_a_plain_reading():
    def mixed(x):  # the splitmix64 finaliser on Python's integers
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    rng = random.Random(5)
    for size in (1, 2, 7, 100, 600, 5000):
        hashes = sorted({rng.randrange(2**64) for _ in range(size)})
        bins = {}
        for h in hashes:
            bins[h >> 55] = min(h, bins.get(h >> 55, h))
        want = []
        for i in range(512):
            source, attempt = i, 0
            while source not in bins:
                source, attempt = mixed(i << 32 ^ attempt) >> 55, attempt + 1
            want.append(bins[source])
        got = fingerprints.bin_minima(np.array(hashes, np.uint64))
        assert got.tolist() == want
        low = [mixed(h ^ mixed(i)) % 16 for i, h in enumerate(want)]
        packed = fingerprints.pack(got)
        assert [x for byte in packed for x in (byte >> 4, byte & 15)] == low
        agree = sum(a == b for a, b in zip(low, [3] * 512, strict=True))
        other = bytes([3 << 4 | 3] * 256)
        assert fingerprints.likeness(packed, other) == pytest.approx(max(0.0, (agree / 512 - 1 / 16) / (15 / 16)))


def test_one_row_is_its_own_next(spark, empty):
    (r,) = fingerprints.compare_with_next(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0
    assert fingerprints.compare_with_next(empty).collect() == []
    assert {r.fingerprint for r in fingerprints.fingerprint_documents(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect()} == {""}


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_fingerprint_is_unbiased(share):
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(40):
        pool = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
        k = int(len(pool) * (1 - share) / 2)
        a, b = pool[: len(pool) - k], pool[k:]
        rng.shuffle(pool)
        a, b = np.sort(pool[: len(pool) - k]), np.sort(pool[k:])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(fingerprints.likeness(fingerprints.pack(fingerprints.bin_minima(a)), fingerprints.pack(fingerprints.bin_minima(b))) - true)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.05


def test_shingle_rules():
    h = WordHashes()
    assert len(shingle_hashes("A b C d e", h)) == 1
    assert (shingle_hashes("A b C d e", h) == shingle_hashes("a B c D E", h)).all()
    assert len(shingle_hashes("a b", h)) == 1
    assert len(shingle_hashes("   ", h)) == 1  # a no-break space is a word
    assert len(shingle_hashes(None, h)) == 0
    assert len(shingle_hashes("É é", h)) == 1
    assert (shingle_hashes("É", h) != shingle_hashes("é", h)).all()  # only A-Z is lowered
