import random

import pytest
from pyspark.sql import functions as F

from sparkgram.functions.metric import METRICS, Jaccard, metric, register
from sparkgram.operators.index import SearchIndex
from sparkgram.operators.overlap import STRATEGIES, intersection, lower_bound, t_occurrence
from sparkgram.operators.ranking import dense_ids, running_totals, top_k, union_left_first
from sparkgram.operators.search import autocomplete, collected, fuzzy_join, fuzzy_top_k
from sparkgram.sources import dictionary
from sparkgram.sources.config import IndexDescription

CARS = ["Nissan March", "Nissan Juke", "Nissan Maxima", "Nissan Murano", "Nissan Note", "Toyota Mark II", "Toyota Corolla", "Toyota Corona"]
WIDE = IndexDescription("cars", 3, ("english", "russian", "numbers", "$"))


@pytest.fixture(scope="module")
def cars(spark):
    return SearchIndex.build(dictionary.from_words(spark, CARS), WIDE).cache()


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_fuzzy_goldens(spark, cars):
    got = fuzzy_top_k(cars, asked(spark, "Nissan ma"), metric("Jaccard", 0.5), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 0]
    assert [round(r.score, 4) for r in got] == [0.6923, 0.6154]
    narrow = SearchIndex.build(dictionary.from_words(spark, CARS), IndexDescription("x", 3, ("english", "$")))
    got = fuzzy_top_k(narrow, asked(spark, "niss ma"), metric("Cosine", 0.4), 5).orderBy("rank").collect()
    assert [r.value for r in got] == ["Nissan Maxima", "Nissan March"]


def test_autocomplete_goldens(spark, cars):
    got = autocomplete(cars, asked(spark, "Niss", "Mark", "N"), 5).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got if r.query_id == 0] == [0, 1, 2, 3, 4]
    assert [r.value for r in got if r.query_id == 1] == ["Toyota Mark II"]
    assert [r for r in got if r.query_id == 2] == []
    assert autocomplete(cars, asked(spark, "Niss"), 0).count() == 0


@pytest.mark.parametrize("name", list(METRICS))
@pytest.mark.parametrize("alpha", [0.3, 0.56, 0.8, 1.0])
def test_prefix_filter_changes_nothing(spark, cars, name, alpha):
    queries = asked(spark, "nissan marhc", "toyota", "corrola", "aaaa", "", "n")
    m = metric(name, alpha)
    plain = fuzzy_top_k(cars, queries, m, 3).orderBy("query_id", "rank").collect()
    assert plain == fuzzy_top_k(cars, queries, m, 3, prefix_filter=True).orderBy("query_id", "rank").collect()


def test_results_against_plain_python(spark, cars):
    import math

    def grams(s):
        s = ("$" + s + "$").lower().strip(" ")
        raw = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 3 else [s] if len(s.encode()) >= 3 else []
        return ["".join(c if c.isascii() and c.isalnum() or c == "$" else "$" for c in g) for g in raw]

    for query in ("nissan  note", "toyta corola", "murano"):
        a = grams(query)
        want = []
        for i, v in enumerate(CARS):
            b = grams(v)
            overlap = sum(g in set(b) for g in a)
            t = math.ceil(0.5 * math.sqrt(len(a) * len(b)))
            if 0 < t <= min(len(a), len(b)) and overlap >= t and math.ceil(0.25 * len(a)) <= len(b) <= math.floor(len(a) / 0.25):
                want.append((-(1 - (1 - overlap / math.sqrt(len(a) * len(b)))), i))
        got = fuzzy_top_k(cars, asked(spark, query), metric("Cosine", 0.5), 5).orderBy("rank").collect()
        assert [(r.doc_id, round(r.score, 12)) for r in got] == [(i, round(-s, 12)) for s, i in sorted(want)[:5]]


def test_repeated_values_fan_out_in_id_order(spark):
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(["red bolt", "red belt", "red bolt", "red bolt", None, "x"])], "doc_id long, value string")
    index = SearchIndex.build(docs, WIDE)
    got = fuzzy_top_k(index, asked(spark, "red bolt"), metric("Cosine", 0.4), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.value) for r in got] == [(0, "red bolt"), (2, "red bolt"), (3, "red bolt")]
    pairs = fuzzy_join(index, asked(spark, "red bolt"), metric("Exact", 1.0))
    assert sorted(r.doc_id for r in pairs.collect()) == [0, 2, 3]
    assert index.segments().agg(F.sum("n_docs")).first()[0] == 5


def test_bad_parameters():
    for alpha in (0, -1, 1.5, float("nan")):
        with pytest.raises(ValueError):
            metric("Cosine", alpha)
    with pytest.raises(ValueError):
        metric("cosine", 0.5)


L1 = [[1, 2, 3], [1, 2], [2, 3], [2]]
L2 = [[1, 2, 3, 5, 7, 10, 30, 50], [10, 11, 13, 16, 50, 60, 131], [40, 50, 60], [50, 100], [100, 200]]


def lists(spark, items):
    return spark.createDataFrame([(i, d) for i, ids in enumerate(items) for d in ids], "list_id long, doc_id long")


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize(
    ("items", "t", "want"),
    [
        (L1, 2, {1: 2, 3: 2, 2: 4}),
        (L1, 3, {2: 4}),
        (L1, 4, {2: 4}),
        (L1, 5, {}),
        (L1, 0, {}),
        (L2, 4, {50: 4}),
        (L2, 3, {50: 4}),
        (L2, 2, {10: 2, 60: 2, 100: 2, 50: 4}),
        (L2, 1, {**dict.fromkeys([1, 2, 3, 5, 7, 11, 13, 16, 30, 40, 131, 200], 1), 10: 2, 60: 2, 100: 2, 50: 4}),
    ],
)
def test_t_occurrence(spark, strategy, items, t, want):
    assert {r.doc_id: r.overlap for r in t_occurrence(lists(spark, items), t, strategy).collect()} == want


def test_intersection_and_lower_bound(spark):
    assert [r.doc_id for r in intersection(lists(spark, L1)).collect()] == [2]
    assert intersection(lists(spark, L2)).collect() == []
    assert [r.doc_id for r in intersection(lists(spark, [*L2[:4], [50, 100, 200]])).collect()] == [50]
    ids = [1, 13, 29, 101, 506, 10003, 10004, 12000, 12001]
    postings = spark.createDataFrame([("a", i) for i in ids], "term string, doc_id long")
    want = {1: 1, 2: 13, 12000: 12000, 12001: 12001, 0: 1, 12002: None}
    targets = spark.createDataFrame([("a", t) for t in want], "term string, target long")
    assert {r.target: r.doc_id for r in lower_bound(postings, targets).collect()} == want


def test_top_k_and_union(spark):
    pairs = [(1, 0.1), (2, 0.2), (3, 0.91), (4, 0.5), (5, 0.3), (6, 0.2), (7, 0.9), (8, 0.6), (9, 0.5), (10, 0.6565)]
    rows = spark.createDataFrame(pairs, "doc_id long, score double")
    assert [(r.doc_id, r.score) for r in top_k(rows, 3, [F.desc("score"), F.asc("doc_id")]).collect()] == [(3, 0.91), (7, 0.9), (10, 0.6565)]
    with pytest.raises(ValueError):
        top_k(rows, 0, [F.asc("doc_id")])
    a = spark.createDataFrame([(5, 0), (3, 1)], "doc_id long, pos int")
    b = spark.createDataFrame([(3, 0), (9, 1)], "doc_id long, pos int")
    assert [r.doc_id for r in union_left_first(a, b, "doc_id").orderBy("pos").collect()] == [5, 3, 9]
    got = dense_ids(rows, [F.desc("score"), F.asc("doc_id")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(10))
    assert [r.doc_id for r in got[:3]] == [3, 7, 10]


def test_index_round_trip(spark, cars, tmp_path):
    cars.save(str(tmp_path / "cars"))
    back = SearchIndex.load(spark, str(tmp_path / "cars"))
    query = asked(spark, "tayota corolla")
    m = metric("Cosine", 0.5)
    assert fuzzy_top_k(back, query, m, 3).collect() == fuzzy_top_k(cars, query, m, 3).collect()
    assert back.lengths().count() == cars.lengths().count()
    # the size filter prunes partitions of the stored postings
    plan = back.postings.where("card between 5 and 7")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_a_stored_index_is_replaced_whole(spark, cars, tmp_path):
    path = str(tmp_path / "cars")
    cars.save(path)
    opened = SearchIndex.load(spark, path)
    SearchIndex.build(dictionary.from_words(spark, ["Lada"]), cars.description).save(path)
    assert [r.value for r in SearchIndex.load(spark, path).docs.collect()] == ["Lada"]
    assert opened.docs.count() == cars.docs.count()  # plans of the version before still run
    # a version that was never finished doesn't count
    (tmp_path / "cars" / "versions" / "9" / "docs").mkdir(parents=True)
    assert [r.value for r in SearchIndex.load(spark, path).docs.collect()] == ["Lada"]
    with pytest.raises(ValueError, match="no index"):
        SearchIndex.load(spark, str(tmp_path / "nothing"))


def test_extension_points(spark, cars):
    def letters(rows, text_col, description, start, end):
        return rows.withColumn("grams", F.array_distinct(F.split(F.lower(text_col), "")))

    index = SearchIndex.build(dictionary.from_words(spark, ["abc", "abd", "xyz"]), cars.description, letters)
    assert [r.value for r in fuzzy_top_k(index, asked(spark, "cab"), metric("Jaccard", 0.9), 5).collect()] == ["abc"]
    by_size = fuzzy_top_k(index, asked(spark, "abdc"), metric("Jaccard", 0.4), 1, scorer=lambda i, a, b: F.lit(0.5) + i / 100)
    assert [r.score for r in by_size.collect()] == [0.53]
    counted = collected(index, asked(spark, "ab"), metric("Jaccard", 0.1), lambda rows: rows.groupBy("query_id").count())
    assert [r["count"] for r in counted.collect()] == [2]

    class Half(Jaccard):
        def score(self, i, a, b):
            return F.lit(0.5)

    register("Half", Half)
    try:
        assert {r.score for r in fuzzy_top_k(index, asked(spark, "abc"), metric("Half", 0.4), 5).collect()} == {0.5}
    finally:
        METRICS.pop("Half")


def test_running_totals_and_line_numbers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.randrange(-5, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = running_totals(df, [F.desc("k"), F.asc("i")], {"before": F.col("v"), "twice": F.col("v") * 2}, "n").orderBy("n").collect()
    total = 0
    for n, (want, r) in enumerate(zip(sorted(rows, key=lambda x: (-x[0], x[1])), got, strict=True)):
        assert (r.k, r.i, r.v, r.n, r.before, r.twice) == (*want, n, total, 2 * total)
        total += want[2]
    assert running_totals(df.limit(0), [F.asc("i")], count="n").collect() == []
    # one long file in many splits, and a second file
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("\n".join(lines[:2500]) + "\n", encoding="utf-8")
    (tmp_path / "lines" / "b.txt").write_text("\n".join(lines[2500:]), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        docs = dictionary.from_lines(spark, str(tmp_path / "lines"))
        assert [(r.doc_id, r.value) for r in docs.orderBy("doc_id").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\nb\n\nc\n", encoding="utf-8")
    docs = dictionary.from_lines(spark, str(tmp_path / "d.txt"))
    assert [(r.doc_id, r.value) for r in docs.orderBy("doc_id").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    keys = spark.createDataFrame([(1,), (9,)], "doc_id long")
    assert {r.doc_id: r.value for r in dictionary.lookup(docs, keys).collect()} == {1: "b", 9: "<nil/>"}
    dictionary.save(docs, str(tmp_path / "d"))
    assert dictionary.size(dictionary.load(spark, str(tmp_path / "d"))).first().size == 4


BATCHES = [f"search_{m}_batch_part" for m in ("cosine", "jaccard", "dice", "overlap", "exact")] + ["prefix_filter_batch_part", "autocomplete_batch_part"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """650 parts, 13 of them asked for, with repeated names and one that differs in case."""
    words = ("small", "smal", "blue", "red", "Ring", "rnig", "bolt", "anvil")
    rows = [(i, f"{words[i * 7 % 8]} {words[i // 9 % 8]}") for i in range(1, 651)]
    path = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return path, rows


@pytest.mark.parametrize("name", BATCHES)
def test_batch_searches_ask_for_every_fiftieth_part(spark, parts, name):
    import duckdb

    import __spark_entry__ as e

    path, rows = parts
    got = sorted(tuple(r) for r in e.queries()[name](spark, path).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{path}/part.parquet/*.parquet')")
        want = sorted(db.execute(e.oracle_sql()[name]).fetchall())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4:] for g in got] == [pytest.approx(w[4:], abs=2e-6) for w in want]
    # a part is found by its own name
    assert {g[0] for g in got} == {i for i, _ in rows if i % 50 == 0}
    assert all(sum(g[0] == i for g in got) <= 5 for i, _ in rows)
