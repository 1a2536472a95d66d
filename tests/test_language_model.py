import math

import pytest
from pyspark.sql import functions as F

from sparkgram.functions.analysis import words
from sparkgram.plans import language_model as lm
from sparkgram.plans.spell import SpellChecker
from sparkgram.sources import ngram_files
from sparkgram.sources.config import LanguageModelConfig

CONFIG = LanguageModelConfig("sam", 3, ("english", "numbers"), (".", "?", "!", "\n"))
TEXT = "I am Sam\nSam I am\nI do not like green eggs and ham\n"


@pytest.fixture(scope="module")
def model(spark):
    out = lm.LanguageModel.train(spark.createDataFrame([(TEXT,)], "text string"), "text", CONFIG)
    out.ngrams = out.ngrams.cache()
    return out


def test_counts(model):
    got = {r.n: (r.k, r.total) for r in model.ngrams.groupBy("n").agg(F.count("*").alias("k"), F.sum("cnt").alias("total")).collect()}
    assert got == {1: (12, 20), 2: (15, 17), 3: (14, 14)}
    assert lm.corpus_total(model.ngrams).first().total == 20


@pytest.mark.parametrize(
    ("wrap", "want"),
    [
        (True, {"i am sam": -1.3862, "i am": -1.3862, "sam i am": -0.6931, "sam am i": -10.2852, "i dont know": -105.0514, "no one word": -203.7297, "": 0.0}),
        (False, {"i am sam": -0.6931, "i am": -0.4054, "sam i am": 0.0, "sam am i": -4.1351, "i dont know": -3.7297, "no one word": -100.0}),
    ],
)
def test_scores(spark, model, wrap, want):
    rows = spark.createDataFrame([(t,) for t in want], "id string").select("id", words(F.col("id"), CONFIG.alphabet).alias("words"))
    got = {r.id: r.score for r in (model.score_sentences(rows) if wrap else model.score_ngrams(rows)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-4 for k, v in want.items())


def test_windows_of_any_length(spark, model):
    rows = spark.createDataFrame([("i",), ("",), ("i am sam sam",)], "id string").select("id", words(F.col("id"), CONFIG.alphabet).alias("words"))
    got = {r.id: r.score for r in model.score_ngrams(rows).collect()}
    assert got == pytest.approx({"i": math.log(3 / 20), "": -100.0, "i am sam sam": math.log(1 / 2)})


@pytest.mark.parametrize(("context", "word", "want"), [("i am", "sam", -0.6931), ("i am", "</S>", -0.6931), ("i", "am", -0.4054), ("i", "do", -1.0986), ("green", "eggs", 0.0)])
def test_next_word(model, context, word, want):
    got = {r.word: r.score for r in model.next_scores(context.split()).collect()}
    assert abs(got[word] - want) < 1e-4


def test_unknown_context_scores_nothing(model):
    assert model.next_scores(["i", "dp"]).collect() == []
    with pytest.raises(ValueError):
        model.next_scores([])


def test_context_windows(model):
    assert model.context([]) == ["<S>"]
    assert model.context(["a"]) == ["<S>", "a"]
    assert model.context(["a", "b"]) == ["a", "b"]
    assert model.context(["a", "b", "c"]) == ["a", "b"]
    assert model.context(["a", "b", "c"], fix_context=True) == ["b", "c"]
    assert model.context(["a", "b", "c", "d"]) == ["c", "d"]


def test_paths(spark):
    puts = [("1 2 3 4", 5), ("1 2 3 4", 2), ("3 2", 3), ("3 2", -3), ("4", 8)]
    rows = spark.createDataFrame([(p.split(), w) for p, w in puts], "words array<string>, weight long")
    assert {r.path: r.cnt for r in lm.count_paths(rows).collect()} == {"1 2 3 4": 7, "4": 8}


def test_vocabulary_and_ids(spark, model):
    vocab = model.vocabulary()
    rows = vocab.orderBy("word_id").collect()
    assert [r.word_id for r in rows] == list(range(12))
    assert [(r.word, r.cnt) for r in rows[:5]] == [("</S>", 3), ("<S>", 3), ("i", 3), ("am", 2), ("sam", 2)]
    ids = lm.word_ids(spark.createDataFrame([("sam",), ("zz",)], "word string"), vocab)
    assert {r.word: r.word_id for r in ids.collect()} == {"sam": 4, "zz": None}
    back = lm.words_of_ids(spark.createDataFrame([(4,), (99,)], "word_id long"), vocab)
    assert {r.word_id: r.word for r in back.collect()} == {4: "sam", 99: "<UNK>"}


def test_files_and_storage(spark, model, tmp_path):
    ngram_files.write(model.ngrams, str(tmp_path / "gm"), 3)
    back = ngram_files.read(spark, str(tmp_path / "gm"), 3)
    assert sorted(map(tuple, back.select("n", "gram", "cnt").collect())) == sorted(map(tuple, model.ngrams.select("n", "gram", "cnt").collect()))
    model.save(str(tmp_path / "lm"))
    again = lm.LanguageModel.load(spark, str(tmp_path / "lm"))
    assert again.config == CONFIG
    assert again.ngrams.count() == 41
    (tmp_path / "bad" / "1-gm").mkdir(parents=True)
    (tmp_path / "bad" / "1-gm" / "x").write_text("a\tmany\n")
    with pytest.raises(Exception, match="many"):
        ngram_files.read(spark, str(tmp_path / "bad"), 1).collect()


@pytest.mark.parametrize(("query", "want"), [("i am sa", ["sam"]), ("i do not lik", ["like"]), ("i dp not lik", ["like"]), ("i a", []), ("", [])])
def test_spelling(model, query, want):
    checker = SpellChecker(model)
    assert [r.word for r in checker.predict(query, 5, 0.5).orderBy("pos").collect()] == want


def test_spelling_gives_one_more_than_k(spark):
    text = "abcdefghijklmnop one\nabcv one\nabcw one\nabcy one\n"
    model = lm.LanguageModel.train(spark.createDataFrame([(text,)], "text string"), "text", CONFIG)
    checker = SpellChecker(model)
    # one completion and three nearer fuzzy matches
    got = [r.word for r in checker.predict("abcd", 3, 0.2).orderBy("pos").collect()]
    assert len(got) == 4
    assert got[0] == "abcdefghijklmnop"
    assert checker.predict("abcd", 3, 0.2, strict_k=True).count() == 3
    with pytest.raises(ValueError):
        checker.predict("abcd", 0, 0.2)


@pytest.fixture(scope="module")
def two_sources(spark, tmp_path_factory):
    """Documents and a benchmark with other words, and conversations that use the documents'."""
    path = str(tmp_path_factory.mktemp("sources"))
    docs = [(1, "The thhab ran. The thhab sat! The thhcd\nA cat"), (2, "The cat sat on the mat. The cat ran"), (3, None)]
    talk = [(1, 0, "user", "The cat sat. The thhab ran"), (1, 1, "assistant", "Unheard of! On the mat"), (2, 0, "user", "the end of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the end of it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["vocab_rank_documents", "word_ids_documents", "sentence_score_documents", "next_word_topk_documents", "lm_context_children_documents", "spell_predict_documents"])
def test_models_of_the_documents(spark, two_sources, name):
    import duckdb

    import __spark_entry__ as e

    got = e.queries()[name](spark, two_sources)
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{two_sources}/{table}.parquet/*.parquet')")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert want
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_spelling_by_the_documents(spark, two_sources):
    import __spark_entry__ as e

    got = [tuple(r) for r in e.queries()["spell_predict_documents"](spark, two_sources).orderBy("query_id", "pos").collect()]
    # <S> the: 5 times, twice before thhab, once before thhcd; nothing follows <S> is
    assert [r for r in got if r[0] < 3] == [(0, 0, "thhab", round(math.log(2 / 5), 6)), (0, 1, "thhcd", round(math.log(1 / 5), 6)), (1, 0, "the", -100.0)]


def test_spelling_gives_both_lists_whole(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    # four completions of abc, and five nearer fuzzy matches of other words
    said = "abcdefghijklmnopqr abcdefghijklmnopqs abcdefghijklmnopqt abcdefghijklmnopqu zabc yabc xabc wabc vabc"
    spark.createDataFrame([(1, said)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    talk = [(0, 0, "user", "abc"), (50, 0, "user", "zabc abc"), (50, 1, "assistant", "abc"), (51, 0, "user", "abc")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = e.queries()["spell_batch_conversations"](spark, str(tmp_path))
    with duckdb.connect() as db:
        for table in ("benchmark", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()['spell_batch_conversations']})").fetchall()
    assert max(r[1] for r in want) > 5
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_spelling_broadcasts_no_index(spark, two_sources):
    """The words asked for go to every task; the postings of the vocabulary, small in files only, never do."""
    import re

    import __spark_entry__ as e

    found = e.queries()["spell_predict_documents"](spark, two_sources)
    joins = re.findall(r"BroadcastHashJoin \[term.*?(Build\w+)", found._jdf.queryExecution().executedPlan().toString())
    assert joins
    assert set(joins) == {"BuildLeft"}


ODD_TEXTS = [
    "The cat sat. The cat ran! the\nCAT sat", "", None, " \n. ", "a", "Kelvin İstanbul İ naïve café straße", "<S> the </S> cat. </S>",
    "counterrevolutionaries met counterrevolutionaries. counterrevolutionarie5 met " + "x" * 13 + " " + "x" * 12 + "0 " + "0" * 12 + " 0 00 000 0",
    "The cat sat. " * 40, "Ёлка ёж и Щука. ЁЖ и ёж, to be", "one two\x00three\tfour five; six", "z" * 5000 + " z" * 300,
]
ODD_LISTS = [
    ["the", "cat", "sat"], ["the"], [], None, ["The", "cat"], ["a b", "cat", "sat"], ["<S>", "the", "cat"], ["sat", "</S>", "the"], ["", "cat"], ["the", None, "cat"],
    ["counterrevolutionaries", "met", "counterrevolutionaries"], ["x" * 13, "x" * 12 + "0", "0" * 12, "0", "00"], ["ёж", "и", "ёж"], ["z" * 5000, "z", "z", "z"], ["cat", "sat"] * 30, ["café"], ["caf"], ["unheard", "of", "it"],
]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("alphabet", [("english", "numbers"), ("english", "russian", "numbers", "'-")])
def test_blocks_give_what_strings_give(spark, order, alphabet):
    config = LanguageModelConfig("odd", order, alphabet, (".", "?", "!", "\n"))
    texts = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string").repartition(3)
    model = lm.LanguageModel.train(texts, "text", config)
    strings = lm.LanguageModel(config, model.ngrams.cache(), True)
    assert model._texts is not None
    assert sorted(map(tuple, model.totals().collect())) == sorted(map(tuple, strings.totals().collect()))
    lists = spark.createDataFrame(list(enumerate(ODD_LISTS)), "id long, words array<string>").repartition(2)
    for score in ("score_sentences", "score_ngrams"):
        got, want = [{r.id: r.score for r in getattr(m, score)(lists).collect()} for m in (model, strings)]
        assert got == pytest.approx(want), score


def test_blocks_of_nothing(spark):
    texts = spark.createDataFrame([(None,), ("...",)], "text string")
    lists = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id long, words array<string>")
    model = lm.LanguageModel.train(texts, "text", CONFIG)
    assert model.totals().collect() == []
    assert {r.id: r.score for r in model.score_sentences(lists).collect()} == {1: -300.0, 2: 0.0}
    assert model.score_sentences(lists.where("id > 5")).collect() == []


def test_unusual_models_keep_to_strings():
    from dataclasses import replace

    from sparkgram.plans import gram_blocks

    assert gram_blocks.supported(CONFIG)
    for other in ({"order": 4}, {"separators": ("k",)}, {"separators": ()}, {"alphabet": ("english", " ")}, {"alphabet": ("σς",)}, {"start": "s"}, {"end": "<S>"}):
        assert not gram_blocks.supported(replace(CONFIG, **other)), other


def test_runs_of_very_many_words(monkeypatch):
    """A run with more words than can be numbered, or more positions than are counted at once."""
    from collections import Counter

    import pyarrow as pa

    from sparkgram.plans import gram_blocks

    monkeypatch.setattr(gram_blocks, "BITS", 5)
    monkeypatch.setattr(gram_blocks, "POSITIONS", 24)
    sents = [[f"w{i * j % 97}" for i in range(j)] for j in range(1, 40)]
    blocks = list(gram_blocks._text_blocks(gram_blocks.Words(CONFIG), pa.array([". ".join(map(" ".join, sents))]), 3, 4))
    want = [Counter() for _ in range(3)]
    for s in sents:
        w = ["<S>", *s, "</S>"]
        for n in (1, 2, 3):
            want[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    held = [gram_blocks._Merged((x for b in blocks for at, x in zip(b["bucket"].to_pylist(), b["block"].to_pylist(), strict=True) if at == bucket), 3) for bucket in range(4)]
    assert len(blocks) > 30
    for n in range(3):
        assert sorted(c for m in held for c in m.counts[n].tolist()) == sorted(want[n].values())


@pytest.mark.parametrize("name", ["ngram_counts_documents", "sentence_score_documents"])
def test_ngrams_of_the_documents_are_no_rows(spark, two_sources, name):
    """Neither a row for each n-gram of the documents nor one for each window of the conversations."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, two_sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert "arrays_zip" not in plan
    assert " Join" not in plan
