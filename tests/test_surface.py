"""Service, HTTP, configs, command line, streaming, variable grams, registered queries."""

import json

import pytest
from pyspark.sql import functions as F

from sparkgram import http_api
from sparkgram.functions.metric import metric
from sparkgram.operators.index import SearchIndex
from sparkgram.plans.variable_grams import gram_trie, prune
from sparkgram.service import Service, UnknownDictionary
from sparkgram.sources import dictionary
from sparkgram.sources.config import IndexDescription, read_index_descriptions, read_language_model_config
from sparkgram.streaming.lookup import search_stream

WORDS = ["Nissan March", "Nissan Juke", "Toyota Mark II"]
D = IndexDescription("cars", 3, ("english", "$"))


@pytest.fixture(scope="module")
def service(spark):
    out = Service(spark)
    out.add_index(D, dictionary.from_words(spark, WORDS))
    return out


def test_service(spark, service, tmp_path):
    assert [r.value for r in service.search("cars", "nisan jukke", similarity=0.4).collect()] == ["Nissan Juke"]
    assert [r.value for r in service.autocomplete("cars", "niss").collect()] == WORDS[:2]
    with pytest.raises(UnknownDictionary):
        service.search("none", "x")
    disc = IndexDescription("disc", 3, ("english", "$"), driver="DISC", output=str(tmp_path / "disc"))
    service.add_index(disc, dictionary.from_words(spark, WORDS))
    service.add_index(disc)  # opened again from storage
    assert service.dictionaries() == ["cars", "disc"]
    assert [r.doc_id for r in service.search("disc", "toyota mark ii", "Exact", 1.0).collect()] == [2]


def test_http(service):
    ask = lambda url, method="GET": http_api.answer(service, None, None, method, url)
    assert ask("/autocomplete/cars/niss/?topK=1") == (200, [{"Score": 0.0, "Value": "Nissan March"}])
    status, body = ask("/search/cars/nissan%20juke/?metric=Cosine&similarity=0.9")
    assert (status, [x["Value"] for x in body]) == (200, ["Nissan Juke"])
    assert ask("/search/cars/x/?metric=cosine")[0] == 400
    assert ask("/search/cars/x/?metric=Cosine&similarity=0")[0] == 400
    assert ask("/autocomplete/cars/x/?topK=0")[0] == 400
    assert ask("/search/none/x/?metric=Cosine")[0] == 404
    assert "cars" in ask("/dict/list/")[1]
    assert ask("/internal/reindex/", "POST")[0] == 404
    done = []
    assert http_api.answer(service, None, lambda: done.append(1), "POST", "/internal/reindex/")[0] == 200
    assert done == [1]


def test_configs(tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"driver": "DISC", "name": "a", "nGramSize": 3, "alphabet": ["english"], "source": "w.txt", "output": "/abs", "pad": "$", "wrap": ["^", "$"]}]))
    (d,) = read_index_descriptions(str(tmp_path / "i.json"))
    assert (d.source, d.output, d.wrap) == (str(tmp_path / "w.txt"), "/abs", ("^", "$"))
    (tmp_path / "l.json").write_text(json.dumps({"name": "m", "nGramOrder": 3, "source": "t", "output": "o", "alphabet": ["english"], "separators": ["."], "startSymbol": "<s>", "endSymbol": "</s>"}))
    c = read_language_model_config(str(tmp_path / "l.json"))
    assert (c.order, c.start, c.end) == (3, "<s>", "</s>")
    with pytest.raises(ValueError):
        IndexDescription("x", 3, ("english",), driver="TAPE")


def test_stream_of_queries(spark, tmp_path):
    index = SearchIndex.build(dictionary.from_words(spark, WORDS), D)
    spark.createDataFrame([(7, "nissan mach")], "query_id long, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in"))
    got = []
    query = search_stream(stream, lambda: index, metric("Cosine", 0.5), 2, lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert [(r.query_id, r.value) for r in got if r["rank"] == 1] == [(7, "Nissan March")]


def test_variable_grams(spark):
    rows = spark.createDataFrame([(w,) for w in ("stick", "stich", "such", "stuck")], "w string")
    trie = gram_trie(rows, "w", 2, 4)
    got = {r.gram: tuple(r)[1:] for r in trie.collect()}
    assert got["c"] == (4, False, 0)
    assert got["ch"] == (2, True, 2)
    assert got["ic"] == (2, True, 0)
    assert got["st"] == (3, True, 0)
    assert got["su"] == (1, True, 0)
    pruned = {r.gram: r.frequency for r in prune(trie, 2, 2).collect()}
    assert pruned["ic"] == 2
    assert "ick" not in pruned
    assert pruned["st"] == 1  # "stu" folds in, "sti" stays
    assert pruned["sti"] == 2


def test_every_query_has_a_stable_schema(spark):
    import __spark_entry__ as e

    core = {k for k in e.queries() if not k.startswith("op") and k != "pipeline"}
    assert len(core) >= 38
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "value", "score"]
