"""Fuzzy search, autocomplete and their batch forms.

Queries are rows, so one plan serves one query or a million: grams of the
queries meet the postings in an equi-join, overlaps are counted with partial
aggregation, the metric filters and scores, and a rank cuts to k.  Documents
come in last, for the surviving values only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgram.functions.metric import Metric
from sparkgram.operators.index import SearchIndex
from sparkgram.operators.ranking import top_k


def _query_grams(index: SearchIndex, queries: DataFrame, tail: str) -> DataFrame:
    d = index.description
    grams = index.tokenizer(queries.select("query_id", "query"), "query", d, d.wrap[0], tail)
    return grams.withColumn("a", F.size("grams").cast("long")).where("a > 0")


def _hinted(side: DataFrame, hint: str | None) -> DataFrame:
    return side.hint(hint) if hint else side


def overlaps(index: SearchIndex, queries: DataFrame, metric: Metric, hint: str | None = None) -> DataFrame:
    """``(query_id, a, value_id, b, overlap)`` of all pairs that share a gram and
    whose sizes allow the metric; repeated query grams count each time.
    ``hint`` says how the queries meet the postings, which are small in files
    and large in memory."""
    q = _query_grams(index, queries, index.description.wrap[1])
    terms = q.select("query_id", "a", metric.min_size(F.col("a")).alias("lo"), metric.max_size(F.col("a")).alias("hi"), F.explode("grams").alias("term"))
    hits = _hinted(terms, hint).join(index.postings, "term").where(F.col("card").between(F.col("lo"), F.col("hi")))
    return hits.groupBy("query_id", "a", "value_id", F.col("card").alias("b")).agg(F.count("*").alias("overlap"))


#: Score of a pair: (overlap, query size, value size) -> Column.
Scorer = Callable[[Column, Column, Column], Column]


def _scored(pairs: DataFrame, metric: Metric, scorer: Scorer | None = None) -> DataFrame:
    a, b, i = F.col("a"), F.col("b"), F.col("overlap")
    t = metric.threshold(a, b)
    return pairs.where((t > 0) & (t <= F.least(a, b)) & (i >= t)).withColumn("score", (scorer or metric.score)(i, a, b))


def prefix_candidates(index: SearchIndex, queries: DataFrame, metric: Metric) -> DataFrame:
    """``(query_id, value_id)`` that share one of the rarest grams of the query.

    A pair with overlap >= T(min size) shares one of the a - T + 1 rarest grams
    (as occurrences), so candidates come from short lists only.
    """
    q = _query_grams(index, queries, index.description.wrap[1])
    lo = metric.min_size(F.col("a"))
    least = F.greatest(metric.threshold(F.col("a"), lo), F.lit(1))
    terms = q.select("query_id", "a", lo.alias("lo"), metric.max_size(F.col("a")).alias("hi"), (F.col("a") - least + 1).alias("keep"), F.posexplode("grams").alias("pos", "term"))
    frequency = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(frequency, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term", "pos")))
    short = ranked.where(F.col("r") <= F.col("keep")).select("query_id", "lo", "hi", "term").distinct()
    return short.join(index.postings, "term").where(F.col("card").between(F.col("lo"), F.col("hi"))).select("query_id", "value_id").distinct()


def verified(index: SearchIndex, queries: DataFrame, metric: Metric) -> DataFrame:
    """The overlaps of the candidates of rare grams: (query_id, a, value_id, b, overlap)."""
    q = _query_grams(index, queries, index.description.wrap[1]).select("query_id", "a", "grams")
    values = index.values.select("value_id", F.col("card").alias("b"), F.array_distinct("grams").alias("doc_grams"))
    found = prefix_candidates(index, queries, metric).join(values, "value_id").join(q, "query_id")
    # repeated query grams count each time
    shared = F.size(F.filter("grams", lambda g: F.array_contains("doc_grams", g))).cast("long")
    return found.select("query_id", "a", "value_id", "b", shared.alias("overlap"))


def fuzzy_top_k(index: SearchIndex, queries: DataFrame, metric: Metric, k: int, prefix_filter: bool = False, scorer: Scorer | None = None, hint: str | None = None) -> DataFrame:
    """Top ``k`` documents of each query: (query_id, rank, doc_id, value, score).

    Order: score down, then doc_id up.  ``prefix_filter`` verifies candidates of
    rare grams only; the result is the same.  ``scorer`` ranks what the metric
    lets pass in place of the metric's own score.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = verified(index, queries, metric) if prefix_filter else overlaps(index, queries, metric, hint)
    scored = _scored(pairs, metric, scorer).select("query_id", "value_id", "score")
    # value_id is the least doc_id of its value, so whatever value comes before another has a document
    # that does: the k best documents belong to the k best values
    best = top_k(scored, k, [F.desc("score"), F.asc("value_id")], "query_id").drop("rank")
    rows = best.join(_first_docs(index, best, k, hint), "value_id")
    return top_k(rows, k, [F.desc("score"), F.asc("doc_id")], "query_id").select("query_id", "rank", "doc_id", "value", "score")


def _first_docs(index: SearchIndex, found: DataFrame, k: int, hint: str | None = None) -> DataFrame:
    """The ``k`` least documents of the values found: a popular value's copies are
    cut to k in every task before they meet the queries."""
    docs = index.docs.join(_hinted(found.select("value_id").distinct(), hint), "value_id", "left_semi")
    return top_k(docs, k, [F.asc("doc_id")], "value_id").drop("rank")


def autocomplete(index: SearchIndex, queries: DataFrame, limit: int) -> DataFrame:
    """For each query the ``limit`` least doc_ids whose value has every query gram."""
    if limit <= 0:
        return index.docs.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "doc_id", "value").limit(0)
    # as in ``fuzzy_top_k``: the least documents belong to the least values
    least = top_k(containing(index, queries), limit, [F.asc("value_id")], "query_id").drop("rank")
    rows = least.join(_first_docs(index, least, limit), "value_id")
    return top_k(rows, limit, [F.asc("doc_id")], "query_id").select("query_id", "rank", "doc_id", "value")


def containing(index: SearchIndex, queries: DataFrame, hint: str | None = None) -> DataFrame:
    """``(query_id, value_id)``: values with every gram of the query, open at its end; ``hint`` as in ``overlaps``."""
    q = _query_grams(index, queries, "")
    terms = q.select("query_id", "a", F.explode(F.array_distinct("grams")).alias("term"), F.size(F.array_distinct("grams")).alias("kinds"))
    hits = _hinted(terms, hint).join(index.postings, "term").where(F.col("card") >= F.col("a"))
    return hits.groupBy("query_id", "kinds", "value_id").agg(F.count("*").alias("n")).where("n = kinds").select("query_id", "value_id")


def fuzzy_join(index: SearchIndex, left: DataFrame, metric: Metric, prefix_filter: bool = True, scorer: Scorer | None = None) -> DataFrame:
    """All pairs (query_id, doc_id, score) that the metric accepts: a batch join.

    Popular grams make no candidates unless ``prefix_filter`` is off; then every
    shared gram does, which suits short left sides.
    """
    pairs = verified(index, left, metric) if prefix_filter else overlaps(index, left, metric)
    return _scored(pairs, metric, scorer).join(index.docs, "value_id").select("query_id", "doc_id", "value", "score")


def collected(index: SearchIndex, queries: DataFrame, metric: Metric, collector: Callable[[DataFrame], DataFrame], prefix_filter: bool = True, scorer: Scorer | None = None) -> DataFrame:
    """What a collector of one's own makes of all (query_id, doc_id, value, score) that the metric accepts."""
    return collector(fuzzy_join(index, queries, metric, prefix_filter, scorer))
