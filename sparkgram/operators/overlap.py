"""Overlap counting over posting lists: who occurs in at least T of the lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of the merge algorithms that this one aggregation stands for.
STRATEGIES = ("ScanCount", "CPMerge", "MergeSkip", "DivideSkip")


def t_occurrence(lists: DataFrame, threshold: int, strategy: str = "CPMerge") -> DataFrame:
    """``(doc_id, overlap)`` of the ids in at least ``threshold`` lists.

    ``lists`` has one row (list_id, doc_id) for each entry.  All strategies
    have one result; the hash aggregate counts before it shuffles, so a popular
    id sends one row a task.  A threshold below 1 or above the number of lists
    gives nothing.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if threshold < 1:
        return lists.select("doc_id", F.lit(0).cast("long").alias("overlap")).limit(0)
    return lists.groupBy("doc_id").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= threshold)


def intersection(lists: DataFrame) -> DataFrame:
    """``doc_id`` of the ids that every list has."""
    n = lists.select("list_id").distinct().agg(F.count("*").alias("n_lists"))
    return lists.distinct().groupBy("doc_id").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_lists")).select("doc_id")


def lower_bound(postings: DataFrame, targets: DataFrame, key: str = "term") -> DataFrame:
    """For each (key, target) the first doc_id >= target of the key's list, or null.

    Targets and postings are sorted together once, downwards; the last posting
    seen before a target is the answer, so no target meets a whole list.
    """
    listed = postings.select(key, F.col("doc_id").alias("at"), "doc_id", F.lit(0).alias("asks"))
    asked = targets.select(key, "target").distinct().select(key, F.col("target").alias("at"), F.lit(None).cast(postings.schema["doc_id"].dataType).alias("doc_id"), F.lit(1).alias("asks"))
    down = Window.partitionBy(key).orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = listed.unionByName(asked).withColumn("doc_id", F.last("doc_id", ignorenulls=True).over(down))
    return seen.where("asks = 1").select(key, F.col("at").alias("target"), "doc_id")
