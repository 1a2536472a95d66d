"""Dictionaries: doc_id -> value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a lookup of a key that isn't there gives.
MISSING = "<nil/>"


def from_words(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(words)), "doc_id long, value string")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """One line is one value; ids are line numbers from 0, over files by name.

    Lines are counted by split of a file, in the order of the splits; a line's
    number is that of its split's first line and its place in the split.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_place"))
    of_splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("_lines"), F.min("_place").alias("_first"))
    before = Window.orderBy(F.length("_file"), "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = of_splits.select("_file", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return lines.join(offsets, ["_file", "_start"]).select((F.col("_place") + F.col("_offset")).alias("doc_id"), "value")


def from_table(table: DataFrame, id_col: str, value_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).alias("value"))


def save(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(docs: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``keys`` with their ``value``, or MISSING."""
    d = docs.select(F.col("doc_id").alias("_key"), "value")
    return keys.join(d, keys[key_col] == d["_key"], "left").withColumn("value", F.coalesce("value", F.lit(MISSING))).drop("_key")


def size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("size"))
