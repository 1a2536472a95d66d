"""N-gram counts as text files ``<k>-gm``: words, a tab, the count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(ngrams: DataFrame, path: str, order: int) -> None:
    for k in range(1, order + 1):
        lines = ngrams.where(F.col("n") == k).select(F.concat_ws("\t", "gram", F.col("cnt").cast("string")).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{k}-gm")


def read(spark: SparkSession, path: str, order: int) -> DataFrame:
    """``(n, gram, cnt)``; repeated grams are summed; a count that is no number is an error."""
    out = None
    for k in range(1, order + 1):
        cells = F.split("value", "\t")
        part = spark.read.text(f"{path}/{k}-gm").select(F.lit(k).alias("n"), cells[0].alias("gram"), cells[1].cast("long").alias("cnt"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("n", "gram").agg(F.sum("cnt").alias("cnt"))
