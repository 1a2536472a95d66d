"""Top-k, first-k, and ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgram.sources.scratch import cut


def top_k(rows: DataFrame, k: int, order: list[Column], group: str | None = None) -> DataFrame:
    """The first ``k`` rows by ``order``, of each ``group`` if there is one.

    Both plans cut to k rows a task before they shuffle (TakeOrderedAndProject,
    WindowGroupLimit).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if group is None:
        return rows.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def union_left_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left``, then those of ``right`` whose key is new; ``pos`` is the order.

    Both have a column ``pos`` that numbers their rows from 0.
    """
    size = left.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_shift"))
    rest = right.join(left.select(key), key, "left_anti").crossJoin(F.broadcast(size))
    return left.unionByName(rest.withColumn("pos", F.col("pos") + F.col("_shift")).drop("_shift"))


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column] | None = None, count: str | None = None) -> DataFrame:
    """Adds what comes before each row in ``order`` over the whole table: for each
    name of ``totals`` the sum of its column, as ``count`` the number of rows.

    Rows are stored by ranges of the order, each with the number of its range.
    A window within ranges and the totals of the ranges before, one row a range,
    give the rest, so no task sees the whole table.
    """
    values = dict(totals or {})
    if count:
        values[count] = F.lit(1).cast("long")
    held = {name: f"_run_{i}" for i, name in enumerate(values)}
    ranged = rows.withColumns({held[n]: v for n, v in values.items()}).repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_run_part", F.spark_partition_id()), "ranged")
    of_parts = ranged.groupBy("_run_part").agg(*[F.sum(h).alias(h) for h in held.values()])
    parts_before = Window.orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_parts.select(F.col("_run_part").alias("_run_of"), *[F.coalesce(F.sum(h).over(parts_before), F.lit(0)).alias(f"{h}_before") for h in held.values()])
    rows_before = Window.partitionBy("_run_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({f"{h}_within": F.coalesce(F.sum(h).over(rows_before), F.lit(0)) for h in held.values()})
    out = within.join(offsets, within["_run_part"] == offsets["_run_of"])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"{h}_within") + F.col(f"{h}_before")).alias(n) for n, h in held.items()])


def dense_ids(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ids 0, 1, ... in ``order`` without bringing all rows to one task."""
    return running_totals(rows, order, count=name)
