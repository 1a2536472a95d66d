"""Connected components of an edge table, by hooking and pointer jumping.

Every vertex with a smaller neighbour hooks to its least one; the resulting
trees are flattened by pointer jumping, whose steps double the distance; the
edges are rewritten to roots, and the rest goes on.  Both loops take a
logarithmic number of rounds for all but contrived graphs and end on their own
for any.  All tables are narrow and stay distributed; each round is cut to
storage, so the lineage is short, and goes when its last reader has run.  A vertex of very high degree is met by
``min`` with partial aggregation and by joins whose hot side AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import cut, release


def _flat(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root): follows (id, root) pointers until every one ends at a root; and the table behind it."""
    held = None
    while True:
        up = parents.select(F.col("id").alias("_up"), F.col("root").alias("_top"))
        jumped = cut(
            parents.join(up, parents.root == up._up, "left").select("id", F.coalesce("_top", "root").alias("root"), F.col("_top").isNotNull().alias("moved")),
            "jumped",
        )
        if held is not None:
            release(held)
        held, parents = jumped, jumped.select("id", "root")
        if not jumped.where("moved").limit(1).count():
            return parents, held


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every vertex that isn't the least of its component.

    ``edges`` has columns (a, b), in any order and with repeats; loops and
    nulls are ignored.  ``root`` is the least vertex that ``id`` reaches.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = behind = None
    while live.limit(1).count():
        roots, of_roots = _flat(live.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root"))
        spare = []
        if labels is None:
            labels, behind = roots, of_roots
        else:
            next_root = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
            moved = labels.join(next_root, labels.root == next_root._id, "left").select("id", F.coalesce("_root", "root").alias("root"))
            labels = cut(moved.unionByName(roots), "labels")
            release(behind)
            behind, spare = labels, [of_roots]
        to_a = roots.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
        to_b = roots.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
        ends = live.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        rest = cut(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(live, *spare)
        live = rest
    if labels is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    release(live)
    return labels
