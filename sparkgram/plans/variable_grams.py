"""Variable-length grams: frequencies of the nodes of a gram trie, and its pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram_trie(rows: DataFrame, text_col: str, q_min: int, q_max: int) -> DataFrame:
    """``(gram, node_frequency, is_marker, marker_frequency)``.

    At each position the gram of ``q_max`` characters, or what is left if that
    is at least ``q_min``, enters the trie: every prefix counts it, and the
    prefix that is the gram counts it as its end.
    """
    text = F.col(text_col)
    starts = rows.where(F.char_length(text) >= q_min).select(text.alias("_t"), F.explode(F.sequence(F.lit(1), F.char_length(text) - (q_min - 1))).alias("_i"))
    grams = starts.select(F.substring("_t", F.col("_i"), F.lit(q_max)).alias("_g"))
    prefixes = grams.select("_g", F.explode(F.sequence(F.lit(1), F.char_length("_g"))).alias("_n"))
    gram = F.substring("_g", F.lit(1), F.col("_n"))
    ends = (F.col("_n") == F.char_length("_g")) & (F.col("_n") >= q_min)
    counted = prefixes.groupBy(gram.alias("gram")).agg(F.count("*").alias("node_frequency"), F.count_if(ends).alias("marker_frequency"))
    return counted.select("gram", "node_frequency", (F.char_length("gram") >= q_min).alias("is_marker"), "marker_frequency")


def prune(trie: DataFrame, threshold: int, q_min: int) -> DataFrame:
    """``(gram, frequency)`` of the grams that stay after pruning.

    Below a marker node of at most ``threshold`` occurrences everything folds
    into its marker; at others the least frequent children fold in, as long as
    the marker stays within the threshold, and the rest is pruned in turn.
    Subtrees under the first ``q_min`` characters don't touch each other.
    """
    marked = trie.where(F.char_length("gram") >= q_min).select("gram", F.col("node_frequency").alias("f"), F.col("marker_frequency").alias("own"))
    parent = F.expr("substring(gram, 1, char_length(gram) - 1)")
    nodes = marked.withColumn("parent", F.when(F.char_length("gram") > q_min, parent))
    above = marked.select(F.col("gram").alias("parent"), F.col("own").alias("parent_own"))
    # children come in ascending frequency, so those that fold in are the first ones
    lightest = Window.partitionBy("parent").orderBy("f", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    children = nodes.where("parent IS NOT NULL").join(above, "parent").withColumn("folds", F.col("parent_own") + F.sum("f").over(lightest) <= threshold)
    folded = children.where("folds").groupBy(F.col("parent").alias("gram")).agg(F.sum("f").alias("taken"))
    stays = children.select("gram", (~F.col("folds")).alias("apart"))
    info = nodes.join(stays, "gram", "left").join(folded, "gram", "left").select("gram", "f", F.coalesce("apart", F.lit(True)).alias("apart"), (F.col("f") > threshold).alias("opens"), (F.col("own") + F.coalesce("taken", F.lit(0))).alias("held"))
    # a node is reached if no prefix of it folds in, and all those before it open
    paths = info.select("gram", "f", "held", "opens", F.explode(F.sequence(F.lit(q_min), F.char_length("gram"))).alias("_n")).withColumn("_prefix", F.expr("substring(gram, 1, _n)"))
    steps = info.select(F.col("gram").alias("_prefix"), F.col("apart").alias("_apart"), F.col("opens").alias("_opens"))
    on_path = paths.join(steps, "_prefix").groupBy("gram", "f", "held", "opens")
    reached = on_path.agg(F.bool_and(F.col("_apart") & (F.col("_opens") | (F.col("_prefix") == F.col("gram")))).alias("reached")).where("reached")
    return reached.select("gram", F.when(F.col("opens"), F.col("held")).otherwise(F.col("f")).alias("frequency"))
