"""Mixing sources to target weights.

Sizes are counted in words.  The targets are those of a water level: every
source gets its weight times one level, but no more than ``cap`` times its own
size; what a capped source leaves is shared by weight among the others until
none is above its cap.  A source's repetition rate is its target over its size;
each of its documents is taken floor(rate) times and once more if a hash of its
key, read as a number in [0, 1), lies below the rest of the rate.

Only DataFrame functions are used, so everything stays in generated code.  The
sum by source is pre-aggregated before its shuffle, so a source with a third of
all rows sends one row a task; documents meet the small table of sources in a
join that Spark broadcasts if that table's stored size is below its threshold,
and otherwise deals by source with AQE splitting the hot ones.

Defined cases: null text has size 0; a null source is a source, the last; a
source without words has target and rate 0; documents with equal keys share
their draw, so reruns and any order of the rows agree; an empty table gives an
empty mix.  Columns of the input are kept or not read; helper columns are
prefixed ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgram.llm.common import cut
from sparkgram.operators.ranking import running_totals

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of all sources.
SHARE = 1.5
#: Times a source, and so a document, may be taken.
CAP = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the digest that make the draw; 52 bits fit a double exactly.
_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the key and the seed determine."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, _DIGITS)
    return F.conv(digest, 16, 10).cast("long").cast("double") / F.lit(float(16**_DIGITS))


def source_targets(sized: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(_mix_source, source_size, target, _mix_rate)`` from rows of (_mix_source, size).

    Sorted by the level at which each reaches its cap, the level that the
    sources from here on would share rises while they are capped and falls
    after: its maximum is the water level.  Ranks and running sums go by ranges,
    so there may be as many sources as web sites.
    """
    by_source = F.col("_mix_source").asc_nulls_last()
    sources = running_totals(sized.groupBy("_mix_source").agg(F.sum("size").alias("source_size")), [by_source], count="_mix_rank")
    by_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int")).cast("long")
    sources = sources.withColumn("_mix_weight", by_rank).withColumn("_mix_cap", F.col("source_size") * cap).withColumn("_mix_full", F.col("_mix_cap") / F.col("_mix_weight"))
    before = {"_mix_cap_before": F.col("_mix_cap"), "_mix_weight_before": F.col("_mix_weight")}
    sources = cut(running_totals(sources, [F.col("_mix_full").asc(), by_source], before), "sources")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("_mix_weight").alias("weight")).first()
    total, weight = float(whole["size"] or 0), whole["weight"] or 0
    levels = (F.lit(total * share) - F.col("_mix_cap_before")) / (F.lit(weight) - F.col("_mix_weight_before"))
    level = sources.agg(F.max(levels)).first()[0] or 0.0
    target = F.least(F.col("_mix_cap").cast("double"), F.lit(level) * F.col("_mix_weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).select("_mix_source", "source_size", "target", rate.alias("_mix_rate"))


def copies(key: Column, rate: Column, seed: str = SEED) -> Column:
    """Times a document is taken: floor(rate), and one more by its draw."""
    return F.floor(rate) + F.when(draw(key, seed) < rate - F.floor(rate), 1).otherwise(0)


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    return rows.join(targets, rows["_mix_source"].eqNullSafe(targets["_mix_source"])).drop("_mix_source")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """For each document: (id, size, source_size, target, taken)."""
    sized = cut(docs.select(F.col(id_col).alias(id_col), F.col(source_col).alias("_mix_source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = cut(source_targets(sized), "targets")  # stored, so the planner knows its size
    taken = (copies(F.col(id_col), F.col("_mix_rate"), seed) * F.col("size")).cast("long")
    return _with_targets(sized, targets).select(id_col, "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, copy_col: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept;
    ``copy_col`` adds a column that numbers the copies of a row from 1."""
    sized = docs.select(F.col(source_col).alias("_mix_source"), word_count(F.col(text_col)).alias("size"))
    targets = cut(source_targets(sized), "targets")
    rows = _with_targets(docs.withColumn("_mix_source", F.col(source_col)), targets.select("_mix_source", "_mix_rate"))
    times = copies(F.col(id_col), F.col("_mix_rate"), seed).cast("int")
    return rows.withColumn("_mix_copies", times).where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.expr("sequence(1, _mix_copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col("_mix_copy").alias(copy_col)] if copy_col else []))
