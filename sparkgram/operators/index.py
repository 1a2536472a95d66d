"""The segmented inverted index as DataFrames.

``values`` has one row for each distinct text: popular texts are indexed once,
and their documents come back in at the end, from ``docs``.  ``postings`` has
one row for each distinct gram of a value, and is stored partitioned by ``card``,
the number of grams, which is what searches prune by.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgram.functions.analysis import with_grams
from sparkgram.operators.ranking import top_k
from sparkgram.sources.config import IndexDescription

FORMAT_VERSION = 2
#: Versions of a stored index that stay.
KEPT_VERSIONS = 2
#: Write tasks that the postings of one size are dealt to.
TASKS_OF_CARD = 32
#: Ids that an array of a posting list spans.
LIST_IDS = 1 << 16


def _versions(spark: SparkSession, path: str) -> tuple:
    """(file system, whole versions under ``path``, oldest first)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/versions")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    found = sorted((s.getPath() for s in fs.listStatus(root)), key=lambda p: p.getName())
    return fs, [p for p in found if fs.exists(hadoop.Path(p, "meta/_SUCCESS"))]


#: Adds ``grams`` to rows: (rows, text column, description, start mark, end mark) -> rows.
Tokenizer = Callable[[DataFrame, str, IndexDescription, str, str], DataFrame]


def described_grams(rows: DataFrame, text_col: str, d: IndexDescription, start: str, end: str) -> DataFrame:
    """The grams that a description asks for: wrap, fold, n-gram, normalise."""
    return with_grams(rows, text_col, d.n, d.alphabet, d.pad, start, end)


@dataclass
class SearchIndex:
    """docs(doc_id, value, value_id), values(value_id, value, card, grams), postings(card, term, value_id)."""

    description: IndexDescription
    docs: DataFrame
    values: DataFrame
    postings: DataFrame
    tokenizer: Tokenizer = described_grams

    @classmethod
    def build(cls, docs: DataFrame, description: IndexDescription, tokenizer: Tokenizer = described_grams) -> SearchIndex:
        """Indexes (doc_id, value); values without grams stay in ``docs`` only."""
        distinct = docs.where("value IS NOT NULL").groupBy("value").agg(F.min("doc_id").alias("value_id"))
        values = tokenizer(distinct, "value", description, *description.wrap).withColumn("card", F.size("grams").cast("long")).where("card > 0")
        postings = values.select("card", F.explode(F.array_distinct("grams")).alias("term"), "value_id")
        linked = docs.join(distinct, "value").select("doc_id", "value", "value_id")
        return cls(description, linked, values, postings, tokenizer)

    @classmethod
    def of_distinct(cls, docs: DataFrame, description: IndexDescription, tokenizer: Tokenizer = described_grams) -> SearchIndex:
        """``build`` for (doc_id, value) whose values are known to differ: nothing is grouped or joined."""
        linked = docs.where("value IS NOT NULL").select("doc_id", "value", F.col("doc_id").alias("value_id"))
        values = tokenizer(linked.select("value", "value_id"), "value", description, *description.wrap).withColumn("card", F.size("grams").cast("long")).where("card > 0")
        return cls(description, linked, values, values.select("card", F.explode(F.array_distinct("grams")).alias("term"), "value_id"), tokenizer)

    def first_docs(self, k: int) -> SearchIndex:
        """The index with the ``k`` least documents of each value only, which are all that a search for the top ``k`` can return."""
        return SearchIndex(self.description, top_k(self.docs, k, [F.asc("doc_id")], "value_id").drop("rank"), self.values, self.postings, self.tokenizer)

    def cache(self) -> SearchIndex:
        self.docs, self.values, self.postings = self.docs.cache(), self.values.cache(), self.postings.cache()
        return self

    def unpersist(self) -> None:
        for part in (self.docs, self.values, self.postings):
            part.unpersist()

    def save(self, path: str) -> None:
        """Writes a new version under ``path``; it counts once its description, the
        last part, is there.  The version before stays for plans that still read it.
        """
        spark = self.docs.sparkSession
        version = f"{path}/versions/{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.docs.write.parquet(f"{version}/docs")
        self.values.write.parquet(f"{version}/values")
        # popular sizes are many tasks' work
        spread = self.postings.repartition("card", F.pmod(F.xxhash64("term"), F.lit(TASKS_OF_CARD)))
        spread.write.partitionBy("card").parquet(f"{version}/postings")
        meta = json.dumps({"format_version": FORMAT_VERSION} | asdict(self.description))
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{version}/meta")
        fs, versions = _versions(spark, path)
        for old in versions[:-KEPT_VERSIONS]:
            fs.delete(old, True)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer = described_grams) -> SearchIndex:
        """Opens the latest whole version; ``tokenizer`` is the one it was built with."""
        _, versions = _versions(spark, path)
        if not versions:
            raise ValueError(f"{path}: no index")
        version = versions[-1].toString()
        meta = json.loads(spark.read.text(f"{version}/meta").first().value)
        if meta.pop("format_version") != FORMAT_VERSION:
            raise ValueError(f"{path}: unknown index version")
        d = IndexDescription(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta.items()})
        postings = spark.read.parquet(f"{version}/postings").withColumn("card", F.col("card").cast("long"))
        return cls(d, spark.read.parquet(f"{version}/docs"), spark.read.parquet(f"{version}/values"), postings, tokenizer)

    def lengths(self) -> DataFrame:
        """``(card, term, length)`` of every posting list, in documents."""
        copies = self.docs.groupBy("value_id").agg(F.count("*").alias("copies"))
        return self.postings.join(copies, "value_id").groupBy("card", "term").agg(F.sum("copies").alias("length"))

    def lists(self) -> DataFrame:
        """``(card, term, chunk, doc_ids)``: the posting lists as sorted arrays, in
        chunks of LIST_IDS ids by value, so that none grows with a popular gram."""
        entries = self.postings.join(self.docs.select("doc_id", "value_id"), "value_id")
        chunk = F.floor(F.col("doc_id") / LIST_IDS).alias("chunk")
        return entries.groupBy("card", "term", chunk).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))

    def segments(self) -> DataFrame:
        """``(card, n_docs)``: documents by number of grams."""
        return self.docs.join(self.values.select("value_id", "card"), "value_id").groupBy("card").agg(F.count("*").alias("n_docs"))
