"""A registry of search indexes, answering by name."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from sparkgram.functions.metric import metric
from sparkgram.operators.index import SearchIndex
from sparkgram.operators.search import autocomplete, fuzzy_top_k
from sparkgram.sources import dictionary
from sparkgram.sources.config import IndexDescription


class UnknownDictionary(KeyError):
    """No index has this name."""


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._indexes: dict[str, SearchIndex] = {}
        self._lock = threading.RLock()

    def add_index(self, description: IndexDescription, docs: DataFrame | None = None) -> None:
        """Adds or replaces an index.

        RAM builds it from ``docs`` or the source file and caches it; DISC opens
        what ``output`` holds.
        """
        if description.driver == "DISC" and docs is None:
            index = SearchIndex.load(self.spark, description.output)
        else:
            if docs is None:
                docs = dictionary.from_lines(self.spark, description.source)
            index = SearchIndex.build(docs, description)
            if description.driver == "RAM":
                index = index.cache()
            else:
                index.save(description.output)
                index = SearchIndex.load(self.spark, description.output)
        with self._lock:
            replaced = self._indexes.get(description.name)
            self._indexes[description.name] = index
        if replaced is not None:
            replaced.unpersist()  # plans made of it compute it anew or read its stored version

    def dictionaries(self) -> list[str]:
        with self._lock:
            return sorted(self._indexes)

    def index(self, name: str) -> SearchIndex:
        with self._lock:
            if name not in self._indexes:
                raise UnknownDictionary(name)
            return self._indexes[name]

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, query string")

    def search(self, name: str, query: str, metric_name: str = "Cosine", similarity: float = 0.5, top_k: int = 5) -> DataFrame:
        """``(doc_id, value, score)``, best first."""
        found = fuzzy_top_k(self.index(name), self._query(query), metric(metric_name, similarity), top_k)
        return found.orderBy("rank").select("doc_id", "value", "score")

    def autocomplete(self, name: str, query: str, limit: int = 5) -> DataFrame:
        """``(doc_id, value)`` by doc_id."""
        return autocomplete(self.index(name), self._query(query), limit).orderBy("rank").select("doc_id", "value")
