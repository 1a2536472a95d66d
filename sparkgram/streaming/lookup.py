"""Searches over a stream of queries, against an index that can be swapped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkgram.functions.metric import Metric
from sparkgram.operators.index import SearchIndex
from sparkgram.operators.search import fuzzy_top_k


def search_stream(queries: DataFrame, index: Callable[[], SearchIndex], metric: Metric, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, prefix_filter: bool = True, **options) -> StreamingQuery:
    """Starts a query whose micro-batches (query_id, query) are searched as one batch each.

    ``index`` is called for every batch, so a new index takes over between two
    of them; ``sink`` gets (result, batch id) and is called again with the same
    id after a failure, so a sink that overwrites by batch id is exactly-once.
    Batches verify candidates of rare grams; without ``prefix_filter`` every
    shared gram counts, which suits a handful of queries.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        sink(fuzzy_top_k(index(), rows, metric, k, prefix_filter), batch_id)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
