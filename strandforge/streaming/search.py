"""Queries that arrive as a stream, searched in a database that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.search import Options, search


def search_stream(queries: DataFrame, targets: DataFrame, q: str, t: str, path: str, checkpoint: str, trigger: dict | None = None, **given) -> StreamingQuery:
    """Searches each micro-batch of queries (q, seq) and writes its hits under path/batch=…. A batch that is run again replaces what it wrote, so every query's hits
    are there once. Searches hold no state, so there is nothing to expire."""
    Options.of(**given)

    def one(batch: DataFrame, number: int) -> None:
        search(batch, targets, q, t, **given).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
