"""New listings as a stream: each micro-batch goes through the batch pipeline and is appended to a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import PipelineConfig
from ..plans.history import History
from ..plans.pipeline import analyze_listings


def follow(spark: SparkSession, listings: DataFrame, history: History, checkpoint: str, config: PipelineConfig | None = None) -> StreamingQuery:
    """Start a query over a stream of listings (with query and ordinal); one run for each query in a micro-batch.

    A micro-batch is analysed and written once, whatever the number of its queries. Its runs
    carry the stream's checkpoint and ``batch=<id>`` in their summary: a batch that is retried after it was saved
    is left out, and of one that was not finished no run is shown.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        summary = f"stream={checkpoint}, batch={batch_id}"
        if not history.saved_as(summary).isEmpty():
            return
        items, grouped = analyze_listings(batch, config)
        queries = [r.query for r in batch.select("query").distinct().collect()]  # the queries watched, not the listings
        history.save_all(items, grouped, sorted(queries), config_summary=summary)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
