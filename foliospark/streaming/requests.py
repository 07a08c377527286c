"""The request loop and page layout as micro-batches; every page is complete in itself, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.sources.requests import parse_requests


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as their JSON-lines files arrive."""
    return parse_requests(spark.readStream.text(path))


def write_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and store it under its batch id, so a replay replaces it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
