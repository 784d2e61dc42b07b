"""Streaming page ingest: new page files join the store once each, and checks run on snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages from Parquet files as they arrive; a page fetched again within a day under one URL and content counts once."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withWatermark("fetched_at", "1 day").dropDuplicatesWithinWatermark(["canonical_url", "content_sha256"])


def start(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]):
    """Process what is there, batch by batch, then stop; run again to go on from the checkpoint."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
