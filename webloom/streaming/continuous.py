"""Continuous operation: candidates arrive as a stream, each micro-batch is admitted to the crawl's state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.crawl import Crawl


def admit_stream(crawl: Crawl, stream: DataFrame, checkpoint: str, trigger: dict | None = None, fetch: bool = False, window_ms: int = 0) -> StreamingQuery:
    """stream (url, crawl_depth): each micro-batch becomes pages, and with fetch a round follows. A batch that is run again after a
    failure finds its URLs known, so nothing is admitted twice. trigger: e.g. {"processingTime": "1 minute"}; by default what is there."""

    def one(batch: DataFrame, number: int) -> None:
        crawl.seed(batch.select("url", F.col("crawl_depth").cast("int")))
        if fetch:
            crawl.round(dt.datetime.now(dt.timezone.utc), window_ms)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batch_writer(stream: DataFrame, path: str, checkpoint: str, delay_ms: int) -> StreamingQuery:
    """Size-or-time batches to Parquet: the source's limit (such as maxFilesPerTrigger) bounds the size, the trigger the time."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{delay_ms} milliseconds").start()


def distinct_stream(stream: DataFrame, time_col: str, keep: str) -> DataFrame:
    """URLs of a stream, each once within keep (an interval of time_col): state older than that is dropped."""
    return stream.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(["url"])


def idle_stream(stream: DataFrame, key: str, time_col: str, idle: str, late: str) -> DataFrame:
    """Activity periods of a key that end after idle, by event time."""
    periods = stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, idle).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"))
    return periods.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
