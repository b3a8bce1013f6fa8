"""Scoring a stream, micro-batch by micro-batch, and windowed counts with late data.

An extension: batches are scored with the rows before them as history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.sources.scratch import released


def score_stream(stream: DataFrame, predict: Callable[[DataFrame, DataFrame | None], DataFrame], history: DataFrame, output: str, checkpoint: str, lookback_days: int = 30) -> StreamingQuery:
    """Writes each micro-batch's scored rows to its own batch_id below output; history further back than a frame reaches is not read.

    A batch that is run again after a failure takes its own place. What it wrote for itself is removed with it.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        first = batch.agg(F.min("timestamp")).first()[0]
        known = history.filter(F.col("timestamp") >= F.lit(first) - F.make_dt_interval(F.lit(lookback_days)))
        with released(batch.sparkSession):
            predict(batch, known).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def velocity_windows(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Transactions and amounts per account and event-time window; rows later than `late` are left out."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return stream.withWatermark("timestamp", late).groupBy("account_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("amount").alias("total")).select("account_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
