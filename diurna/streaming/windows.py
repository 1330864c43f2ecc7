"""Readings as a stream: the window operators that have a bounded state.

Curation, longest blocks and period estimates need a whole record and stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, width: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """``id, start, n, total, failed`` of every tumbling window; rows later than ``late`` are dropped by the watermark."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = rows.groupBy(F.window("__ts", width), F.col(key).alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max((F.col("event_type") == "error").cast("int")).alias("failed")
    )
    return out.select("id", F.col("window.start").alias("start"), "n", "total", (F.col("failed") == 1).alias("failed"))


def active_spells(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """``id, start, stop, n``: sessions of activity, closed by ``gap`` without any."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = rows.groupBy(F.session_window("__ts", gap), F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
