"""The event log as activity readings: counts on a dense grid, with the three kinds of absence kept apart.

A bin without events is a measured zero; a bin with an error event has no reading (null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
DAYS = 30
#: Events of a partition: about half a million hours of their subjects.
EVENTS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_of(ts: str):
    return F.timestamp_diff("MINUTE", F.lit(ORIGIN).cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def event_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, t, value, event_type``: the log with minutes from the origin."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), minute_of("ts").cast("int").alias("t"), "value", "event_type")


def readings(spark: SparkSession, sf_dir: str, step: int = 60, days: int = DAYS) -> DataFrame:
    """``id, t, activity``: events of each subject in every ``step`` minutes of the first ``days`` days.

    Only the log is shuffled, to its subjects; the dense rows are made where a subject is and stay dealt by ``id``, so that
    windows and sums over a subject need no shuffle.
    """
    seen = counted(spark, sf_dir, step, days)
    held = seen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("seen"))
    before = F.transform("seen", lambda e, i: F.concat(F.array_repeat(F.lit(0.0), e["k"] - F.when(i > 0, F.get("seen", i - 1)["k"]).otherwise(-1) - 1), F.array(e["x"])))
    after = F.array_repeat(F.lit(0.0), F.lit(days * 1440 // step - 1) - F.element_at("seen", -1)["k"])
    dense = held.select("id", F.posexplode(F.concat(F.flatten(before), after)).alias("k", "activity"))
    return dense.select("id", (F.col("k") * step).cast("int").alias("t"), "activity")


def counted(spark: SparkSession, sf_dir: str, step: int = 60, days: int = DAYS) -> DataFrame:
    """``id, k, x``: the bins that have events, by number, and how many; null in a bin with an error. Dealt by ``id``.

    What is dealt is far smaller than what it becomes, so the partitions go by the number of events and are not merged.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "events").count() // EVENTS))
    log = event_minutes(spark, sf_dir).where(F.col("t").between(0, days * 1440 - 1)).select("id", F.floor(F.col("t") / step).cast("int").alias("k"), (F.col("event_type") == "error").alias("failed"))
    own = log.repartition(parts, "id").groupBy("id", "k")
    return own.agg(F.count(F.lit(1)).alias("n"), F.max("failed").alias("failed")).select("id", "k", F.when(~F.coalesce("failed", F.lit(False)), F.col("n").cast("double")).alias("x"))


def reading_runs(spark: SparkSession, sf_dir: str, step: int = 1, days: int = DAYS) -> DataFrame:
    """``id, t, t_end, activity``: the same readings, with stretches of zeros as one row from their first to their last bin.

    A subject has rows as it has events, not as the record has minutes.
    """
    order = Window.partitionBy("id").orderBy("k")
    bins = counted(spark, sf_dir, step, days).withColumns({"before": F.coalesce(F.lag("k").over(order), F.lit(-1)), "after": F.lead("k").over(order)})
    piece = lambda a, b, x: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), x.cast("double").alias("x"))
    k, last = F.col("k"), F.lit(days * 1440 // step - 1)
    pieces = F.array(piece(F.col("before") + 1, k - 1, F.lit(0.0)), piece(k, k, F.col("x")), piece(k + 1, F.when(F.col("after").isNull(), last).otherwise(k), F.lit(0.0)))
    rows = bins.select("id", F.explode(F.filter(pieces, lambda p: p["a"] <= p["b"])).alias("p"))
    return rows.select("id", (F.col("p.a") * step).alias("t"), (F.col("p.b") * step).alias("t_end"), F.col("p.x").alias("activity"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, grp, nation, split_minute, pulse_minute``: customers as subjects, their market segment as group.

    The boundary between the phases is day 10 or, for every third subject, day 12. Even subjects have a pulse.
    """
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("nation"))
    split = F.when(F.col("id") % 3 == 0, 12 * 1440).otherwise(10 * 1440)
    return rows.withColumns({"split_minute": split, "pulse_minute": F.when(F.col("id") % 2 == 0, split + 5 * 1440 + 840)})
