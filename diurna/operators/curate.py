"""Dead subjects: the last minute with a live rolling mean of movement ends a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Curation
from . import runs


def with_moving(readings: DataFrame, value: str = "activity") -> DataFrame:
    """``moving``: 1 for activity, 0 for measured stillness, null for no reading."""
    return readings.withColumn("moving", (F.col(value) > 0).cast("tinyint"))


def alive(readings: DataFrame, settings: Curation = Curation(), step: int = 1) -> DataFrame:
    """``readings`` with ``moving`` and ``is_alive`` (1, 0, or null for a missing row after death).

    A subject is dead from the row after the last one whose centred mean of movement exceeds the proportion;
    dead throughout if there is none, or if it lived too few days; alive throughout if that row is its last
    measured one or later.
    """
    rows = readings if "moving" in readings.columns else with_moving(readings)
    rolled = runs.rolling_mean(rows, "moving", int(settings.rolling_window_hours * 60 // step), "__mean")
    whole = Window.partitionBy("id")
    last_active = F.max(F.when(F.col("__mean") > settings.immobility_proportion, F.col("t"))).over(whole)
    last_seen = F.max(F.when(F.col("moving").isNotNull(), F.col("t"))).over(whole)
    marked = rolled.withColumns({"__active": last_active, "__seen": last_seen, "__first": F.min("t").over(whole)})
    end = F.when(F.col("__active") >= F.col("__seen"), F.lit(2147483647)).otherwise(F.col("__active"))
    long = (F.col("__active") - F.col("__first")) / 1440.0 >= settings.min_alive_days
    is_alive = F.when(F.coalesce(long & (F.col("t") <= end), F.lit(False)), 1).when(F.col("moving").isNull() & long, None).otherwise(0)
    return marked.withColumn("is_alive", is_alive.cast("tinyint")).drop("__mean", "__active", "__seen", "__first")


def curate(readings: DataFrame, settings: Curation = Curation(), step: int = 1) -> DataFrame:
    """The live rows only."""
    return alive(readings, settings, step).where("is_alive = 1").drop("is_alive")


def curation_counts(marked: DataFrame) -> DataFrame:
    """``subjects, kept, removed, trimmed, unchanged``; a subject with no dead row is unchanged."""
    live, dead = F.max((F.col("is_alive") == 1).cast("int")), F.max(F.coalesce((F.col("is_alive") == 0).cast("int"), F.lit(0)))
    per = marked.groupBy("id").agg(live.alias("live"), dead.alias("dead"))
    total = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    lives = F.coalesce(F.col("live"), F.lit(0)) == 1
    return per.agg(F.count(F.lit(1)).alias("subjects"), total(lives).alias("kept"), total(~lives).alias("removed"), total(lives & (F.col("dead") == 1)).alias("trimmed"), total(lives & (F.col("dead") == 0)).alias("unchanged"))
