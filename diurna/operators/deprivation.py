"""Sleep deprivation: baseline, recovery, difference, rebound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def day_bins(minutes: DataFrame, bin_minutes: int = 15, value: str = "sleep") -> DataFrame:
    """``id, day, zt_bin_minute, value``: mean of the measured minutes."""
    keys = [S.day_index("t").alias("day"), S.zt_bin("t", bin_minutes).alias("zt_bin_minute")]
    return minutes.groupBy("id", *keys).agg(F.avg(F.col(value).cast("double")).alias("value"))


def day_traces(binned: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, day, zt_bin_minute, mean, sem, n``."""
    rows = binned.join(groups.select("id", "grp"), "id").groupBy("grp", "day", "zt_bin_minute")
    return rows.agg(F.avg("value").alias("mean"), S.sem("value", 0.0).alias("sem"), F.count("value").alias("n"))


def recovery(binned: DataFrame, sd_day: int, bin_minutes: int = 15) -> DataFrame:
    """``id, day, zt_bin_minute, baseline, value, difference, cumulative_minutes`` of the days after deprivation.

    The baseline is the mean of each bin over the days before it. Missing differences add nothing to the sum.
    """
    if sd_day < 1:
        raise ValueError("deprivation on the first day leaves no baseline")
    base = binned.where(F.col("day") < sd_day).groupBy("id", "zt_bin_minute").agg(F.avg("value").alias("baseline"))
    after = binned.where(F.col("day") > sd_day).join(base, ["id", "zt_bin_minute"])
    rows = after.withColumn("difference", F.col("value") - F.col("baseline"))
    run = Window.partitionBy("id", "day").orderBy("zt_bin_minute").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative_minutes", F.sum(F.coalesce("difference", F.lit(0.0))).over(run) * bin_minutes)


def rebound(found: DataFrame, bin_minutes: int = 15) -> DataFrame:
    """``id, day, part, baseline_min, recovery_min, rebound_percent`` for light, dark and the whole day."""
    light = F.col("zt_bin_minute") < 720
    parts = F.explode(F.array(F.lit("day"), F.when(light, "light").otherwise("dark"))).alias("part")
    rows = found.select("id", "day", "baseline", "value", parts).groupBy("id", "day", "part")
    sums = rows.agg((F.sum("baseline") * bin_minutes).alias("baseline_min"), (F.sum("value") * bin_minutes).alias("recovery_min"))
    gain = F.when(F.col("baseline_min") > 0, (F.col("recovery_min") - F.col("baseline_min")) / F.col("baseline_min") * 100.0)
    return sums.withColumn("rebound_percent", gain)


def group_rebound(per: DataFrame, groups: DataFrame) -> DataFrame:
    rows = per.join(groups.select("id", "grp"), "id").groupBy("grp", "day", "part")
    return rows.agg(F.avg("rebound_percent").alias("mean"), S.sem("rebound_percent", 0.0).alias("sem"), F.count("rebound_percent").alias("n"))
