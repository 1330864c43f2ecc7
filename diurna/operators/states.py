"""Profiles and phases of sleep states over the day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import bins

COLUMNS = {"standard": "sleep", "short": "sleep_short", "intermediate": "sleep_intermediate", "long": "sleep_long"}


def unpivoted(minutes: DataFrame) -> DataFrame:
    """``id, t, state, asleep``."""
    return minutes.select("id", "t", *[F.col(c).alias(s) for s, c in COLUMNS.items()]).unpivot(["id", "t"], list(COLUMNS), "state", "asleep")


def profiles(minutes: DataFrame, bin_minutes: int = 30) -> DataFrame:
    """``id, state, zt_bin_minute, value``: minutes of each state in an hour."""
    rows = unpivoted(minutes).groupBy("id", "state", S.zt_bin("t", bin_minutes).alias("zt_bin_minute"))
    return rows.agg((F.avg(F.col("asleep").cast("double")) * 60.0).alias("value"))


def group_profiles(profile: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, state, zt_bin_minute, mean, sem, n``; the error of one value is null."""
    rows = profile.join(groups.select("id", "grp"), "id").groupBy("grp", "state", "zt_bin_minute")
    return rows.agg(F.avg("value").alias("mean"), S.sem("value").alias("sem"), F.count("value").alias("n"))


def waveforms(grouped: DataFrame) -> DataFrame:
    """Group means over their own maximum (averaged first, then scaled); curves without a positive maximum go."""
    top = F.max("mean").over(Window.partitionBy("grp", "state"))
    rows = grouped.withColumn("scale", top).where("scale > 0")
    return rows.select("grp", "state", "zt_bin_minute", (F.col("mean") / F.col("scale")).alias("mean_normalized"), (F.col("sem") / F.col("scale")).alias("sem_normalized"), "scale")


def initiation(bouts: DataFrame, bin_hours: int = 1) -> DataFrame:
    """``id, state, bin_hour, probability, n_bouts``: share of a subject's bouts of a state that start in each hour.

    Bins carry their closing hour. "standard" has all bouts. Pairs without bouts have no rows.
    """
    both = bouts.select("id", "start_t", "state").unionByName(bouts.select("id", "start_t", F.lit("standard").alias("state")))
    hour = (F.floor(S.zt_minute("start_t") / (60 * bin_hours)) * bin_hours + bin_hours).cast("int")
    counted = both.groupBy("id", "state", hour.alias("bin_hour")).agg(F.count(F.lit(1)).alias("c"))
    total = both.groupBy("id", "state").agg(F.count(F.lit(1)).alias("n_bouts"))
    grid = total.select("id", "state", "n_bouts", F.explode(F.sequence(F.lit(bin_hours), F.lit(24), F.lit(bin_hours))).alias("bin_hour"))
    rows = grid.join(counted, ["id", "state", "bin_hour"], "left")
    return rows.select("id", "state", "bin_hour", (F.coalesce("c", F.lit(0)) / F.col("n_bouts")).alias("probability"), "n_bouts")


def _resultant(rows, angle, weight):
    return rows.agg(F.sum(weight * F.cos(angle)).alias("__c"), F.sum(weight * F.sin(angle)).alias("__s"), F.sum(weight).alias("__w"))


def circular(profile: DataFrame, bin_minutes: int = 30, doubling: str = "auto") -> DataFrame:
    """``id, state, mean_phase_h, r, angular_deviation_h, onset_h, offset_h, doubled``: weighted circular centre.

    ``doubling`` "auto" doubles angles where the weights have exactly two circular runs above the middle
    between their median and maximum; of the two opposite phases, the one with more weight within a quarter
    of a day stands. A resultant of no length has no phase, and no row.
    """
    keys = ["id", "state"]
    w = F.when(F.col("value") > 0, F.col("value"))
    rows = profile.select(*keys, "zt_bin_minute", w.alias("w"), "value").withColumn("a", F.radians((F.col("zt_bin_minute") + bin_minutes / 2) / 4.0))
    middle = rows.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("med"), F.max("value").alias("top"))
    high = rows.join(middle, keys).withColumn("high", F.coalesce(F.col("value") > F.col("med") + 0.5 * (F.col("top") - F.col("med")), F.lit(False)))
    ring = Window.partitionBy(*keys).orderBy("zt_bin_minute")
    last = F.last("high").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = high.withColumn("start", F.col("high") & ~F.coalesce(F.lag("high").over(ring), last))
    modes = starts.groupBy(*keys).agg(F.sum(F.col("start").cast("int")).alias("modes"))
    doubled = {"auto": F.col("modes") == 2, "always": F.lit(True), "never": F.lit(False)}[doubling]
    marked = rows.join(modes.withColumn("doubled", doubled), keys)
    k = F.when(F.col("doubled"), 2.0).otherwise(1.0)
    sums = _resultant(marked.groupBy(*keys, "doubled"), F.col("a") * k, F.col("w"))
    size = F.sqrt(F.col("__c") ** 2 + F.col("__s") ** 2) / F.col("__w")
    centre = sums.where("__w > 0").where(size > 1e-9).select(*keys, "doubled", size.alias("r"), (F.atan2("__s", "__c") / F.when(F.col("doubled"), 2.0).otherwise(1.0)).alias("phase"))
    near = F.cos(F.col("a") - F.col("phase"))
    sides = marked.drop("doubled").join(centre, keys).groupBy(*keys, "doubled", "r", "phase").agg(F.sum(F.when(near > 0, F.col("w"))).alias("own"), F.sum(F.when(near < 0, F.col("w"))).alias("other"))
    flip = F.col("doubled") & (F.coalesce("other", F.lit(0.0)) > F.coalesce("own", F.lit(0.0)))
    # Rounded before it is wrapped: a centre at midnight is 0 whatever the order its weights were added in, never just under 24.
    hours = F.pmod(F.round((F.col("phase") + F.when(flip, math.pi).otherwise(0.0)) * 12.0 / math.pi, 9), F.lit(24.0))
    spread = S.angular_deviation_deg("r") / 15.0 / F.when(F.col("doubled"), 2.0).otherwise(1.0)
    out = sides.select(*keys, hours.alias("mean_phase_h"), "r", spread.alias("angular_deviation_h"), "doubled")
    return out.withColumns({"onset_h": F.pmod(F.col("mean_phase_h") - F.col("angular_deviation_h"), F.lit(24.0)), "offset_h": F.pmod(F.col("mean_phase_h") + F.col("angular_deviation_h"), F.lit(24.0))})


def gates(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, state, mean_phase_h, angular_deviation_h, onset_h, offset_h, n``: circular mean of phases, mean width."""
    a = F.col("mean_phase_h") * math.pi / 12
    rows = stats.join(groups.select("id", "grp"), "id").groupBy("grp", "state")
    out = rows.agg(F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"), F.avg("angular_deviation_h").alias("angular_deviation_h"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("mean_phase_h", F.pmod(F.atan2("s", "c") * 12 / math.pi, F.lit(24.0))).drop("s", "c")
    return out.withColumns({"onset_h": F.pmod(F.col("mean_phase_h") - F.col("angular_deviation_h"), F.lit(24.0)), "offset_h": F.pmod(F.col("mean_phase_h") + F.col("angular_deviation_h"), F.lit(24.0))})


def rayleigh(phases: DataFrame, by: list[str], phase: str = "mean_phase_h", period: float = 24.0) -> DataFrame:
    """Mean resultant length and its p value, by the usual series in 1/n."""
    a = F.col(phase) * 2 * math.pi / period
    rows = phases.where(F.col(phase).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    z, n = F.col("n") * F.col("r") ** 2, F.col("n")
    rows = rows.withColumn("r", F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)).drop("c", "s")
    series = 1 + (2 * z - z**2) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n**2)
    return rows.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-z) * F.when(n < 50, series).otherwise(F.lit(1.0)))))
