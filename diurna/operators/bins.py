"""Profiles over the day, totals, and group summaries. Every (subject, bin) has a row; unmeasured ones are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def zt_bins(readings: DataFrame, value: str = "activity", bin_minutes: int = 30, how: str = "mean", key: str = "id") -> DataFrame:
    """``id, zt_bin_minute, value``: minutes with the same clock time pooled over days."""
    if how not in ("mean", "sum"):
        raise ValueError("how must be mean or sum")
    agg = (F.avg if how == "mean" else F.sum)(F.col(value).cast("double"))
    measured = readings.groupBy(key, S.zt_bin("t", bin_minutes).alias("zt_bin_minute")).agg(agg.alias("value"))
    grid = measured.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(1440 - bin_minutes), F.lit(bin_minutes))).alias("zt_bin_minute"))
    return grid.join(measured, [key, "zt_bin_minute"], "left")


def zt_profile(binned: DataFrame, groups: DataFrame, bin_minutes: int = 30, percent: bool = False) -> DataFrame:
    """``grp, zt_bin_minute, mean_val, sem_val, n, zt_hours``; the error of one value is zero."""
    x = F.col("value") * (100.0 if percent else 1.0)
    rows = binned.join(groups.select("id", "grp"), "id").groupBy("grp", "zt_bin_minute")
    out = rows.agg(F.avg(x).alias("mean_val"), S.sem(x, 0.0).alias("sem_val"), F.count(x).alias("n"))
    return out.withColumn("zt_hours", S.closing_edge_hours("zt_bin_minute", bin_minutes))


def group_summary(binned: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, zt_bin_minute, mean, sd, n`` with the sample deviation."""
    return binned.join(groups.select("id", "grp"), "id").groupBy("grp", "zt_bin_minute").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))


def daily_totals(binned: DataFrame, bin_minutes: int = 30, window: tuple[float, float] | None = None) -> DataFrame:
    """``id, all_day, day_only, night_only[, custom]``: bin means times the bin's width. Nothing measured is zero."""
    x = F.col("value") * bin_minutes
    day = F.col("zt_bin_minute") < 720
    parts = {"all_day": F.lit(True), "day_only": day, "night_only": ~day}
    if window:
        parts["custom"] = S.in_zt_window("zt_bin_minute", *window)
    return binned.groupBy("id").agg(*[F.coalesce(F.sum(F.when(c, x)), F.lit(0.0)).alias(n) for n, c in parts.items()])


def group_totals(totals: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: n, and mean and error of each total (zero for one subject)."""
    names = [c for c in totals.columns if c != "id"]
    aggs = [f(F.col(c)).alias(a) for c in names for f, a in ((F.avg, c), (lambda x: S.sem(x, 0.0), f"{c}_sem"))]
    return totals.join(groups.select("id", "grp"), "id").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *aggs)


def state_totals(minutes: DataFrame, states: list[str], percent: bool = False) -> DataFrame:
    """Minutes of each subject in each 0/1 state, or their share of all of them; a row counts ``n`` times where it has that."""
    n = F.col("n") if "n" in minutes.columns else F.lit(1)
    sums = minutes.groupBy("id").agg(*[F.sum(F.col(s).cast("bigint") * n).alias(s) for s in states])
    if not percent:
        return sums
    whole = sum((F.coalesce(F.col(s), F.lit(0)) for s in states[1:]), F.coalesce(F.col(states[0]), F.lit(0)))
    return sums.select("id", *[F.when(whole > 0, 100.0 * F.col(s) / whole).alias(s) for s in states])


def state_bars(totals: DataFrame, groups: DataFrame, states: list[str]) -> DataFrame:
    """``grp, state, mean, sem, n`` of per-subject totals."""
    long = totals.join(groups.select("id", "grp"), "id").unpivot(["id", "grp"], states, "state", "value")
    return long.groupBy("grp", "state").agg(F.avg("value").alias("mean"), S.sem("value", 0.0).alias("sem"), F.count("value").alias("n"))


def rebin(readings: DataFrame, value: str, samples: int, step: int = 1, key: str = "id") -> DataFrame:
    """Sums over ``samples`` consecutive rows from each subject's start; the partial last bin goes, empty bins are null."""
    first = F.min("t").over(Window.partitionBy(key))
    width = samples * step
    rows = readings.withColumn("bin", F.floor((F.col("t") - first) / width).cast("int"))
    out = rows.groupBy(key, "bin").agg(F.min("t").alias("t"), F.sum(F.col(value).cast("double")).alias(value), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == samples).drop("__n")


def heatmap(readings: DataFrame, value: str, bin_minutes: int, key: str = "id") -> DataFrame:
    """``id, bin, value``: mean of the measured minutes of every bin of the record; -1 where none is."""
    binned = readings.groupBy(key, F.floor(F.col("t") / bin_minutes).cast("int").alias("bin"))
    return binned.agg(F.coalesce(F.avg(F.col(value).cast("double")), F.lit(-1.0)).alias("value"))


def aligned_to_release(readings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows from each subject's own boundary on, with minutes from there."""
    cut = subjects.where("split_minute IS NOT NULL").select("id", "split_minute")
    return readings.join(cut, "id").where("t >= split_minute").withColumn("t", F.col("t") - F.col("split_minute")).drop("split_minute")


def scaled_curves(curves: DataFrame, x: str = "x", y: str = "y", key: str = "id") -> DataFrame:
    """Each subject's curve over its own maximum; subjects whose maximum is not positive go."""
    top = F.max(y).over(Window.partitionBy(key))
    return curves.withColumn("__top", top).where("__top > 0").withColumn(y, F.col(y) / F.col("__top")).drop("__top")


def mean_curves(curves: DataFrame, groups: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Point-wise group mean and error of curves over the finite values."""
    ok = curves.where(F.col(y).isNotNull() & ~F.isnan(y)).join(groups.select("id", "grp"), "id")
    return ok.groupBy("grp", x).agg(F.avg(y).alias("mean"), S.sem(y).alias("sem"), F.count(y).alias("n"))


def metric_summary(values: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """n, mean, sd, median and quartiles of one value per subject."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    aggs += [F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.5, "median"), (0.25, "q1"), (0.75, "q3"))]
    return values.groupBy(*(by or ["grp"])).agg(*aggs)


def pivot_groups(frame: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    """A wide table with one column for each of ``values``, in that order."""
    return frame.groupBy(rows).pivot(columns, values).agg(F.first(value))


def with_group_means(frame: DataFrame, value: str) -> DataFrame:
    """Rows of subjects and, after each group, its mean (a null id marks it)."""
    return frame.groupingSets([[F.col("grp"), F.col("id")], [F.col("grp")]], "grp", "id").agg(F.avg(value).alias(value)).orderBy("grp", F.col("id").asc_nulls_last())


def group_actogram(readings: DataFrame, groups: DataFrame, bin_minutes: int = 30, step: int = 1, value: str = "activity") -> DataFrame:
    """``grp, day, bin, value``: bin sums of each subject averaged over the measured ones; a partial last day goes."""
    per = readings.groupBy("id", S.day_index("t").alias("day"), S.zt_bin("t", bin_minutes).alias("bin")).agg(F.sum(value).alias("x"), F.count(F.lit(1)).alias("rows"))
    mean = per.join(groups.select("id", "grp"), "id").groupBy("grp", "day", "bin").agg(F.avg("x").alias("value"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("grp", "day")) == 1440 // bin_minutes
    return mean.withColumn("__whole", whole).where("__whole").drop("__whole")


def double_plotted(actogram: DataFrame) -> DataFrame:
    """``grp, row, place, bin, value``: row i holds day i and the day after it; nulls where there is none."""
    own = actogram.select("grp", F.col("day").alias("row"), F.lit(0).alias("place"), "bin", "value")
    after = actogram.select(F.col("grp").alias("g"), (F.col("day") - 1).alias("d"), F.col("bin").alias("b"), F.col("value").alias("v"))
    keys = own.select("grp", "row", "bin")
    second = keys.join(after, (F.col("grp") == F.col("g")) & (F.col("row") == F.col("d")) & (F.col("bin") == F.col("b")), "left")
    return own.unionByName(second.select("grp", "row", F.lit(1).alias("place"), "bin", F.col("v").alias("value")))


def group_boundaries(subjects: DataFrame) -> DataFrame:
    """``grp, split_minute, mixed``: the earliest boundary, and whether the group's subjects disagree."""
    return subjects.groupBy("grp").agg(F.min("split_minute").alias("split_minute"), (F.countDistinct("split_minute") > 1).alias("mixed"))


def align_on_release(readings: DataFrame, subjects: DataFrame, min_ld_days: int = 2) -> DataFrame:
    """Shifts by whole days so that boundaries fall on the earliest one; subjects with fewer LD days go."""
    cut = subjects.where(F.col("split_minute") >= min_ld_days * 1440).select("id", "split_minute")
    least = cut.agg(F.min("split_minute").alias("least"))
    shift = cut.join(F.broadcast(least)).select("id", (F.floor((F.col("split_minute") - F.col("least")) / 1440) * 1440).cast("int").alias("shift"))
    return readings.join(shift, "id").withColumn("t", F.col("t") - F.col("shift")).where("t >= 0").drop("shift")


def ld_bins(actogram: DataFrame, boundaries: DataFrame, bin_minutes: int = 30) -> DataFrame:
    """Marks bins that lie wholly before the group's boundary."""
    end = F.col("day") * 1440 + F.col("bin") + bin_minutes
    return actogram.join(boundaries.select("grp", "split_minute"), "grp").withColumn("is_ld", F.coalesce(end <= F.col("split_minute"), F.lit(False))).drop("split_minute")


def panel_scale(actogram: DataFrame) -> DataFrame:
    """``grp, scale``: 1.1 times the range of a panel."""
    return actogram.groupBy("grp").agg((1.1 * (F.max("value") - F.min("value"))).alias("scale"))
