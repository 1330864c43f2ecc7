"""Runs, gaps and rolling windows over readings that are dense in ``t``: the kernel other operators stand on.

Each operator partitions by subject once; windows over the same subject share that partitioning. Sliding
means come from cumulative sums, so their cost does not grow with the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_subject(key: str | list[str] = "id", order: str = "t"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def from_the_end(key: str | list[str] = "id", order: str = "t"):
    """The rows from a subject's last one back to the current one: what follows is read in one pass, as what precedes is."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def run_ids(df: DataFrame, changed: Column, name: str = "run", key: str | list[str] = "id", order: str = "t") -> DataFrame:
    """Number of the run a row is in: one more at every row where ``changed`` is true."""
    return df.withColumn(name, F.sum(F.coalesce(changed, F.lit(False)).cast("int")).over(by_subject(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def value_runs(df: DataFrame, value: str, name: str = "run", key: str | list[str] = "id", order: str = "t") -> DataFrame:
    """Runs of equal values, nulls equal to each other."""
    return run_ids(df, ~F.col(value).eqNullSafe(F.lag(value).over(by_subject(key, order))) , name, key, order)


def rolling_mean(df: DataFrame, value: str, window: int, out: str, *, least: int = 1, key: str = "id", order: str = "t") -> DataFrame:
    """Mean of the measured rows i - w//2 .. i - w//2 + w - 1 of a subject; null below ``least`` measured ones."""
    w = by_subject(key, order)
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    ahead, behind = window - window // 2 - 1, window // 2 + 1
    x = F.col(value).cast("double")
    sums = df.withColumns({"__s": F.coalesce(F.sum(x).over(so_far), F.lit(0.0)), "__n": F.count(x).over(so_far)})
    sums = sums.withColumns({"__ts": F.coalesce(F.sum(x).over(whole), F.lit(0.0)), "__tn": F.count(x).over(whole)})
    total = F.coalesce(F.lead("__s", ahead).over(w), F.col("__ts")) - F.coalesce(F.lag("__s", behind).over(w), F.lit(0.0))
    n = F.coalesce(F.lead("__n", ahead).over(w), F.col("__tn")) - F.coalesce(F.lag("__n", behind).over(w), F.lit(0))
    return sums.withColumn(out, F.when(n >= max(1, least), total / n)).drop("__s", "__n", "__ts", "__tn")


def smoothed(df: DataFrame, value: str, window: int, out: str, **options) -> DataFrame:
    """A centred mean that needs half its window measured."""
    return rolling_mean(df, value, window, out, least=-(-window // 2), **options)


def fill_short_gaps(df: DataFrame, value: str, out: str, *, most: int = 4, size: Column | None = None, key: str = "id", order: str = "t") -> DataFrame:
    """Runs of up to ``most`` missing rows between equal values take that value; edges stay missing.

    ``size`` is how many samples a row stands for, where it is not one.
    """
    w = by_subject(key, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), from_the_end(key, order)
    runs = run_ids(df, F.col(value).isNull() != F.lag(F.col(value).isNull()).over(w), "__run", key, order)
    left, right = F.last(value, ignorenulls=True).over(before), F.last(value, ignorenulls=True).over(after)
    length = F.sum(F.lit(1) if size is None else size).over(Window.partitionBy(key, "__run"))
    return runs.withColumn(out, F.coalesce(value, F.when((length <= most) & (left == right), left))).drop("__run")


def interpolate(df: DataFrame, value: str, out: str, *, key: str = "id", order: str = "t", most_span: int | None = None) -> DataFrame:
    """Interior gaps filled along the line between their neighbours, where these are no more than ``most_span`` apart."""
    w = by_subject(key, order)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), from_the_end(key, order)
    near = df.withColumns(
        {
            "__t0": F.last(at, ignorenulls=True).over(before),
            "__x0": F.last(value, ignorenulls=True).over(before),
            "__t1": F.last(at, ignorenulls=True).over(after),
            "__x1": F.last(value, ignorenulls=True).over(after),
        }
    )
    line = F.col("__x0") + (F.col("__x1") - F.col("__x0")) * (F.col(order) - F.col("__t0")) / (F.col("__t1") - F.col("__t0"))
    ok = F.lit(True) if most_span is None else F.col("__t1") - F.col("__t0") <= most_span
    return near.withColumn(out, F.coalesce(F.col(value).cast("double"), F.when(ok, line))).drop("__t0", "__x0", "__t1", "__x1")


def gaps(df: DataFrame, value: str, *, threshold: int, step: int = 1, key: str = "id", order: str = "t") -> DataFrame:
    """``key, gap_start, gap_end, minutes`` of consecutive measured rows more than ``threshold`` apart."""
    measured = df.where(F.col(value).isNotNull()).select(key, F.col(order).alias("gap_end"), F.lag(order).over(by_subject(key, order)).alias("gap_start"))
    return measured.where(F.col("gap_end") - F.col("gap_start") > threshold).select(key, "gap_start", "gap_end", (F.col("gap_end") - F.col("gap_start")).alias("minutes"))


def longest_segment(df: DataFrame, value: str, *, threshold: int = 60, step: int = 1, key: str = "id", order: str = "t") -> DataFrame:
    """``key, seg_start, seg_end, minutes`` of the longest stretch between runs of missing rows that last ``threshold`` or more.

    The first wins ties. A missing run lasts up to the next measured row; one that reaches the end of the
    record lasts up to its last row, one step less.
    """
    w = by_subject(key, order)
    missing = F.col(value).isNull()
    runs = run_ids(df.select(key, order, missing.alias("__m")), F.col("__m") != F.lag("__m").over(w), "__run", key, order)
    per = runs.groupBy(key, "__run").agg(F.first("__m").alias("m"), F.min(order).alias("a"), F.max(order).alias("b"))
    ahead = F.lead("a").over(by_subject(key, "__run"))
    breaks = per.withColumn("cut", F.col("m") & (F.coalesce(ahead, F.col("b")) - F.col("a") >= threshold))
    pieces = run_ids(breaks, F.col("cut"), "__piece", key, "__run").where(~F.col("cut") & ~F.col("m"))
    spans = pieces.groupBy(key, "__piece").agg(F.min("a").alias("seg_start"), F.max("b").alias("seg_end"))
    best = Window.partitionBy(key).orderBy(F.desc(F.col("seg_end") - F.col("seg_start")), "__piece")
    chosen = spans.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return chosen.select(key, "seg_start", "seg_end", (F.col("seg_end") - F.col("seg_start")).alias("minutes"))


def longest_block(df: DataFrame, value: str, *, bridge: int = 0, step: int = 1, key: str = "id", order: str = "t") -> DataFrame:
    """``key, block_start, block_end, n``: the most measured rows in a row; gaps of up to ``bridge`` minutes are joined.

    The first of the longest by number of samples wins.
    """
    measured = df.where(F.col(value).isNotNull()).select(key, order)
    far = F.col(order) - F.lag(order).over(by_subject(key, order)) > max(step, bridge + step if bridge else step)
    blocks = run_ids(measured, far, "__block", key, order).groupBy(key, "__block").agg(F.min(order).alias("block_start"), F.max(order).alias("block_end"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "__block")
    return blocks.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__block")


def state_runs(df: DataFrame, state: str, *, key: str = "id", order: str = "t") -> DataFrame:
    """``key, state, run, n, run_start``: runs of a state after missing rows are left out, so they join across gaps."""
    measured = df.where(F.col(state).isNotNull()).select(key, order, F.col(state).alias("state"))
    runs = value_runs(measured, "state", "run", key, order)
    return runs.groupBy(key, "run").agg(F.first("state").alias("state"), F.count(F.lit(1)).alias("n"), F.min(order).alias("run_start"))


def running_total(df: DataFrame, value: str, out: str, *, keys: list[str], order: str) -> DataFrame:
    """Cumulative sum with missing values as zero."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))
