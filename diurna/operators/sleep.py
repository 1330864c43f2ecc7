"""Sleep from immobility: bouts, states, minutes, durations. Window functions from end to end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Sleep
from . import runs

STATES = ("short", "intermediate", "long")


def state_of(duration: str | Column, settings: Sleep = Sleep()) -> Column:
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.when(d < settings.short_max_minutes, "short").when(d < settings.intermediate_max_minutes, "intermediate").otherwise("long")


def marked_minutes(readings: DataFrame, settings: Sleep = Sleep(), step: int = 1, inclusive_minutes: bool = False) -> DataFrame:
    """``id, t, moving, filled, run, sleep, state, bout_start, bout_end, duration_min``.

    Short gaps between equal values are bridged; a run of immobility lasts from its first to its last minute
    (so N minutes last N - 1, unless ``inclusive_minutes``). ``sleep`` is null on missing minutes, bridged ones too.

    With a column ``t_end`` each row is a stretch of equal minutes from ``t`` to there, and the result has ``t_end`` and
    ``n``, their number, too.
    """
    long = "t_end" in readings.columns
    size = ((F.col("t_end") - F.col("t")) / step + 1).cast("bigint")
    rows = readings.select("id", "t", "moving", *(["t_end", size.alias("n")] if long else []))
    filled = runs.fill_short_gaps(rows, "moving", "filled", most=settings.bridge_minutes // step if step > 1 else settings.bridge_minutes, size=F.col("n") if long else None)
    numbered = runs.value_runs(filled, "filled", "run")
    own = Window.partitionBy("id", "run")
    spans = numbered.withColumns({"bout_start": F.min("t").over(own), "bout_end": F.max("t_end" if long else "t").over(own)})
    duration = (F.col("bout_end") - F.col("bout_start") + (step if inclusive_minutes else 0)).cast("double")
    spans = spans.withColumn("duration_min", duration)
    asleep = (F.col("filled") == 0) & (F.col("duration_min") * 60 >= settings.threshold_seconds)
    sleep = F.when(F.col("moving").isNotNull(), F.coalesce(asleep, F.lit(False)).cast("tinyint"))
    return spans.withColumns({"sleep": sleep, "state": F.when(asleep, state_of("duration_min", settings))})


def minutes(marked: DataFrame) -> DataFrame:
    """``id, t, sleep, sleep_short, sleep_intermediate, sleep_long``; missing minutes are null in all. Of stretches, ``t_end`` and ``n`` too."""
    masks = {f"sleep_{s}": F.when(F.col("sleep").isNotNull(), (F.coalesce(F.col("state") == s, F.lit(False))).cast("tinyint")) for s in STATES}
    return marked.select("id", "t", "sleep", *[c.alias(n) for n, c in masks.items()], *[c for c in ("t_end", "n") if c in marked.columns])


def each_minute(stretches: DataFrame, step: int = 1) -> DataFrame:
    """A row for each minute of stretches."""
    rest = [c for c in stretches.columns if c not in ("t", "t_end", "n")]
    return stretches.select(F.explode(F.sequence("t", "t_end", F.lit(step))).alias("t"), *rest)


def bouts(marked: DataFrame) -> DataFrame:
    """``id, bout, start_t, end_t, duration_min, state`` in order of time, numbered from 1."""
    found = marked.where(F.col("state").isNotNull()).groupBy("id", "run").agg(
        F.first("bout_start").alias("start_t"), F.first("bout_end").alias("end_t"), F.first("duration_min").alias("duration_min"), F.first("state").alias("state")
    )
    number = F.row_number().over(Window.partitionBy("id").orderBy("start_t"))
    return found.select("id", number.alias("bout"), "start_t", "end_t", "duration_min", "state")


def bouts_in_view(found: DataFrame, view: DataFrame, value: str = "activity") -> DataFrame:
    """Bouts that start between a subject's first and last measured minute of a view: a range join on two numbers a subject."""
    seen = F.when(F.col(value).isNotNull(), F.col("t"))
    span = view.groupBy("id").agg(F.min(seen).alias("__lo"), F.max(seen).alias("__hi"))
    return found.join(span, "id").where(F.col("start_t").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def reclassified(found: DataFrame, settings: Sleep) -> DataFrame:
    """The same bouts under other state bounds."""
    return found.withColumn("state", state_of("duration_min", settings))


def minutes_of_bouts(found: DataFrame, asleep: DataFrame, step: int = 1) -> DataFrame:
    """States of minutes asleep from bouts: ``id, t, state, bout``, the last two null outside of bouts.

    A subject's bouts do not overlap, so the bout of a minute is the last one that began, if it has not ended: one window
    over the subject, and no minute is shuffled that already lies with its subject.
    """
    none = F.lit(None)
    starts = found.select("id", F.col("start_t").alias("t"), F.struct("start_t", "end_t", "state", "bout").alias("b"))
    kind = starts.schema["b"].dataType
    both = asleep.where("sleep = 1").select("id", "t", none.cast(kind).alias("b")).unionByName(starts)
    last = F.last("b", ignorenulls=True).over(Window.partitionBy("id").orderBy("t", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("last", last).where("b IS NULL")
    inside = (F.col("t") <= F.col("last.end_t")) & ((F.col("t") - F.col("last.start_t")) % step == 0)
    return rows.select("id", "t", F.when(inside, F.col("last.state")).alias("state"), F.when(inside, F.col("last.bout")).alias("bout"))


def bout_summary(found: DataFrame) -> DataFrame:
    """``id, n_bouts, median_duration_min, log_mean_duration_min``."""
    geometric = F.pow(F.lit(10.0), F.avg(F.log10("duration_min")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_bouts"), F.percentile("duration_min", F.lit(0.5)).alias("median_duration_min"), geometric.alias("log_mean_duration_min"))


def survival(found: DataFrame, points: int = 200, least: int = 2) -> DataFrame:
    """``id, x, y``: share of a subject's bouts longer than x, on one linear grid over all bouts.

    Bouts are counted per grid step and summed from above, so rows grow with subjects and points only.
    """
    counted = found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where(F.col("__n") >= least)
    span = counted.agg(F.min("duration_min").alias("lo"), F.max("duration_min").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    # The number of grid points below a duration: a bout counts at each of them.
    below = F.when(F.col("hi") > F.col("lo"), F.ceil((F.col("duration_min") - F.col("lo")) / step - 1e-9)).otherwise(F.lit(0))
    placed = counted.join(F.broadcast(span)).select("id", "__n", below.cast("int").alias("k")).groupBy("id", "__n", "k").agg(F.count(F.lit(1)).alias("c"))
    grid = counted.select("id", "__n").distinct().join(F.broadcast(span)).select("id", "__n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"), (F.col("lo")).alias("lo"), step.alias("step"))
    above = grid.join(placed.withColumnRenamed("k", "j").select("id", "j", "c"), ["id", "j"], "left")
    over = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    return above.select("id", "j", (F.col("lo") + F.col("j") * F.col("step")).alias("x"), ((F.col("__n") - over) / F.col("__n")).alias("y"))


def duration_density(found: DataFrame, points: int = 200, least: int = 2, factor: float = 0.3) -> DataFrame:
    """``id, x, y``: Gaussian kernel density of log10 durations on a log grid over all bouts.

    Equal durations are counted first. Subjects with fewer bouts, or one duration only, have no curve.
    """
    logs = found.withColumn("v", F.log10("duration_min"))
    per = logs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd")).where((F.col("n") >= least) & (F.col("sd") > 0))
    span = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"), "lo", "hi").select("j", (F.col("lo") + F.col("j") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("g"))
    distinct = logs.groupBy("id", "v").agg(F.count(F.lit(1)).alias("c")).join(per, "id")
    spread = F.col("sd") * factor
    kernel = F.col("c") * F.exp(-0.5 * F.pow((F.col("g") - F.col("v")) / spread, 2)) / (F.col("n") * spread * math.sqrt(2 * math.pi))
    return distinct.join(F.broadcast(grid)).groupBy("id", "j", "g").agg(F.sum(kernel).alias("y")).select("id", "j", F.pow(F.lit(10.0), "g").alias("x"), "y")
