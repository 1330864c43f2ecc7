"""Phase responses by regression, phases of groups and their differences with bootstrap limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scalars as S
from .curves import weights
from .phase_shift import one_phase, reference_pulses

#: Hours are rounded to this many places before they are wrapped, so that values half a day apart fall to one side.
PLACES = 9
BASELINES = ("group", "fly", "none")
#: Entrained markers come a day apart; a slope that is off by more than so many minutes a day is a free run.
ENTRAINED_MINUTES = 30.0


def wrap(h) -> Column:
    return S.wrap_hours(F.round(h, PLACES))


def centred_mean(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``by, name``: the circular centre of clock hours plus the mean of their distances from it; null without a centre."""
    a = F.col(value) * math.pi / 12
    centre = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(S.circular_centre(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("__c"))
    near = rows.join(centre, by).groupBy(*by, "__c").agg(F.avg(wrap(F.col(value) - F.col("__c"))).alias("__m"))
    return near.select(*by, (F.col("__c") + F.col("__m")).alias(name))


def regression_phases(found: DataFrame, subjects: DataFrame, *, skip: int = params.SKIP_DAYS, min_post: int = params.MIN_POST_DAYS, periods: tuple[float, float] = params.PERIOD_RANGE, slope: str = "own") -> DataFrame:
    """``id, status, pre_phase_hours, post_phase_hours, period_hours, n_days_used``: phases on the day after the pulse.

    After: a line through the markers from that day (and ``skip``) on, read on it; its slope is the period. Before: the
    centre of the markers' clock times, or their line read on that day where they run free (a slope over half an hour off a
    day). Either side keeps to one light phase. With ``slope`` "arm" the line after the pulse has the mean slope of the
    subject's group and only its height is the subject's own, for records too short for a slope.
    """
    if slope not in ("own", "arm"):
        raise ValueError(f"slope must be own or arm, not {slope}")
    rows = one_phase(found, subjects, skip)
    ref = F.col("pulse_day") + 1
    x, y = (F.col("day") - ref).cast("double"), F.col("minute") - ref * 1440.0
    clock = (F.col("minute") - F.col("day") * 1440.0) / 60.0
    rows = rows.select("id", "side", x.alias("x"), y.alias("y"), clock.alias("h"))
    pre, post = F.col("side") == "pre", F.col("side") == "post"
    a = F.col("h") * math.pi / 12
    lines = rows.groupBy("id").agg(
        F.count(F.when(post, 1)).alias("n_post"),
        F.count(F.when(pre, 1)).alias("n_pre"),
        F.regr_slope(F.when(post, F.col("y")), F.when(post, F.col("x"))).alias("slope"),
        F.avg(F.when(post, F.col("y"))).alias("ym"),
        F.avg(F.when(post, F.col("x"))).alias("xm"),
        F.regr_slope(F.when(pre, F.col("y")), F.when(pre, F.col("x"))).alias("pre_slope"),
        F.regr_intercept(F.when(pre, F.col("y")), F.when(pre, F.col("x"))).alias("pre_at"),
        S.circular_centre(F.avg(F.when(pre, F.sin(a))), F.avg(F.when(pre, F.cos(a)))).alias("c"),
    )
    before = rows.where(pre).join(lines.select("id", "c"), "id").groupBy("id").agg(F.avg(wrap(F.col("h") - F.col("c"))).alias("m"))
    out = lines.join(before, "id", "left")
    enough = F.col("n_post") >= max(2, min_post)
    if slope == "arm":
        arm = out.where(enough).join(subjects.select("id", "grp"), "id").groupBy("grp").agg(F.avg("slope").alias("arm"))
        out = out.join(subjects.select("id", "grp"), "id").join(arm, "grp", "left").withColumn("slope", F.col("arm")).drop("grp", "arm")
        enough = F.col("n_post") >= 1
    period = F.col("slope") / 60.0
    status = F.when(~enough, "insufficient_post").when(F.col("n_pre") < 1, "insufficient_pre").when(period.between(*periods), "ok").otherwise("implausible_period")
    free = (F.col("n_pre") >= 2) & (F.round(F.abs(F.col("pre_slope") - 1440.0), PLACES) > ENTRAINED_MINUTES)
    before_hours = F.when(free, F.col("pre_at") / 60.0).otherwise(F.col("c") + F.col("m"))
    after_hours = (F.col("ym") - F.col("slope") * F.col("xm")) / 60.0
    fitted = out.select("id", status.alias("status"), before_hours.alias("pre"), after_hours.alias("post"), period.alias("period"), "n_post")
    good = F.col("status") == "ok"
    day = lambda c: F.when(good, F.pmod(F.round(F.col(c), PLACES), F.lit(24.0)))
    told = fitted.select("id", "status", day("pre").alias("pre_phase_hours"), day("post").alias("post_phase_hours"), F.when(F.col("status").isin("ok", "implausible_period"), F.col("period")).alias("period_hours"), F.col("n_post").alias("n_days_used"))
    return subjects.select("id").join(told, "id", "left").withColumns({"status": F.coalesce("status", F.lit("insufficient_post")), "n_days_used": F.coalesce("n_days_used", F.lit(0).cast("bigint"))})


def regression_responses(found: DataFrame, subjects: DataFrame, controls: DataFrame, *, baseline: str = "group", **options) -> DataFrame:
    """``id, grp, control_grp, response_hours, response_hours_raw, n_days_used, baseline_used, pre_phase_hours, post_phase_hours, period_hours``.

    The control group's mean phase less the subject's, so an advance is positive; less what the groups ("group") or the
    subject and the controls ("fly") were apart before the pulse, or nothing ("none"). Subjects without a phase, or whose
    control has none, have no row (see ``dropped``). A control group is its own control where ``controls`` says so.
    """
    if baseline not in BASELINES:
        raise ValueError(f"baseline must be one of {BASELINES}, not {baseline}")
    phases = regression_phases(found, subjects, **options).where("status = 'ok'").join(subjects.select("id", "grp"), "id")
    phases = phases.withColumn("change", wrap(F.col("post_phase_hours") - F.col("pre_phase_hours")))
    means = None
    for value, name in (("pre_phase_hours", "pre_mean"), ("post_phase_hours", "post_mean"), ("change", "change_mean")):
        part = centred_mean(phases, value, ["grp"], name)
        means = part if means is None else means.join(part, "grp")
    other = means.select(F.col("grp").alias("control_grp"), F.col("pre_mean").alias("c_pre"), F.col("post_mean").alias("c_post"), F.col("change_mean").alias("c_change"))
    rows = phases.join(controls.select("grp", "control_grp"), "grp").join(other, "control_grp").join(means.select("grp", "pre_mean"), "grp")
    raw = -wrap(F.col("post_phase_hours") - F.col("c_post"))
    response = {"group": raw + wrap(F.col("pre_mean") - F.col("c_pre")), "fly": -wrap(F.col("change") - F.col("c_change")), "none": raw}[baseline]
    return rows.select("id", "grp", "control_grp", response.alias("response_hours"), raw.alias("response_hours_raw"), "n_days_used", F.lit(baseline != "none").alias("baseline_used"), "pre_phase_hours", "post_phase_hours", "period_hours")


def dropped(responses: DataFrame, subjects: DataFrame) -> DataFrame:
    """``grp, n_dropped, n_total``: subjects of each group without a response."""
    rows = subjects.select("id", "grp").join(responses.select("id", F.lit(1).alias("__has")), "id", "left")
    return rows.groupBy("grp").agg(F.count(F.when(F.col("__has").isNull(), 1)).alias("n_dropped"), F.count(F.lit(1)).alias("n_total"))


def origin_days(subjects: DataFrame) -> DataFrame:
    """``grp, origin``: the day of release of each group; a group released on different days raises."""
    days = subjects.groupBy("grp").agg(F.min(F.rint(F.col("split_minute") / 1440)).alias("a"), F.max(F.rint(F.col("split_minute") / 1440)).alias("b"), F.count("split_minute").alias("n"), F.count(F.lit(1)).alias("m"))
    if mixed := [r["grp"] for r in days.where("a IS NULL OR a <> b OR n < m").collect()]:  # as many as groups
        raise ValueError(f"groups without one day of release: {mixed}")
    return days.select("grp", F.col("a").cast("int").alias("origin"))


def _clock(found: DataFrame, groups: DataFrame, origins: DataFrame | None) -> DataFrame:
    rows = found.join(groups.select("id", "grp"), "id").select("id", "grp", "day", F.round((F.col("minute") - F.col("day") * 1440.0) / 60.0, PLACES).alias("h"))
    return rows if origins is None else rows.join(origins, "grp").withColumn("day", F.col("day") - F.col("origin")).drop("origin")


def _phases(weighted: DataFrame, by: list[str]) -> DataFrame:
    """``by, peak_hours``: centre plus weighted median of the distances from it, of rows ``h`` with whole weights ``w``.

    Rows are clock times, not subjects: equal times have been added up before, so a window holds at most the samples of a day.
    """
    own = Window.partitionBy(*by)
    a = F.col("h") * math.pi / 12
    total = F.sum("w").over(own)
    centre = S.circular_centre(F.sum(F.col("w") * F.sin(a)).over(own) / total, F.sum(F.col("w") * F.cos(a)).over(own) / total)
    rows = weighted.withColumn("c", centre).where("c IS NOT NULL").withColumn("d", wrap(F.col("h") - F.col("c")))
    return rows.groupBy(*by).agg(F.round(F.first("c") + F.percentile("d", F.lit(0.5), F.col("w")), PLACES).alias("peak_hours"))


def _differences(peaks: DataFrame, controls: DataFrame, by: list[str], baseline_day: int | None) -> DataFrame:
    """``grp, control_grp, by, phase_difference_hours, from_baseline_hours``."""
    other = peaks.select(F.col("grp").alias("control_grp"), *by, F.col("peak_hours").alias("control_peak_hours"))
    met = peaks.join(controls.select("grp", "control_grp"), "grp").join(other, ["control_grp", *by])
    rows = met.withColumn("phase_difference_hours", wrap(F.col("peak_hours") - F.col("control_peak_hours")))
    if baseline_day is None:
        return rows.withColumn("from_baseline_hours", F.lit(None).cast("double"))
    keys = [c for c in by if c != "day"]
    base = rows.where(F.col("day") == baseline_day).select("grp", "control_grp", *keys, F.col("phase_difference_hours").alias("__base"))
    return rows.join(base, ["grp", "control_grp", *keys], "left").withColumn("from_baseline_hours", F.round(F.col("phase_difference_hours") - F.col("__base"), PLACES)).drop("__base")


def phase_differences(found: DataFrame, groups: DataFrame, controls: DataFrame, *, baseline_day: int | None = None, origins: DataFrame | None = None) -> DataFrame:
    """``grp, control_grp, day, peak_hours, control_peak_hours, phase_difference_hours, from_baseline_hours, n``.

    A group's phase on a day is the circular centre of its subjects' clock times (which may run past midnight) plus the
    median of their distances from it; without a centre there is none. Days count from ``origins`` (see
    ``origin_days``) or the record's start. ``from_baseline_hours`` is the change since ``baseline_day``.
    """
    rows = _clock(found, groups, origins)
    hist = rows.groupBy("grp", "day", "h").agg(F.count(F.lit(1)).alias("w"))
    peaks = _phases(hist, ["grp", "day"])
    counts = rows.groupBy("grp", "day").agg(F.count(F.lit(1)).alias("n"))
    return _differences(peaks, controls, ["day"], baseline_day).join(counts, ["grp", "day"]).select("grp", "control_grp", "day", "peak_hours", "control_peak_hours", "phase_difference_hours", "from_baseline_hours", "n")


def _weighted(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """``grp, day, h, r, w``: the weights that a clock time of a day draws in each resample, added up over its subjects; zeros go."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key, schema = ["grp", "day", "h"], f"grp {kinds['grp']}, day {kinds['day']}, h double, ws array<bigint>"
    held = rows.where("grp IS NOT NULL AND h IS NOT NULL").groupBy("grp", F.col("id").cast("string").alias("id")).agg(F.collect_list("day").alias("days"), F.collect_list("h").alias("hs"))

    def out(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, w) for k, w in sums.items()], columns=[*key, "ws"])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for grp, subject, days, hs in zip(batch["grp"], batch["id"], batch["days"], batch["hs"]):
                w = weights(subject, resamples, seed)
                for day, h in zip(days, hs):
                    at = grp, day, h
                    sums[at] = sums[at] + w if at in sums else w
                if len(sums) * resamples > 1 << 23:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    def merge(batches):
        now, total = None, None
        for batch in batches:
            done = []
            for *at, w in batch[[*key, "ws"]].itertuples(index=False):
                if at != now and now is not None:
                    done.append((*now, total))
                now, total = at, (total + w if at == now else w)
            if done:
                yield pd.DataFrame(done, columns=[*key, "ws"])
        if now is not None:
            yield pd.DataFrame([(*now, total)], columns=[*key, "ws"])

    parts = held.mapInPandas(add, schema).repartition(*key).sortWithinPartitions(*key).mapInPandas(merge, schema)
    return parts.select(*key, F.posexplode("ws").alias("r", "w")).where("w > 0")


def bootstrap_differences(found: DataFrame, groups: DataFrame, controls: DataFrame, *, resamples: int = 200, seed: int = 0, ci: float = 95.0, baseline_day: int | None = None, origins: DataFrame | None = None) -> DataFrame:
    """``grp, control_grp, day``, then ``_sd, _low, _high`` of the phase difference and of that from the baseline, and ``n_ok``.

    Every resample makes the whole statistic again: subjects draw Poisson weights, and centres, medians, differences and
    the baseline follow from them, so that the control's uncertainty counts as well. Tasks add weights up by clock time,
    one packed array of all resamples for each, so no row of a subject and resample is made. ``n_ok`` is the number of resamples in which both groups had a phase.
    """
    if resamples < 2:
        raise ValueError("resamples must be two or more")
    hist = _weighted(_clock(found, groups, origins), resamples, seed)
    drawn = _differences(_phases(hist, ["grp", "day", "r"]), controls, ["day", "r"], baseline_day)
    tail, aggs = (100 - ci) / 200, []
    for c, name in (("phase_difference_hours", "phase_difference"), ("from_baseline_hours", "from_baseline")):
        two = F.count(c) >= 2
        aggs += [F.when(two, F.stddev_samp(c)).alias(f"{name}_sd"), F.when(two, F.percentile(c, F.lit(tail))).alias(f"{name}_low"), F.when(two, F.percentile(c, F.lit(1 - tail))).alias(f"{name}_high")]
    return drawn.groupBy("grp", "control_grp", "day").agg(*aggs, F.count("phase_difference_hours").alias("n_ok"))
