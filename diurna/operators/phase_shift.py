"""Daily phase markers, shifts across a pulse, phase responses and differences between groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import numeric as N
from ..functions import scalars as S


def mask_pulse(readings: DataFrame, subjects: DataFrame, value: str = "activity", duration_minutes: int = 60) -> DataFrame:
    """``value`` null from the pulse for its duration."""
    rows = readings.join(subjects.select("id", F.col("pulse_minute").alias("__p")), "id", "left")
    inside = (F.col("t") >= F.col("__p")) & (F.col("t") < F.col("__p") + duration_minutes)
    return rows.withColumn(value, F.when(~F.coalesce(inside, F.lit(False)), F.col(value))).drop("__p")


def reference_pulses(subjects: DataFrame) -> DataFrame:
    """``id, reference_minute``: the own pulse; else the boundary less a day plus the pulsed ones' median offset."""
    offset = subjects.where("pulse_minute IS NOT NULL AND split_minute IS NOT NULL").agg(F.percentile(F.col("pulse_minute") - F.col("split_minute") + 1440, F.lit(0.5)).alias("__o"))
    middle = subjects.agg(F.percentile("pulse_minute", F.lit(0.5)).alias("__m"))
    rows = subjects.join(F.broadcast(offset)).join(F.broadcast(middle))
    own = F.coalesce("pulse_minute", F.col("split_minute") - 1440 + F.col("__o"), "__m")
    return rows.select("id", own.cast("double").alias("reference_minute"))


def one_phase(found: DataFrame, subjects: DataFrame, skip: int = params.SKIP_DAYS) -> DataFrame:
    """``found`` with ``pulse_day, side``: the markers before and after the pulse day (``skip`` days are left out after it).

    A side keeps to the light phase of its day next to the pulse, for a line across the boundary would be one through a
    kink; a day that the boundary falls in belongs to neither side. Without a boundary all days are of one phase.
    """
    split = F.col("split_minute") if "split_minute" in subjects.columns else F.lit(None).cast("int")
    own = reference_pulses(subjects.withColumn("split_minute", split)).join(subjects.select("id", split.alias("__split")), "id")
    own = own.where("reference_minute IS NOT NULL").select("id", "__split", F.floor(F.col("reference_minute") / 1440).cast("int").alias("pulse_day"))
    phase = lambda day: S.day_phase(day, F.col("__split"))
    first = F.col("pulse_day") + 1 + skip
    pre = F.when(phase(F.col("pulse_day") - 1) != "mixed", phase(F.col("pulse_day") - 1)).otherwise(phase(F.col("pulse_day") - 2))
    post = F.when(phase(first) != "mixed", phase(first)).otherwise(phase(first + 1))
    rows = found.join(own.withColumns({"__pre": pre, "__post": post}), "id")
    side = F.when((F.col("day") < F.col("pulse_day")) & (phase(F.col("day")) == F.col("__pre")), "pre").when((F.col("day") >= first) & (phase(F.col("day")) == F.col("__post")), "post")
    return rows.withColumn("side", side).where("side IS NOT NULL").drop("__split", "__pre", "__post")


def _peak(x: np.ndarray, step: int) -> int | None:
    ok = np.isfinite(x)
    if ok.sum() < 4 or np.ptp(x[ok]) == 0:
        return None
    y = np.where(ok, x, x[ok].min())
    found = N.find_peaks(y, max(1, int(params.DISTANCE_HOURS * 60 / step)), params.PROMINENCE * float(np.ptp(y)))
    return int(found[np.argmax(y[found])] if len(found) else np.argmax(y))


def _onset(x: np.ndarray, level: float, seed: bool) -> int | None:
    """The first rise above the level, for a seed after the longest quiet run."""
    ok = np.isfinite(x)
    if ok.sum() < 4:
        return None
    above = np.where(ok, x, -np.inf) >= level
    rises = np.flatnonzero(above[1:] & ~above[:-1]) + 1
    if not len(rises):
        return None
    if not seed:
        return int(rises[0])
    edges = np.flatnonzero(np.diff(np.concatenate(([True], above, [True])).astype(int)) != 0)
    starts, ends = edges[::2], edges[1::2]
    after = ends[int(np.argmax(ends - starts))] if len(starts) else 0
    later = rises[rises >= after]
    return int(later[0] if len(later) else rises[0])


def markers(readings: DataFrame, subjects: DataFrame, method: str = "peak", value: str = "activity", step: int = 1, half_width_hours: float = params.HALF_WIDTH_HOURS) -> DataFrame:
    """``id, day, minute``: one marker a day, before and after the pulse each tracked on its own.

    A side keeps to one light phase. Its first day is searched whole, each later one around the marker before it, a day on; windows
    cross midnight. That makes the search sequential, so it is one grouped function per subject.
    """
    key = readings.schema["id"].dataType.simpleString()
    boundary = subjects.select("id", (F.col("split_minute") if "split_minute" in subjects.columns else F.lit(None)).cast("double").alias("split"))
    rows = readings.select("id", "t", F.col(value).cast("double").alias("x")).join(reference_pulses(subjects), "id", "left").join(boundary, "id", "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, x = pdf["t"].to_numpy(float), pdf["x"].to_numpy(float)
        pulse = pdf["reference_minute"].iloc[0]
        if method == "peak":
            y = N.preprocess(x, params.Preprocess(lowpass_hours=params.LOWPASS_HOURS), step)
        else:
            w = max(1, params.ONSET_SMOOTH_MINUTES // step)
            y = N.rolling_mean(x, w, -(-w // 2))
            level = params.ONSET_LEVEL * float(np.nanmean(x)) if np.isfinite(x).any() else 0.0
        days = np.unique(t // 1440).astype(int)
        cut = pulse // 1440 if pulse == pulse and pulse is not None else math.inf
        out = []
        split = pdf["split"].iloc[0]
        for side, next_to in ((days[days < cut], -1), (days[days > cut], 0)):
            if split == split and math.isfinite(cut) and len(side):  # a side keeps to the light phase of its day next to the pulse
                phases = np.where((side + 1) * 1440 <= split, 0, np.where(side * 1440 >= split, 1, 2))
                whole = phases[phases < 2]
                side = side[phases == whole[next_to]] if len(whole) else side[:0]
            last = None
            for day in side:
                lo, hi = day * 1440.0, day * 1440.0 + 1440
                if last is not None:
                    middle = last[1] + 1440.0 * (day - last[0])
                    lo, hi = middle - half_width_hours * 60, middle + half_width_hours * 60
                inside = np.flatnonzero((t >= lo) & (t < hi))
                at = _peak(y[inside], step) if method == "peak" else _onset(y[inside], level, last is None)
                if at is not None:
                    last = (day, float(t[inside[at]]))
                    out.append(last)
        frame = pd.DataFrame(out, columns=["day", "minute"])
        frame.insert(0, "id", pdf["id"].iloc[0])
        return frame

    return rows.groupBy("id").applyInPandas(one, f"id {key}, day int, minute double")


def shifts(found: DataFrame, subjects: DataFrame, min_pre: int = params.MIN_PRE_DAYS, min_post: int = params.MIN_POST_DAYS, skip: int = params.SKIP_DAYS, periods: tuple[float, float] = params.PERIOD_RANGE) -> DataFrame:
    """``id, status, phase_shift_hours, n_pre_days, n_post_days, pre_period, post_period, pre_r2, post_r2``.

    Lines through the markers before and after the pulse, each side in one light phase; the shift is their difference on
    the pulse day, wrapped by the later period. A delay is positive.
    """
    rows = one_phase(found, subjects.where("pulse_minute IS NOT NULL"), skip).withColumn("d", (F.col("day") - F.col("pulse_day")).cast("double"))
    agg = []
    for side in ("pre", "post"):
        x, y = F.when(F.col("side") == side, F.col("d")), F.when(F.col("side") == side, F.col("minute"))
        agg += [F.count(y).alias(f"n_{side}_days"), F.regr_slope(y, x).alias(f"{side}_slope"), F.regr_intercept(y, x).alias(f"{side}_at"), F.regr_r2(y, x).alias(f"{side}_r2")]
    out = rows.groupBy("id").agg(*agg)
    pre, post = F.col("pre_slope") / 60, F.col("post_slope") / 60
    status = F.when(F.col("n_pre_days") < min_pre, "insufficient_pre").when(F.col("n_post_days") < min_post, "insufficient_post").when(pre.between(*periods) & post.between(*periods), "ok").otherwise("implausible_period")
    raw = (F.col("post_at") - F.col("pre_at")) / 60
    wrapped = F.pmod(raw + post / 2, post) - post / 2
    fitted = out.select("id", status.alias("status"), F.when(status == "ok", wrapped).alias("phase_shift_hours"), "n_pre_days", "n_post_days", pre.alias("pre_period"), post.alias("post_period"), "pre_r2", "post_r2")
    return subjects.select("id", "pulse_minute").join(fitted, "id", "left").withColumn("status", F.coalesce("status", F.when(F.col("pulse_minute").isNull(), "no_pulse").otherwise("pulse_outside_record"))).drop("pulse_minute")


def responses(shifted: DataFrame, subjects: DataFrame, controls: DataFrame) -> DataFrame:
    """``id, grp, control_grp, response_hours``: how much less a subject's phase moved than its control group's mean."""
    rows = shifted.where("status = 'ok'").join(subjects.select("id", "grp"), "id")
    angle = F.col("phase_shift_hours") * math.pi / 12
    mean = rows.groupBy("grp").agg((F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * 12 / math.pi).alias("__c")).withColumnRenamed("grp", "control_grp")
    return rows.join(controls, "grp").join(mean, "control_grp").select("id", "grp", "control_grp", S.wrap_hours(F.col("__c") - F.col("phase_shift_hours")).alias("response_hours"))


def summarize(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, sd, sem, n; the last two are null for one value."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), S.sem(value).alias("sem"), F.count(value).alias("n"))


def resample_weight(key, resample, seed: int = 0) -> Column:
    """How often a row stands in a resample: a Poisson number with mean one, from a hash of the row's key."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"), resample.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    bounds = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: x <= u))


def bootstrap_mean(values: DataFrame, value: str, by: str | list[str], resamples: int = 200, seed: int = 0, ci: float = 95.0, key: str = "id") -> DataFrame:
    """``by, mean, sd, low, high, n``: resampled subjects within a group.

    Every row draws its own weight in every resample, so the sums of a resample are added up before they are shuffled
    and no group meets in one task. A resample that draws nothing is left out. A key draws the same weights
    in all groups, so that curves are resampled whole where ``by`` also names a curve's points.
    """
    by = [by] if isinstance(by, str) else by
    rows = values.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("__key"), F.col(value).cast("double").alias("__x"))
    drawn = rows.select(*by, "__key", "__x", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("__r"))
    drawn = drawn.withColumn("__w", resample_weight(F.col("__key"), F.col("__r"), seed)).groupBy(*by, "__r").agg(F.sum(F.col("__w") * F.col("__x")).alias("__s"), F.sum("__w").alias("__n"))
    means = drawn.where("__n > 0").select(*by, (F.col("__s") / F.col("__n")).alias("__m"))
    tail = (100 - ci) / 200
    spread = means.groupBy(*by).agg(F.stddev_samp("__m").alias("sd"), F.percentile("__m", F.lit(tail)).alias("low"), F.percentile("__m", F.lit(1 - tail)).alias("high"))
    whole = rows.groupBy(*by).agg(F.avg("__x").alias("mean"), F.count(F.lit(1)).alias("n"))
    return whole.join(spread, by, "left").select(*by, "mean", "sd", "low", "high", "n")


def lines(found: DataFrame) -> DataFrame:
    """``id, slope_hours, r2, n``: the drift of a subject's markers over all days, as a period."""
    return found.groupBy("id").agg((F.regr_slope("minute", "day") / 60).alias("slope_hours"), F.regr_r2("minute", "day").alias("r2"), F.count(F.lit(1)).alias("n"))


def daily_responses(found: DataFrame, subjects: DataFrame, controls: DataFrame, response_days: tuple[int, ...] = (2, 3, 4), baseline_days: tuple[int, ...] = (-1,)) -> DataFrame:
    """``id, grp, control_grp, response_hours, response_hours_raw, n_days_used, baseline_used``.

    A subject's phase on a day is its marker's time within that day, days counted from its own pulse (the reference
    pulse where it had none). Its response is the mean of the control group's phase less its own over the response
    days, less the same over the baseline days where there are any. An advance is positive.
    """
    since = F.col("day") - F.floor(F.col("reference_minute") / 1440)
    phases = found.join(reference_pulses(subjects), "id").join(subjects.select("id", "grp"), "id")
    phases = phases.select("id", "grp", since.alias("offset"), ((F.col("minute") - F.col("day") * 1440) / 60).alias("hours"))
    phases = phases.where(F.col("offset").isin(*response_days, *baseline_days))
    expected = phases.groupBy("grp", "offset").agg(F.avg("hours").alias("expected")).withColumnRenamed("grp", "control_grp")
    met = phases.join(controls.select("grp", "control_grp"), "grp").join(expected, ["control_grp", "offset"])
    ahead = F.col("expected") - F.col("hours")
    after, before = F.when(F.col("offset").isin(*response_days), ahead), F.when(F.col("offset").isin(*baseline_days), ahead)
    out = met.groupBy("id", "grp", "control_grp").agg(F.avg(after).alias("response_hours_raw"), F.count(after).alias("n_days_used"), F.avg(before).alias("__before")).where("n_days_used > 0")
    response = F.col("response_hours_raw") - F.coalesce("__before", F.lit(0.0))
    return out.select("id", "grp", "control_grp", response.alias("response_hours"), "response_hours_raw", "n_days_used", F.col("__before").isNotNull().alias("baseline_used"))
