"""Circadian period of each subject. The mathematics is per series, so each estimator is one grouped function."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..params import AC_STRENGTH, CLASSIFY_WINDOW, CWT_CUTOFF, LS_POWER, Period, Preprocess

class FitError(RuntimeError):
    """A method's fit threw for every subject that reached it."""


#: How the status of a fit that threw begins; the error follows.
THREW = "numerical: "
RESULT = "id {id}, method string, period double, strength double, fap double, rhythmic_power double, status string"


def _key_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def preprocess(readings: DataFrame, settings: Preprocess, value: str = "activity", step: int = 1) -> DataFrame:
    """``id, t, value``: the fixed order bin, smooth, low-pass, detrend, normalise. Missing rows stay null."""
    from .bins import rebin

    rows = readings.select("id", "t", F.col(value).cast("double").alias(value))
    if settings.bin_minutes > step:
        rows = rebin(rows, value, settings.bin_minutes // step, step).select("id", "t", value)
        step = settings.bin_minutes

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = N.preprocess(pdf[value].to_numpy(float), settings, step)
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], value: pd.Series(out, index=pdf.index).where(np.isfinite(out), None)})

    return rows.groupBy("id").applyInPandas(one, f"id {_key_type(readings)}, t int, {value} double")


METHODS = ("ac", "ls", "mesa", "cwt")


def _solve(method: str, t: np.ndarray, x: np.ndarray, block, settings: Period) -> dict | None:
    """A method's numbers for one series, from its samples or from its longest block."""
    step, lo, hi = settings.step_minutes, settings.min_period, settings.max_period
    if method == "ls":
        return N.lomb_scargle(t / 60.0, x, lo, hi, settings.oversampling)
    y = block()
    if method == "ac":
        return N.autocorrelation_period(y, step, lo, hi, settings.ac_peak)
    if method == "mesa":
        k = max(1, settings.mesa_bin_minutes // step)
        binned = y[: len(y) // k * k].reshape(-1, k).sum(axis=1)
        return N.mesa(binned, k * step / 60.0, lo, hi, settings.mesa_order)
    return N.wavelet_summary(y, step, lo, hi, settings.voices, settings.cwt_method)


def run(readings: DataFrame, settings: Period = Period(), value: str = "activity") -> DataFrame:
    """``id, method, period, strength, fap, rhythmic_power, status`` of every subject by all methods of the settings.

    Subjects are dealt, sorted and bridged once for all methods. Failed fits have nulls and a reason; one that threw
    says so with its error (see ``judge``).
    """
    methods = tuple(settings.methods)
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown method {', '.join(unknown)}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, x = pdf["t"].to_numpy(float), pdf[value].to_numpy(float)
        seen = t[np.isfinite(x)]
        short = "no_data" if len(seen) < 2 else "below_floor" if (seen[-1] - seen[0]) / 1440 < settings.min_days else None
        held: list[np.ndarray] = []

        def block() -> np.ndarray:
            if not held:
                held.append(N.longest_block(t, x, settings.step_minutes, settings.max_bridge_minutes)[1])
            return held[0]

        rows = []
        for method in methods:
            found, status = None, short
            if not short:
                try:
                    found = _solve(method, t, x, block, settings)
                    status = "ok" if found else "too_short"
                except Exception as error:  # one subject's fit is its own affair; see ``judge`` for those of all
                    status = f"{THREW}{type(error).__name__}: {error}"[:300]
            found = found or {}
            rows.append({"id": pdf["id"].iloc[0], "method": method, "period": found.get("period"), "strength": found.get("strength"), "fap": found.get("fap"), "rhythmic_power": found.get("power"), "status": status})
        return pd.DataFrame(rows)

    rows = readings.select("id", F.col("t").cast("int").alias("t"), F.col(value).cast("double").alias(value))
    return rows.groupBy("id").applyInPandas(one, RESULT.format(id=_key_type(readings)))


def estimate(readings: DataFrame, method: str, settings: Period = Period(), value: str = "activity") -> DataFrame:
    """``run`` by one method."""
    return run(readings, dataclasses.replace(settings, methods=(method,)), value)


def watched(results: DataFrame, methods) -> tuple[DataFrame, tuple[Observation, tuple[str, ...]]]:
    """``results`` that count, while they are made, each method's fits and those that threw; for ``judge``."""
    seen, threw = Observation(), F.col("status").startswith(THREW)
    counts = []
    for m in methods:
        own = F.col("method") == m
        counts += [F.count(F.when(own & (F.col("status") == "ok"), 1)).alias(f"{m}_ok"), F.count(F.when(own & threw, 1)).alias(f"{m}_threw"), F.max(F.when(own & threw, F.col("status"))).alias(f"{m}_error")]
    return results.observe(seen, *counts), (seen, tuple(methods))


def judge(seen: tuple[Observation, tuple[str, ...]]) -> dict[str, tuple[int, int]]:
    """Each method's fits that worked and that threw, once the results are made; raises where only some threw and none worked.

    Subjects that were left out before the fit, for too little data, count neither way. Waits for the results' job.
    """
    found = seen[0].get
    for m in seen[1]:
        if found[f"{m}_threw"] and not found[f"{m}_ok"]:
            raise FitError(f"{m}: the fit failed for every subject that reached it ({found[f'{m}_threw']}), so there is no period. {found[f'{m}_error'].removeprefix(THREW)}. A fit that fails for all is more likely broken than the data: look at the installed packages")
    return {m: (found[f"{m}_ok"], found[f"{m}_threw"]) for m in seen[1]}


def correlogram(readings: DataFrame, value: str = "activity", step: int = 60, max_hours: int = 72) -> DataFrame:
    """``id, lag_hours, r`` of dense records; missing samples count as the mean.

    What stands a lag ahead is a window of that one minute, so a subject's rows stay where they are, one for each sample.
    """
    own = Window.partitionBy("id")
    x = readings.select("id", "t", F.coalesce(F.col(value) - F.avg(value).over(own), F.lit(0.0)).alias("x"))
    lags = range(0, max_hours * 60 + 1, step)
    ahead = {f"__{lag}": F.col("x") * F.sum("x").over(own.orderBy("t").rangeBetween(lag, lag)) for lag in lags}
    sums = x.select("id", *[c.alias(n) for n, c in ahead.items()]).groupBy("id").agg(*[F.sum(n).alias(n) for n in ahead])
    rows = sums.where("__0 > 0").select("id", F.col("__0").alias("__top"), F.explode(F.array(*[F.struct((F.lit(lag) / 60.0).alias("lag_hours"), F.col(f"__{lag}").alias("s")) for lag in lags])).alias("l"))
    return rows.where("l.s IS NOT NULL").select("id", "l.lag_hours", (F.col("l.s") / F.col("__top")).alias("r"))


def spectrum(readings: DataFrame, periods: list[float], value: str = "activity") -> DataFrame:
    """``id, period, power``: least-squares power of a constant and one sinusoid at given periods.

    A subject's record is one array, whose sums at all periods are products with those of cosines and sines; null where
    nothing varies.
    """
    each = 2 * np.pi / (60.0 * np.array(periods, float))[:, None]
    held = readings.where(F.col(value).isNotNull()).groupBy("id").agg(F.collect_list("t").alias("t"), F.collect_list(F.col(value).cast("double")).alias("x"))

    def power(batches):
        for batch in batches:
            last, out = None, []
            for t, x in zip(batch["t"], batch["x"]):
                if last is None or not np.array_equal(t, last):
                    last, a = t, each * t
                    c, s = np.cos(a), np.sin(a)
                    sc, ss = c.sum(1), s.sum(1)
                    cc, sss, cs = ((p * q).sum(1) - u * v / len(t) for p, q, u, v in ((c, c, sc, sc), (s, s, ss, ss), (c, s, sc, ss)))
                y = x - x.mean()
                yc, ys, yy = c @ y, s @ y, y @ y
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = (yc**2 * sss + ys**2 * cc - 2 * yc * ys * cs) / ((cc * sss - cs * cs) * yy)
                out.append(np.where(np.isfinite(p), p, np.nan) if yy > 0 else np.full(len(p), np.nan))
            yield pd.DataFrame({"id": batch["id"], "p": [[None if v != v else v for v in p] for p in out]})

    found = held.mapInPandas(power, f"id {_key_type(readings)}, p array<double>")
    grid = F.array(*[F.lit(float(p)) for p in periods])
    return found.select("id", F.posexplode("p").alias("at", "power")).select("id", F.get(grid, F.col("at")).alias("period"), "power")


def chi_square(readings: DataFrame, periods_hours: list[float], value: str = "activity", step: int = 60) -> DataFrame:
    """``id, period, q, dof``: Sokolove-Bushell statistic. Missing rows go first, so time is compacted."""
    order = Window.partitionBy("id").orderBy("t")
    rows = readings.where(F.col(value).isNotNull()).select("id", F.col(value).cast("double").alias("x"), (F.row_number().over(order) - 1).alias("i"))
    spread = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    folded = rows.select("id", "x", "i", F.explode(F.array(*[F.lit(float(p)) for p in periods_hours])).alias("period"))
    samples = F.col("period") * 60.0 / step
    column = F.floor(F.pmod(F.col("i").cast("double"), samples)).cast("int")
    means = folded.groupBy("id", "period", column.alias("k")).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("c"))
    joined = means.join(spread, "id").where("var > 0").groupBy("id", "period").agg(F.sum(F.col("c") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.first("var").alias("var"), F.count(F.lit(1)).alias("k"))
    return joined.select("id", "period", (F.col("between") / F.col("var")).alias("q"), (F.col("k") - 1).alias("dof"))


CUTOFF = {"ls": LS_POWER, "ac": AC_STRENGTH, "cwt": CWT_CUTOFF["global_rednoise"]}


def classify(results: DataFrame, window: tuple[float, float] = CLASSIFY_WINDOW, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``results`` with ``rhythmic``: strength above the method's cutoff and a period inside the window (ends included).

    Autocorrelation goes by its peak, not by its ratio to the confidence limit; MESA borrows its call. No result is not rhythmic.
    """
    limits = {**CUTOFF, **(cutoffs or {})}
    metric = F.when(F.col("method") == "ac", F.col("rhythmic_power")).otherwise(F.col("strength"))
    limit = F.lit(None).cast("double")
    for method, value in limits.items():
        limit = F.when(F.col("method") == method, F.lit(value)).otherwise(limit)
    own = F.coalesce((metric > limit) & F.col("period").between(*window), F.lit(False))
    marked = results.withColumn("__own", own)
    ac = F.max(F.when(F.col("method") == "ac", F.col("__own"))).over(Window.partitionBy("id"))
    return marked.withColumn("rhythmic", F.when(F.col("method") == "mesa", F.coalesce(ac, F.lit(False))).otherwise(F.col("__own"))).drop("__own")


def rhythm_summary(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """``method, grp, n_total, n_rhythmic, n_arrhythmic, percent_rhythmic``, and a row "ALL" for each method."""
    rows = calls.join(groups.select("id", "grp"), "id").groupingSets([[F.col("method"), F.col("grp")], [F.col("method")]], "method", "grp")
    n, r = F.count(F.lit(1)), F.sum(F.col("rhythmic").cast("int"))
    return rows.agg(F.grouping("grp").alias("__all"), n.alias("n_total"), r.alias("n_rhythmic"), (n - r).alias("n_arrhythmic"), (100.0 * r / n).alias("percent_rhythmic")).select(
        "method", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("grp")).alias("grp"), "n_total", "n_rhythmic", "n_arrhythmic", "percent_rhythmic"
    )


def threshold_sweep(results: DataFrame, metric: str, thresholds: list[float]) -> DataFrame:
    """``threshold, n, n_above, percent`` over a list of cutoffs, in one pass."""
    rows = results.select(metric, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")).groupBy("threshold")
    above = F.sum(F.coalesce((F.col(metric) > F.col("threshold")).cast("int"), F.lit(0)))
    return rows.agg(F.count(metric).alias("n"), above.alias("n_above"), F.when(F.count(metric) > 0, 100.0 * above / F.count(metric)).alias("percent"))


def wide(calls: DataFrame, methods: list[str]) -> DataFrame:
    """One row per subject: period, strength and call of every method."""
    return calls.groupBy("id").pivot("method", methods).agg(F.first("period").alias("period"), F.first("strength").alias("strength"), F.first("rhythmic").alias("rhythmic"))


def skips(results: DataFrame) -> DataFrame:
    """``method, status, n`` of subjects without a result."""
    return results.where("status <> 'ok'").groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def running_median(spectra: DataFrame, share: float = 0.35, value: str = "power", order: str = "period", key: str = "id") -> DataFrame:
    """``key, order, value, baseline``: the noise floor below each point of a spectrum.

    The median of the points around it, ``share`` of the spectrum wide (odd, three or more) and cut at its ends. Missing
    points are skipped; without any the baseline is null. A spectrum is one grid of periods, so it is one array.
    """
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    held = spectra.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), number.alias("x")))).alias("points"))
    half = F.floor(F.greatest(F.lit(3), F.bround(F.size("points") * F.lit(share)).cast("int")) / 2).cast("int")
    held = held.withColumn("half", half).select(key, "points", "half", F.posexplode("points").alias("i", "p"))
    start = F.greatest(F.lit(0), F.col("i") - F.col("half"))
    near = F.slice("points", start + 1, F.col("i") + F.col("half") - start + 1)
    near = F.array_sort(F.filter(F.transform(near, lambda p: p["x"]), lambda x: x.isNotNull()))
    n = F.size("near")
    middle = (F.get("near", F.floor((n - 1) / 2).cast("int")) + F.get("near", F.floor(n / 2).cast("int"))) / 2
    return held.withColumn("near", near).select(key, F.col("p.at").alias(order), F.col("p.x").alias(value), F.when(n > 0, middle).alias("baseline"))
