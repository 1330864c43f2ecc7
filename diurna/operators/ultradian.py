"""Ultradian rhythms of sleep states: wavelet surfaces of each subject's state, averaged in groups, and tests of their amplitude."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalars as S
from ..functions import tests_math as M

#: Bands in hours whose mean power is a state's amplitude over time.
BANDS = {"standard": (1.0, 4.0), "short": (1.0, 4.0), "intermediate": (1.0, 4.0), "long": (2.0, 6.0)}


def surfaces(states: DataFrame, step: int = 1, bin_minutes: int = 5, lo: float = 1.0, hi: float = 32.0, voices: int = 16) -> DataFrame:
    """``id, state, period, tbin, power`` of each subject's longest run without missing minutes, on the record's own bins.

    The 0/1 minutes are summed in bins, centred, transformed, divided by the scale and by their own mean.
    A subject is one task's numbers; the surface leaves as rows, so groups are averaged by Spark.
    """
    k = max(1, bin_minutes // step)
    key = states.schema["id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, x = N.longest_block(pdf["t"].to_numpy(float), pdf["asleep"].to_numpy(float), step, 0)
        binned = x[: len(x) // k * k].reshape(-1, k).sum(axis=1)
        if len(binned) < 10 or binned.std() == 0:
            return pd.DataFrame([], columns=["id", "state", "period", "tbin", "power"])
        per_hour = 60.0 / (k * step)
        periods = N.wavelet_periods(lo, hi, voices, per_hour)
        scales = periods * per_hour
        power = N.morlet_power(binned - binned.mean(), scales) / scales[:, None]
        power = power / power.mean()
        first = int(t[0] // (k * step))
        p, b = np.repeat(periods, len(binned)), np.tile(first + np.arange(len(binned)), len(periods))
        return pd.DataFrame({"id": pdf["id"].iloc[0], "state": pdf["state"].iloc[0], "period": p, "tbin": b, "power": power.ravel()})

    rows = states.select("id", "state", "t", F.col("asleep").cast("double").alias("asleep"))
    return rows.groupBy("id", "state").applyInPandas(one, f"id {key}, state string, period double, tbin int, power double")


def group_surfaces(found: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, state, period, tbin, power, n``: mean over the subjects that cover a bin."""
    return found.join(groups.select("id", "grp"), "id").groupBy("grp", "state", "period", "tbin").agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("n"))


def spectra(found: DataFrame) -> DataFrame:
    """``id, state, period, power``: mean over time."""
    return found.groupBy("id", "state", "period").agg(F.avg("power").alias("power"))


def amplitude(found: DataFrame) -> DataFrame:
    """``id, state, tbin, amplitude``: mean power in the state's band."""
    inside = F.lit(False)
    for state, (a, b) in BANDS.items():
        inside = inside | ((F.col("state") == state) & F.col("period").between(a, b))
    return found.where(inside).groupBy("id", "state", "tbin").agg(F.avg("power").alias("amplitude"))


def amplitude_rhythm(amplitudes: DataFrame, bin_minutes: int = 5, lo: float = 18.0, hi: float = 30.0) -> DataFrame:
    """``id, state, period, strength, fap``: Lomb-Scargle of each amplitude series; fewer than ten bins have nulls."""
    key = amplitudes.schema["id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tbin")
        found = N.lomb_scargle(pdf["tbin"].to_numpy(float) * bin_minutes / 60, pdf["amplitude"].to_numpy(float), lo, hi) if len(pdf) >= 10 else None
        return pd.DataFrame([{"id": pdf["id"].iloc[0], "state": pdf["state"].iloc[0], **(found or {"period": None, "strength": None, "fap": None})}])

    return amplitudes.groupBy("id", "state").applyInPandas(one, f"id {key}, state string, period double, strength double, fap double")


def chi_square_calls(statistics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``id, period, q, dof, threshold, adjusted, significant`` with Šidák's correction over the periods that were tried.

    Thresholds depend on the degrees of freedom only, so there are as many as periods; they are found on the
    driver and joined.
    """
    sizes = [r["dof"] for r in statistics.select("dof").distinct().collect()]
    level = 1 - (1 - alpha) ** (1 / max(1, len(sizes)))
    rows = [(int(k), chi2_quantile(1 - level, int(k))) for k in sizes]
    limits = statistics.sparkSession.createDataFrame(rows, "dof int, threshold double")
    out = statistics.withColumn("dof", F.col("dof").cast("int")).join(F.broadcast(limits), "dof")
    return out.withColumns({"adjusted": F.col("q") - F.col("threshold"), "significant": F.col("q") > F.col("threshold")})


def chi2_quantile(p: float, df: int) -> float:
    """By bisection on the upper tail."""
    lo, hi = 0.0, 10.0 + 4.0 * df
    while M.chi2_p(hi, df) > 1 - p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if M.chi2_p(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def peak_hours(found: DataFrame, bin_minutes: int = 5) -> DataFrame:
    """``id, state, zt_bin_minute, amplitude``: amplitude by the time of day."""
    return found.groupBy("id", "state", S.zt_bin(F.col("tbin") * bin_minutes, 60).alias("zt_bin_minute")).agg(F.avg("amplitude").alias("amplitude"))
