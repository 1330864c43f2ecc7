"""Series transforms that window functions express; the filters are in ``period.preprocess``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detrended(df: DataFrame, value: str, out: str, key: str = "id", order: str = "t") -> DataFrame:
    """Residuals of a least-squares line over the measured rows, counted from each subject's first one."""
    x = F.when(F.col(value).isNotNull(), F.count(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double")
    rows = df.withColumn("__i", x)
    own, y = Window.partitionBy(key), F.col(value).cast("double")
    slope = F.covar_pop(y, F.col("__i")).over(own) / F.nullif(F.var_pop("__i").over(own), F.lit(0.0))
    line = F.avg(y).over(own) + F.coalesce(slope, F.lit(0.0)) * (F.col("__i") - F.avg("__i").over(own))
    return rows.withColumn(out, y - line).drop("__i")


def standardized(df: DataFrame, value: str, out: str, kind: str = "zscore", key: str = "id") -> DataFrame:
    """"zscore": by mean and population deviation; "robust": by median and median distance; no spread, centre only."""
    own, x = Window.partitionBy(key), F.col(value).cast("double")
    if kind == "zscore":
        return df.withColumn(out, (x - F.avg(x).over(own)) / F.coalesce(F.nullif(F.stddev_pop(x).over(own), F.lit(0.0)), F.lit(1.0)))
    if kind != "robust":
        raise ValueError(f"unknown kind {kind}")
    mid = df.groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("__m"))
    far = df.join(mid, key)
    spread = far.groupBy(key).agg(F.percentile(F.abs(x - F.col("__m")), F.lit(0.5)).alias("__s"))
    scaled = (x - F.col("__m")) / F.coalesce(F.nullif("__s", F.lit(0.0)), F.lit(1.0))
    return far.join(spread, key).withColumn(out, scaled).drop("__m", "__s")


def daily_peaks(df: DataFrame, value: str = "activity", key: str = "id") -> DataFrame:
    """``id, day, minute``: the first minute of a day's highest value; days without a positive one have none."""
    day = F.floor(F.col("t") / 1440).cast("int")
    top = Window.partitionBy(key, day).orderBy(F.desc_nulls_last(value), "t")
    rows = df.withColumns({"day": day, "__n": F.row_number().over(top)}).where((F.col("__n") == 1) & (F.col(value) > 0))
    return rows.select(key, "day", F.col("t").cast("double").alias("minute"))
