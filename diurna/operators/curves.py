"""Curves of subjects on a common grid, averaged in groups with bootstrap limits, whole curves being resampled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Poisson numbers with mean one: below which share of draws a number is 0, 1 and on (see ``phase_shift.resample_weight``).
_BOUNDS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def weights(key: str, resamples: int, seed: int) -> np.ndarray:
    """How often a subject stands in each resample, as ``phase_shift.resample_weight`` draws it."""
    u = np.array([int(hashlib.md5(f"{seed}:{key}:{r}".encode()).hexdigest()[:8], 16) for r in range(resamples)]) / float(1 << 32)
    return np.searchsorted(_BOUNDS, u, side="right").astype(np.int64)


def packed(rows: DataFrame, x: str, y: str, key: str = "id") -> tuple[DataFrame, list]:
    """``key, y``: a row for each curve, with its values on the grid of all ``x`` in order (null where it has none), and the grid.

    The grid is a bin, period or lag axis, which is small: it comes to the driver.
    """
    grid = [r[0] for r in rows.select(x).where(F.col(x).isNotNull()).distinct().orderBy(x).collect()]
    own = rows.where(F.col(x).isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(x, F.col(y).cast("double")))).alias("__m"))
    axis = F.array(*[F.lit(g) for g in grid]) if grid else F.array().cast("array<double>")
    return own.select(key, F.transform(axis, lambda g: F.try_element_at("__m", g)).alias("y")), grid


def bands(rows: DataFrame, groups: DataFrame, x: str, y: str, *, resamples: int = 200, seed: int = 0, ci: float = 95.0) -> DataFrame:
    """``grp, x, mean, low, high, n``: mean curve of a group and the limits of its bootstrap, point by point.

    Subjects draw Poisson weights and take their whole curve along. Tasks add weighted curves up, one packed array for each
    group and resample; Spark adds these. A point that a curve lacks counts for nothing there; a resample that draws nothing
    at a point is left out of it.
    """
    held, grid = packed(rows, x, y)
    if not grid:
        return groups.where("false").select(F.col("grp").cast("string").alias("grp"), F.lit(0.0).alias(x), F.lit(0.0).alias("mean"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("bigint").alias("n"))
    size = len(grid)
    named = held.join(groups.where("grp IS NOT NULL").select("id", F.col("grp").cast("string").alias("grp")), "id").select("grp", F.col("id").cast("string").alias("key"), "y")
    names, schema = ["grp", "r", "sums"], "grp string, r int, sums array<double>"

    def out(cells: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        g, r, sums = zip(*cells)
        values = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * (2 * size), np.concatenate(sums))
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(r, pa.int32()), values], names)

    def add(batches):
        """Row r of a group: the sums of the resample r, then of its weights; the last row is that of all weights one."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for grp, key, values in zip(*[c.to_pylist() for c in batch.columns]):
                curve = np.array([np.nan if v is None else v for v in values], float)
                has = np.isfinite(curve)
                w = np.append(weights(key, resamples, seed), 1)[:, None]
                own = np.concatenate([w * np.where(has, curve, 0.0), w * has], axis=1)
                sums[grp] = sums[grp] + own if grp in sums else own
                if len(sums) * own.nbytes > 1 << 28:
                    for g, m in sums.items():
                        yield out([(g, r, row) for r, row in enumerate(m)])
                    sums = {}
        for g, m in sums.items():
            yield out([(g, r, row) for r, row in enumerate(m)])

    def merge(batches):
        now, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                row = batch.column(2)[k].values.to_numpy()
                if key != now and now is not None:
                    yield out([(*now, total)])
                total, now = (row if key != now else total + row), key
        if now is not None:
            yield out([(*now, total)])

    whole = named.mapInArrow(add, schema).repartition("grp", "r").sortWithinPartitions("grp", "r").mapInArrow(merge, schema)
    points = whole.select("grp", "r", "sums", F.posexplode(F.slice("sums", 1, size)).alias("at", "s"))
    points = points.select("grp", "r", "at", "s", F.get("sums", F.col("at") + size).alias("w")).where("w > 0").withColumn("m", F.col("s") / F.col("w"))
    tail, drawn = (100 - ci) / 200, F.when(F.col("r") < resamples, F.col("m"))
    last = lambda c: F.max(F.when(F.col("r") == resamples, F.col(c)))
    told = points.groupBy("grp", "at").agg(last("m").alias("mean"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"), last("w").cast("bigint").alias("n"))
    axis = F.array(*[F.lit(g) for g in grid])
    return told.where("n IS NOT NULL").select("grp", F.get(axis, F.col("at")).alias(x), "mean", "low", "high", "n")
