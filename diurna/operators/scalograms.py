"""Wavelet power over period and time: of stated subjects, and averaged in groups.

A subject's matrix of periods and minutes exists in its task only. Each task adds the matrices of its subjects up by group and
sends one packed array for each group and period; Spark deals these to tasks that add them one at a time. So what is
shuffled grows with tasks, groups and periods, and no cell of a subject is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalars as S
from ..params import Period

#: Bytes of sums that a task holds before it sends them.
HELD = 1 << 28
#: Fewest samples of a record that is transformed.
LEAST = 10


def blocks(readings: DataFrame, settings: Period = Period(), value: str = "activity") -> DataFrame:
    """``id, start, x``: each subject's longest record without gaps beyond ``max_bridge_minutes``, bridged, as one array.

    Records of fewer than ten samples, and records that never change, have no row.
    """
    key = readings.schema["id"].dataType.simpleString()
    step, bridge = settings.step_minutes, settings.max_bridge_minutes

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, x = N.longest_block(pdf["t"].to_numpy(float), pdf["x"].to_numpy(float), step, bridge)
        if len(x) < LEAST or x.std() == 0:
            return pd.DataFrame({"id": pdf["id"].iloc[:0], "start": pdf["t"].iloc[:0], "x": pd.Series([], dtype=object)})
        return pd.DataFrame({"id": pdf["id"].iloc[:1].to_list(), "start": [int(t[0])], "x": [x]})

    rows = readings.select("id", F.col("t").cast("int").alias("t"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("id").applyInPandas(one, f"id {key}, start int, x array<double>")


def _axes(settings: Period) -> tuple[np.ndarray, np.ndarray]:
    per_hour = 60.0 / settings.step_minutes
    periods = N.wavelet_periods(settings.min_period, settings.max_period, settings.voices, per_hour)
    return periods, periods * per_hour


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32), np.concatenate(rows))


def group_scalograms(readings: DataFrame, groups: DataFrame, settings: Period = Period(), value: str = "activity") -> DataFrame:
    """``grp, period, n, step_minutes, power``: mean power of a group's subjects at one period, over time from each record's start.

    Every subject is transformed over its whole record; sums are cut to the group's shortest. Subjects without a group,
    and those that ``blocks`` leaves out, count for nothing. Pass ``groups`` of the rhythmic subjects for their average.
    """
    periods, scales = _axes(settings)
    held = blocks(readings, settings, value).join(groups.where("grp IS NOT NULL").select("id", F.col("grp").cast("string").alias("grp")), "id").persist()
    shortest = held.groupBy("grp").agg(F.min(F.size("x")).alias("m"))
    rows = held.join(shortest, "grp").select("grp", "m", "x")
    names = ["grp", "k", "n", "power"]
    schema = "grp string, k int, n bigint, power array<double>"

    def sent(sums: dict) -> pa.RecordBatch:
        cells = [(g, k, n, row) for g, (n, matrix) in sums.items() for k, row in enumerate(matrix)]
        g, k, n, rows = zip(*cells)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(k, pa.int32()), pa.array(n, pa.int64()), _lists(rows)], names)

    def add(batches):
        sums: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                grp, m, x = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy()
                power = N.morlet_power(x - x.mean(), scales)[:, :m]
                n, matrix = sums.get(grp, (0, 0.0))
                sums[grp] = n + 1, matrix + power
                if sum(s.nbytes for _, s in sums.values()) > HELD:
                    yield sent(sums)
                    sums = {}
        if sums:
            yield sent(sums)

    def merge(batches):
        now, n, total = None, 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                key = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if key != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([n]), _lists([total / n])], names)
                    now, n, total = key, 0, 0.0
                n, total = n + batch.column(2)[at].as_py(), total + batch.column(3)[at].values.to_numpy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([n]), _lists([total / n])], names)

    parts = rows.mapInArrow(add, schema).repartition("grp", "k").sortWithinPartitions("grp", "k").mapInArrow(merge, schema)
    axis = F.array(*[F.lit(float(p)) for p in periods])
    return parts.select("grp", F.get(axis, F.col("k")).alias("period"), "n", F.lit(settings.step_minutes).alias("step_minutes"), "power")


def subject_scalograms(readings: DataFrame, ids: list, settings: Period = Period(), value: str = "activity") -> DataFrame:
    """``id, period, start, step_minutes, power, inside, mean``: the stated subjects' matrices, a row for each period.

    ``inside`` marks the samples out of reach of the record's ends (half the cone of influence on either side), ``mean`` is
    the power over these, null where they are fewer than ten or than one cycle. A stated subject without a record
    that can be transformed raises.
    """
    periods, scales = _axes(settings)
    chosen = readings.where(F.col("id").isin(*ids))
    held = blocks(chosen, settings, value).persist()
    known = {r["id"] for r in held.select("id").collect()}  # as many as were stated
    if lost := [i for i in ids if i not in known]:
        raise ValueError(f"no record that can be transformed: {lost}")
    key = readings.schema["id"].dataType.simpleString()
    per_hour = 60.0 / settings.step_minutes

    def one(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column(2)[row].values.to_numpy()
                n = len(x)
                power = N.morlet_power(x - x.mean(), scales)
                reach = np.minimum(np.arange(n), n - 1 - np.arange(n)) / per_hour / np.sqrt(2)
                inside = periods[:, None] <= reach[None, :]
                count = inside.sum(axis=1)
                enough = count >= np.maximum(LEAST, periods * per_hour)
                mean = np.where(inside, power, 0).sum(axis=1) / np.maximum(count, 1)
                size = len(periods)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * size, batch.schema.field(0).type),
                        pa.array(periods),
                        pa.array([batch.column(1)[row].as_py()] * size, pa.int32()),
                        _lists(list(power)),
                        _lists(list(inside)),
                        pa.array(mean, mask=~enough),
                    ],
                    ["id", "period", "start", "power", "inside", "mean"],
                )

    out = held.mapInArrow(one, f"id {key}, period double, start int, power array<double>, inside array<boolean>, mean double")
    return out.select("id", "period", "start", F.lit(settings.step_minutes).alias("step_minutes"), "power", "inside", "mean")


def ridges(scalograms: DataFrame, key: str = "id") -> DataFrame:
    """``key, at, period, power``: the strongest period at each sample, the shorter of equals."""
    cells = scalograms.select(key, "period", F.posexplode("power").alias("at", "power"))
    best = cells.groupBy(key, "at").agg(F.max(F.struct("power", (-F.col("period")).alias("p"))).alias("x"))
    return best.select(key, "at", (-F.col("x.p")).alias("period"), F.col("x.power").alias("power"))


def ridge_density(readings: DataFrame, groups: DataFrame, settings: Period = Period(), value: str = "activity", bin_minutes: int = 360, least: float = 2.0) -> DataFrame:
    """``grp, bin, period, n``: how many of a group's samples have their ridge at a period, by time from the record's start.

    A ridge counts where it is inside the cone of influence and has ``least`` times the mean power of its sample. Tasks send
    counts for each group, bin and period.
    """
    periods, scales = _axes(settings)
    per_hour = 60.0 / settings.step_minutes
    held = blocks(readings, settings, value).join(groups.where("grp IS NOT NULL").select("id", F.col("grp").cast("string").alias("grp")), "id").select("grp", "x")

    def count(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column(1)[row].values.to_numpy()
                n = len(x)
                power = N.morlet_power(x - x.mean(), scales)
                top = power.argmax(axis=0)
                reach = np.minimum(np.arange(n), n - 1 - np.arange(n)) / per_hour / np.sqrt(2)
                good = (power.max(axis=0) >= least * power.mean(axis=0)) & (periods[top] <= reach)
                cells, sizes = np.unique(np.stack([np.arange(n)[good] * settings.step_minutes // bin_minutes, top[good]]), axis=1, return_counts=True)
                if len(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(sizes)), pa.array(cells[0].astype(np.int32)), pa.array(periods[cells[1]]), pa.array(sizes)], ["grp", "bin", "period", "n"])

    return held.mapInArrow(count, "grp string, bin int, period double, n bigint").groupBy("grp", "bin", "period").agg(F.sum("n").alias("n"))


def cells(scalograms: DataFrame, key: str = "grp") -> DataFrame:
    """``key, period, hours, power``: a row for each cell, hours from the record's start."""
    rows = scalograms.select(key, "period", "step_minutes", F.posexplode("power").alias("at", "power"))
    return rows.select(key, "period", (F.col("at") * F.col("step_minutes") / 60.0).alias("hours"), "power")


def save_csv(scalograms: DataFrame, folder: str, phase: str) -> DataFrame:
    """A CSV file for each group, periods down and hours across; returns ``grp, n, path, phase`` of what was written.

    Group labels are made fit for file names; two that become one raise. A second run replaces the first.
    """
    table = scalograms.withColumn("stem", F.concat(F.lit("averaged_scalogram_"), F.coalesce(F.nullif(S.safe_name("grp"), F.lit("")), F.lit("group")), F.lit(f"_{phase}")))
    table = table.persist()
    manifest = table.groupBy("stem").agg(F.collect_set("grp").alias("grps"), F.first("n").alias("n"))
    if twice := [r["grps"] for r in manifest.where(F.size("grps") > 1).collect()]:
        raise ValueError(f"groups with one file name: {twice}")
    hours = F.transform(F.sequence(F.lit(0), F.size("power") - 1), lambda k: (k * F.col("step_minutes") / 60.0).cast("string"))
    head = table.withColumn("__n", F.row_number().over(Window.partitionBy("stem").orderBy("period"))).where("__n = 1").select("stem", F.lit(0).alias("ord"), F.lit(0.0).alias("period"), F.concat(F.lit("period_h,"), F.array_join(hours, ",")).alias("value"))
    body = table.select("stem", F.lit(1).alias("ord"), "period", F.concat(F.col("period").cast("string"), F.lit(","), F.array_join(F.transform("power", lambda p: p.cast("string")), ",")).alias("value"))
    lines = head.unionByName(body).repartition("stem").sortWithinPartitions("stem", "ord", "period")
    lines.select("stem", "value").write.mode("overwrite").partitionBy("stem").text(folder)
    return manifest.select(F.col("grps")[0].alias("grp"), "n", F.concat(F.lit(f"{folder}/stem="), "stem").alias("path"), F.lit(phase).alias("phase"))
