"""Grouping, subsetting and pairing of subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Columns of subjects that never define groups.
NOT_GROUPING = frozenset({"id", "grp", "ord", "monitor", "region", "start_ts", "stop_ts", "first_dd_ts", "split_minute", "pulse_minute", "attrs"})


def grouping_columns(subjects: DataFrame) -> list[str]:
    """Columns that may define groups: not identifiers, not times."""
    return [n for n, kind in subjects.dtypes if n not in NOT_GROUPING and not kind.startswith(("timestamp", "date", "map", "array"))]


def regroup(subjects: DataFrame, columns: list[str]) -> DataFrame:
    return subjects.withColumn("grp", S.group_label(*columns))


def group_map(subjects: DataFrame, default: str = "All subjects") -> DataFrame:
    """``id, grp``: the group, else genotype and temperature, else one group of all."""
    options = [F.col("grp")] if "grp" in subjects.columns else []
    if {"genotype", "temperature"} <= set(subjects.columns):
        options.append(S.group_label("genotype", "temperature"))
    return subjects.select("id", F.coalesce(*options, F.lit(default)).alias("grp"))


def same(value: Column, wanted) -> Column:
    """Equality by meaning: as numbers where both are, blanks match null, else as text."""
    text = F.trim(value.cast("string"))
    if wanted is None or str(wanted).strip() in ("", "nan"):
        return F.coalesce((text == "") | (F.lower(text) == "nan"), F.lit(True))
    try:
        as_number = F.coalesce(text.try_cast("double") == F.lit(float(wanted)), F.lit(False))
    except (TypeError, ValueError):
        as_number = F.lit(False)
    return as_number | F.coalesce(text == F.lit(str(wanted).strip()), F.lit(False))


def subset(subjects: DataFrame, keep: dict | list[dict]) -> DataFrame:
    """Subjects whose columns have the wanted values: {column: values} (all must hold), or a list of exact
    combinations (one must hold)."""
    if isinstance(keep, dict):
        tests = [reduce(Column.__or__, [same(F.col(c), v) for v in (values if isinstance(values, (list, tuple, set)) else [values])]) for c, values in keep.items()]
        return subjects.where(reduce(Column.__and__, tests, F.lit(True)))
    rows = [reduce(Column.__and__, [same(F.col(c), v) for c, v in row.items()], F.lit(True)) for row in keep]
    return subjects.where(reduce(Column.__or__, rows, F.lit(False)))


def combinations(subjects: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """The distinct combinations behind group labels."""
    return subjects.where(F.col("grp").isin(labels)).select(*columns).distinct()


def rhythmic_only(subjects: DataFrame, calls: DataFrame | None, flag: str = "rhythmic") -> DataFrame:
    """Subjects that an analysis calls rhythmic; all of them where there is no such analysis."""
    return subjects if calls is None else subjects.join(calls.where(F.col(flag)).select("id"), "id", "left_semi")


def unmatched(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """``id, side``: ids of one side only."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def pair_metadata(subjects: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings of subjects with metadata. Duplicate ids, and readings without a subject, raise."""
    twice = [r["id"] for r in subjects.groupBy("id").count().where("count > 1").orderBy("id").limit(10).collect()]
    if twice:
        raise ValueError(f"subjects appear more than once: {twice}")
    lost = [r["id"] for r in readings.select("id").distinct().join(subjects.select("id"), "id", "left_anti").orderBy("id").limit(10).collect()]
    if lost:
        raise ValueError(f"readings without a subject: {lost}")
    return readings.join(subjects, "id")


def combine(*datasets: DataFrame) -> DataFrame:
    """Union of datasets by name. An id that occurs in several gets _b, _c … in their order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("__set", F.lit(k)) for k, d in enumerate(datasets)])
    ids = rows.select("id", "__set").distinct()
    earlier = ids.select("id", F.col("__set").alias("__other"))
    rank = ids.join(earlier, "id").groupBy("id", "__set").agg(F.sum((F.col("__other") < F.col("__set")).cast("int")).alias("__rank"))
    named = rows.join(rank, ["id", "__set"])
    suffix = F.when(F.col("__rank") > 0, F.concat(F.lit("_"), F.char(F.lit(97) + F.col("__rank")))).otherwise("")
    return named.withColumn("id", F.concat(F.col("id").cast("string"), suffix)).drop("__set", "__rank")


def matched_controls(subjects: DataFrame, treatment: str, control_value, match_on: list[str]) -> DataFrame:
    """``grp, control_grp``: for each group, the group with the control value that agrees in ``match_on``.

    None is null; two are an error.
    """
    labelled = subjects.withColumn("__control", same(F.col(treatment), control_value)).select("grp", "__control", *match_on).distinct()
    controls = labelled.where("__control").select(F.col("grp").alias("control_grp"), *match_on).distinct()
    if controls.groupBy(*match_on).count().where("count > 1").limit(1).collect():
        raise ValueError("several control groups match one group")
    return labelled.join(controls, match_on, "left").select("grp", "control_grp").distinct()


def one_to_one(subjects: DataFrame, columns: list[str], with_column: str) -> list[str]:
    """Those of ``columns`` that map one to one to ``with_column``; bounded by the number of columns."""
    pairs = {c: F.countDistinct(F.struct(c, with_column)) for c in columns}
    r = subjects.agg(F.countDistinct(with_column).alias("__w"), *[F.countDistinct(c).alias(f"__c_{c}") for c in columns], *[n.alias(f"__p_{c}") for c, n in pairs.items()]).first()
    return [c for c in columns if r[f"__p_{c}"] == r["__w"] == r[f"__c_{c}"]]


def order_levels(levels: DataFrame, column: str) -> DataFrame:
    """Levels with ``ord``: by number where all are numbers, else in natural order; blanks last."""
    from pyspark.sql import Window

    all_numbers = F.min(F.when(F.trim(column) == "", True).otherwise(S.level_value(column).isNotNull())).over(Window.partitionBy())
    blank = F.coalesce(F.trim(column) == "", F.lit(True))
    rows = levels.select(column).distinct().withColumn("__n", all_numbers)
    order = Window.orderBy(blank, F.when(F.col("__n"), S.level_value(column)), S.natural_key(column))
    return rows.withColumn("ord", F.row_number().over(order)).drop("__n")
