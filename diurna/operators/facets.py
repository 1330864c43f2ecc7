"""Arrangement of groups in panels: which series stand together, in which order, beside which reference."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import groups


@dataclass(frozen=True)
class Facets:
    compare_by: tuple[str, ...]
    panel_by: tuple[str, ...] = ()
    include: dict = field(default_factory=dict)
    reference: dict = field(default_factory=dict)


def factors(subjects: DataFrame) -> DataFrame:
    """``id`` and the columns that may define groups."""
    return subjects.select("id", *groups.grouping_columns(subjects))


def panels(subjects: DataFrame, spec: Facets) -> DataFrame:
    """``panel, series, is_reference, panel_ord, series_ord, n``: a row for each series of each panel.

    A reference series is repeated in every panel that does not hold it already. Numbers sort by value,
    other texts naturally, blanks last.
    """
    rows = groups.subset(subjects, spec.include) if spec.include else subjects
    panel = S.group_label(*spec.panel_by) if spec.panel_by else F.lit("")
    series = S.group_label(*spec.compare_by)
    own = rows.groupBy(panel.alias("panel"), series.alias("series")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_reference", F.lit(False))
    if spec.reference:
        base = groups.subset(subjects, spec.reference).groupBy(series.alias("series")).agg(F.count(F.lit(1)).alias("n"))
        everywhere = own.select("panel").distinct().join(F.broadcast(base)).withColumn("is_reference", F.lit(True))
        extra = everywhere.join(own.select("panel", "series"), ["panel", "series"], "left_anti")
        marked = own.join(F.broadcast(base.select("series", F.lit(True).alias("__ref"))), "series", "left").withColumn("is_reference", F.coalesce("__ref", F.lit(False))).drop("__ref")
        own = marked.unionByName(extra)
    key = lambda c: (F.col(c) == "nan", S.level_value(c).isNull(), S.level_value(c), S.natural_key(c))
    return own.withColumns({"panel_ord": F.dense_rank().over(Window.orderBy(*key("panel"))), "series_ord": F.row_number().over(Window.partitionBy("panel").orderBy(~F.col("is_reference"), *key("series")))})
