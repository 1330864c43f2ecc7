"""Import reports: what was left out, and why, as rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Reasons for which something is left out, and how they read.
REASONS = {
    "no_file": "no monitor file was found",
    "window_outside_file": "the window lies outside the file",
    "no_rows_in_window": "the file has no rows in the window",
    "tubes_outside_file": "tubes are listed that the file does not have",
    "silent_channel": "the channel has no reading in the window",
    "off_grid_start": "the first dark day does not start whole days after the record",
}
CAVEATS = ("silent_channel", "off_grid_start")


def issues(failed: DataFrame, tubes: DataFrame, silent: DataFrame | None = None, off_grid: DataFrame | None = None) -> DataFrame:
    """``reason, detail, monitor, start_ts, n, regions, excluded``: a row for each window left out or remarked on."""
    held = failed.join(tubes.select("monitor", "start_ts", "region"), ["monitor", "start_ts"], "left")
    out = held.groupBy("reason", "monitor", "start_ts").agg(F.count("region").alias("n"), S.number_ranges(F.collect_set("region")).alias("regions"))
    for name, ids in (("silent_channel", silent), ("off_grid_start", off_grid)):
        if ids is not None:
            marked = ids.select("id").join(tubes.select("id", "monitor", "start_ts", "region"), "id")
            more = marked.groupBy(F.lit(name).alias("reason"), "monitor", "start_ts").agg(F.count("region").alias("n"), S.number_ranges(F.collect_set("region")).alias("regions"))
            out = out.unionByName(more)
    detail = F.col("reason")
    for k, text in REASONS.items():
        detail = F.when(F.col("reason") == k, text).otherwise(detail)
    return out.withColumns({"detail": detail, "excluded": ~F.col("reason").isin(*CAVEATS)})


def headline(found: DataFrame, tubes: DataFrame) -> str:
    """"imported N of M subjects", and a line for each reason; reasons are few."""
    total = tubes.count()
    lost = found.where("excluded").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = [f"imported {total - lost} of {total} subjects"]
    for r in found.groupBy("reason", "detail", "excluded").agg(F.sum("n").alias("n")).orderBy(F.desc("excluded"), "reason").collect():
        lines.append(f"  {'left out' if r['excluded'] else 'remark'}: {r['n']} subjects, {r['detail']}")
    return "\n".join(lines)


def integrity_lines(scans: DataFrame, by: str = "monitor") -> DataFrame:
    """``by, severity, line``: one sentence for each monitor; loss of an hour or more is a warning."""
    severity = F.when(F.col("longest_gap_min") >= 60, "warning").when(F.col("missing") > 0, "note").otherwise("ok")
    text = F.format_string("%d of %d slots present, %d gaps, the longest of %d min", F.col("present").cast("bigint"), F.col("expected").cast("bigint"), F.col("n_gaps").cast("bigint"), F.col("longest_gap_min").cast("bigint"))
    return scans.select(by, severity.alias("severity"), text.alias("line")).orderBy(S.natural_key(F.col(by).cast("string")))
