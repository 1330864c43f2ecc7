"""Raw monitor files and metadata sheets, and what can be wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FIXED = ["line", "date", "time", "status", "extras", "monitor_number", "tube_number", "data_type", "unused", "light"]
REQUIRED = ("Monitor", "start_datetime", "stop_datetime", "genotype")


class MetadataError(ValueError):
    def __init__(self, reason: str, detail: str) -> None:
        super().__init__(f"{reason}: {detail}")
        self.reason = reason


def read_monitor(spark: SparkSession, path: str, channels: int = 32) -> DataFrame:
    """``monitor, line, ts, status, channel, value`` of tab-separated files named Monitor<N>.txt.

    Times are rounded to the minute. A date in another form than "8 Jan 25" fails the read.
    """
    schema = ", ".join([f"{c} {'int' if c in ('line', 'status') else 'string'}" for c in FIXED] + [f"c{k} int" for k in range(1, channels + 1)])
    raw = spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")
    ts = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("d MMM yy HH:mm:ss"))
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    # Half a minute goes to the even one.
    minute = F.floor(seconds / 60) + F.when(F.pmod(seconds, F.lit(60)) == 30, F.pmod(F.floor(seconds / 60), F.lit(2))).when(F.pmod(seconds, F.lit(60)) > 30, 1).otherwise(0)
    number = F.regexp_extract(F.col("_metadata.file_name"), "(?i)monitor0*([0-9]+)", 1)
    base = raw.select(number.alias("monitor"), "line", F.timestamp_seconds(minute * 60).cast("timestamp_ntz").alias("ts"), "status", *[f"c{k}" for k in range(1, channels + 1)])
    long = base.unpivot(["monitor", "line", "ts", "status"], [f"c{k}" for k in range(1, channels + 1)], "channel", "value")
    return long.withColumn("channel", F.substring("channel", 2, 9).cast("int"))


def resolve_status(rows: DataFrame) -> DataFrame:
    """One row for each monitor, time and channel: the first valid one, else a null. Failed reads have no value."""
    own = Window.partitionBy("monitor", "channel", "ts").orderBy(F.desc(F.col("status") == 1), "line")
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").withColumn("value", F.when(F.col("status") == 1, F.col("value"))).drop("__n")


def status_counts(rows: DataFrame) -> DataFrame:
    """``monitor, status, label, n`` of input rows, one for each line."""
    lines = rows.select("monitor", "line", "ts", "status").distinct()
    return lines.groupBy("monitor", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("label", S.status_label("status"))


def scan_times(rows: DataFrame, threshold_minutes: int | None = None, by: str = "monitor") -> DataFrame:
    """``monitor, interval_min, present, expected, missing, coverage, n_gaps, longest_gap_min``.

    The expected interval is the most frequent one; a gap is longer than the threshold, by default the larger
    of twice the interval and an hour.
    """
    times = rows.select(by, "ts").distinct()
    order = Window.partitionBy(by).orderBy("ts")
    steps = times.withColumn("step", F.timestamp_diff("MINUTE", F.lag("ts").over(order), F.col("ts")))
    modal = steps.groupBy(by).agg(F.mode(F.col("step"), True).alias("interval_min"), F.count(F.lit(1)).alias("present"), F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")).alias("span"))
    modal = modal.withColumn("limit", F.lit(threshold_minutes) if threshold_minutes else F.greatest(2 * F.coalesce("interval_min", F.lit(1)), F.lit(60)))
    wide = steps.join(modal.select(by, "limit"), by).where(F.col("step") > F.col("limit")).groupBy(by).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("step").alias("longest_gap_min"))
    out = modal.join(wide, by, "left").withColumn("expected", F.coalesce(F.floor(F.col("span") / F.col("interval_min")), F.lit(0)) + 1)
    missing = F.greatest(F.lit(0), F.col("expected") - F.col("present"))
    return out.select(by, "interval_min", "present", "expected", missing.alias("missing"), (F.col("present") / F.col("expected")).alias("coverage"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("longest_gap_min", F.lit(0)).alias("longest_gap_min"))


def irregularities(grid: DataFrame) -> DataFrame:
    """``id, slots, valid, cosmetic, error_only, absent, loss_spans`` from slots with ``has_valid, has_error``."""
    order = Window.partitionBy("id").orderBy("t")
    lost = ~F.col("has_valid")
    rows = grid.withColumn("__start", lost & ~F.coalesce(F.lag(lost).over(order), F.lit(False)))
    n = lambda c: F.sum(c.cast("int"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("slots"), n(F.col("has_valid")).alias("valid"), n(F.col("has_valid") & F.col("has_error")).alias("cosmetic"), n(lost & F.col("has_error")).alias("error_only"), n(lost & ~F.col("has_error")).alias("absent"), n(F.col("__start")).alias("loss_spans"))


def expand_metadata(sheet: DataFrame, channels: int = 32) -> DataFrame:
    """A row per tube: "1-16", "1..16", "1,3,5" and mixtures; blank is every channel. Ids are date_monitor_region."""
    cell = F.coalesce(F.nullif(F.trim(F.col("region_id").cast("string")), F.lit("")), F.lit(f"1-{channels}"))
    parts = F.transform(F.split(cell, ","), lambda p: F.split(F.trim(F.regexp_replace(p, "\\.\\.", "-")), "-"))
    numbers = F.transform(parts, lambda p: F.sequence(F.trim(p[0]).cast("double").cast("int"), F.trim(F.element_at(p, -1)).cast("double").cast("int")))
    rows = sheet.withColumn("region", F.explode(F.array_distinct(F.flatten(numbers))))
    label = F.concat_ws("_", F.date_format(F.col("start_datetime").cast("timestamp_ntz"), "yyyyMMdd"), F.col("Monitor").cast("string"), F.col("region").cast("string"))
    return rows.withColumn("id", label)


def check_metadata(sheet: DataFrame) -> None:
    """Raises with a reason where the sheet is empty, lacks columns, or has times that cannot be."""
    if missing := [c for c in REQUIRED if c not in sheet.columns]:
        raise MetadataError("missing_columns", ", ".join(missing))
    start, stop = (F.col(c).cast("string").try_cast("timestamp_ntz") for c in ("start_datetime", "stop_datetime"))
    r = sheet.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(start.isNull() | stop.isNull(), 1)).alias("unreadable"), F.count(F.when(stop <= start, 1)).alias("backward")).first()
    for reason, bad in (("empty", r["n"] == 0), ("unreadable_dates", r["unreadable"]), ("stop_before_start", r["backward"])):
        if bad:
            raise MetadataError(reason, f"{r[reason.split('_')[0]] if reason == 'unreadable_dates' else bad} rows")


def check_windows(tubes: DataFrame, rows: DataFrame) -> DataFrame:
    """``monitor, start_ts, reason``: windows that have no file, fall outside it, hold no row or lack tubes."""
    spans = rows.groupBy("monitor").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("channel").alias("channels"))
    asked = tubes.groupBy("monitor", "start_ts", "stop_ts").agg(F.max("region").alias("most"))
    held = asked.join(rows.select("monitor", "ts").distinct(), "monitor", "left").groupBy("monitor", "start_ts", "stop_ts", "most").agg(F.count(F.when(F.col("ts").between(F.col("start_ts"), F.col("stop_ts")), 1)).alias("n"))
    joined = held.join(spans, "monitor", "left")
    reason = F.when(F.col("first").isNull(), "no_file").when((F.col("stop_ts") < F.col("first")) | (F.col("start_ts") > F.col("last")), "window_outside_file").when(F.col("n") == 0, "no_rows_in_window").when(F.col("most") > F.col("channels"), "tubes_outside_file")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("monitor", "start_ts", "reason")


def without_failed(tubes: DataFrame, failed: DataFrame) -> DataFrame:
    return tubes.join(failed, ["monitor", "start_ts"], "left_anti")


def align(rows: DataFrame, tubes: DataFrame) -> DataFrame:
    """``id, t, activity``: dense minutes from each subject's own start (rounded up) to its stop (rounded down)."""
    start = F.date_trunc("minute", F.col("start_ts") + F.expr("INTERVAL 59 SECONDS")).cast("timestamp_ntz")
    stop = F.date_trunc("minute", F.col("stop_ts")).cast("timestamp_ntz")
    own = tubes.select("id", "monitor", F.col("region").alias("channel"), start.alias("__start"), F.timestamp_diff("MINUTE", start, stop).cast("int").alias("__last"))
    grid = own.select("id", F.explode(F.sequence(F.lit(0), "__last")).alias("t"))
    found = rows.join(own, ["monitor", "channel"]).select("id", F.timestamp_diff("MINUTE", F.col("__start"), F.col("ts")).cast("int").alias("t"), F.col("value").cast("float").alias("activity"))
    return grid.join(found, ["id", "t"], "left")


def split_minutes(tubes: DataFrame) -> DataFrame:
    """``split_minute`` and ``pulse_minute`` from dates.

    A pulse has its date in ``pulse_ts`` or, as ``pulse_columns`` gives it, in ``pulse_time``. Where ``pulse_time`` is text,
    a date in it counts as well, and one known by ZT only falls on the last light day.
    """
    minutes = lambda c: F.rint((F.unix_timestamp(c.cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))) / 60)
    out = tubes.withColumn("split_minute", minutes(F.col("first_dd_ts")).cast("int"))
    kinds, found = dict(tubes.dtypes), []
    if "pulse_ts" in kinds:
        found.append(minutes(F.col("pulse_ts")))
    if kinds.get("pulse_time", "").startswith("timestamp"):
        found.append(minutes(F.col("pulse_time")))
    elif "pulse_time" in kinds:
        found += [minutes(S.pulse_datetime("pulse_time")), F.col("split_minute") - 1440 + S.parse_zt_hour("pulse_time") * 60]
    return out.withColumn("pulse_minute", F.coalesce(*found, F.lit(None).cast("double")).cast("float"))


def off_grid_starts(tubes: DataFrame) -> DataFrame:
    """Subjects whose first DD day is not whole days after their start: a caveat, not an exclusion."""
    return tubes.where(F.col("split_minute").isNotNull() & (F.pmod("split_minute", F.lit(1440)) != 0)).select("id", "split_minute")


def silent_channels(readings: DataFrame) -> DataFrame:
    """Subjects without any measured minute: a caveat."""
    return readings.groupBy("id").agg(F.count("activity").alias("n")).where("n = 0").select("id")


def monitor_files(files: DataFrame, monitors: DataFrame) -> DataFrame:
    """``monitor, path`` of each monitor's file among ``files`` (``path``); null where there is none.

    The number as it is written comes first, then with two and three digits; each in that spelling before any other
    case, and of other cases the first in order.
    """
    plain = F.col("monitor").cast("string")
    number = F.when(F.trim(plain).rlike("^[0-9]+$"), F.trim(plain).cast("bigint"))
    padded = [F.when(F.length(number.cast("string")) <= width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string")) for width in (2, 3)]
    spelled = monitors.select("monitor", F.posexplode(F.array(plain, *padded)).alias("at", "digits")).where("digits IS NOT NULL")
    wanted = spelled.select("monitor", "at", F.concat(F.lit("Monitor"), "digits", F.lit(".txt")).alias("wanted"))
    known = files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    met = wanted.join(known, F.lower("wanted") == F.lower("name"))
    best = met.groupBy("monitor").agg(F.min(F.struct(F.col("wanted") != F.col("name"), "at", "name", "path")).alias("best"))
    return monitors.select("monitor").distinct().join(best, "monitor", "left").select("monitor", F.col("best.path").alias("path"))


def pulse_columns(sheet: DataFrame, row: str = "row") -> DataFrame:
    """``pulse_datetime`` and ``pulse_duration`` of a sheet as ``pulse_time`` and ``pulse_duration_min``; a fault names the sheet's rows.

    A row without a pulse has a null time and lasts 0 minutes. A sheet with neither column is returned as it is.
    """
    has, lasts = "pulse_datetime" in sheet.columns, "pulse_duration" in sheet.columns
    if not (has or lasts):
        return sheet
    for new, old in (("pulse_datetime", "pulse_time"), ("pulse_duration", "pulse_duration_min")):
        if new in sheet.columns and old in sheet.columns:
            raise MetadataError("both_pulse_columns", f"{old} is what {new} becomes: a sheet with both has two answers")
    if not has:
        raise MetadataError("no_pulse_datetime", "durations of pulses are given without their times (pulse_datetime)")
    blank = F.coalesce(F.lower(F.trim(F.col("pulse_datetime").cast("string"))).isin("", "nat", "nan"), F.lit(True))
    when = F.when(~blank, S.pulse_datetime("pulse_datetime"))
    cell = F.trim(F.col("pulse_duration").cast("string")) if lasts else F.lit(None).cast("string")
    minutes = cell.try_cast("double")
    minutes = F.when(~F.isnan(minutes), minutes)
    written = ~F.coalesce(F.lower(cell).isin("", "nan", "none"), F.lit(True))
    checks = {
        "pulse_datetime cannot be read as a date and time": ~blank & when.isNull(),
        "pulse_duration is not a number of minutes": written & minutes.isNull(),
        "a pulse has no duration above 0": ~blank & ~F.coalesce(minutes > 0, F.lit(False)),
        "a duration has no pulse": blank & (F.coalesce(minutes, F.lit(0.0)) != 0),
    }
    bad = sheet.agg(*[F.count_if(wrong).alias(f"n{i}") for i, wrong in enumerate(checks.values())]).first()
    for i, (said, wrong) in enumerate(checks.items()):
        if bad[i]:
            rows = [str(r[0]) for r in sheet.where(wrong).select(row).orderBy(row).limit(10).collect()]
            raise MetadataError("pulse_rows", f"{said}: {bad[i]} row(s), {', '.join(rows)}{' ...' if bad[i] > len(rows) else ''}")
    out = sheet.withColumns({"pulse_time": when, "pulse_duration_min": F.when(blank, F.coalesce(minutes, F.lit(0.0))).otherwise(minutes).cast("float")})
    return out.drop("pulse_datetime", "pulse_duration")
