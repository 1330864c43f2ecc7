"""Every query of the library by name, with the SQL that gives the same rows.

Queries read the driver's tables through ``sources.events``: hourly counts for each user over 30 days as
readings, customers as subjects. Rounding happens here, never inside an operator.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import bins, curate, deprivation, groups, hmm, period, phase, phase_shift, runs, signal, sleep, states, stats
from .params import Curation, Hmm, Period, Preprocess, Sleep
from .sources import events, monitor, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STEP = 60
#: Bounds for hourly bins: an hour of rest is the shortest bout, and gaps of two hours are bridged.
HOURLY = Sleep(threshold_seconds=1800, short_max_minutes=120, intermediate_max_minutes=360, bridge_minutes=120)

BASE = """
WITH ev AS (
  SELECT user_id AS id, (date_diff('minute', TIMESTAMP '2024-01-01', ts::TIMESTAMP) // 60 * 60)::INT AS t, count(*) AS n, bool_or(event_type = 'error') AS failed
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2
), grid AS (
  SELECT id, unnest(range(0, 43200, 60))::INT AS t FROM (SELECT DISTINCT id FROM ev)
), readings AS (
  SELECT g.id, g.t, CASE WHEN NOT coalesce(failed, false) THEN coalesce(n, 0)::DOUBLE END AS activity FROM grid g LEFT JOIN ev USING (id, t)
), subjects AS (
  SELECT c_custkey AS id, c_mktsegment AS grp, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN 17280 ELSE 14400 END AS split_minute,
         CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 25320 ELSE 22440 END END AS pulse_minute FROM customer
), zt AS (
  SELECT id, t % 1440 AS zt_bin_minute, avg(activity) AS value FROM readings GROUP BY 1, 2
)"""
SLEEP = BASE + """, f0 AS (
  SELECT id, t, (activity > 0)::INT AS moving FROM readings
), f1 AS (
  SELECT *, sum(c) OVER (PARTITION BY id ORDER BY t) AS r FROM (SELECT *, ((moving IS NULL) <> lag(moving IS NULL) OVER (PARTITION BY id ORDER BY t))::INT AS c FROM f0)
), f2 AS (
  SELECT id, t, moving, count(*) OVER (PARTITION BY id, r) AS size, last_value(moving IGNORE NULLS) OVER (PARTITION BY id ORDER BY t) AS a,
         first_value(moving IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f1
), f3 AS (
  SELECT id, t, moving, coalesce(moving, CASE WHEN size <= 2 AND a = b THEN a END) AS filled FROM f2
), f4 AS (
  SELECT *, sum(c) OVER (PARTITION BY id ORDER BY t) AS run FROM (SELECT *, (filled IS DISTINCT FROM lag(filled) OVER (PARTITION BY id ORDER BY t))::INT AS c FROM f3)
), f5 AS (
  SELECT *, min(t) OVER (PARTITION BY id, run) AS start_t, max(t) OVER (PARTITION BY id, run) AS end_t FROM f4
), marked AS (
  SELECT *, CASE WHEN filled = 0 AND end_t - start_t >= 30 THEN CASE WHEN end_t - start_t < 120 THEN 'short' WHEN end_t - start_t < 360 THEN 'intermediate' ELSE 'long' END END AS state FROM f5
), minutes AS (
  SELECT id, t, state, CASE WHEN moving IS NOT NULL THEN (state IS NOT NULL)::INT END AS sleep FROM marked
), bouts AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY start_t) AS bout, start_t, end_t, duration_min, state
  FROM (SELECT DISTINCT id, start_t, end_t, (end_t - start_t)::DOUBLE AS duration_min, state FROM marked WHERE state IS NOT NULL)
)"""


def query(sql: str | None = None, base: str = BASE):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{base}\n{sql}" if base else sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers long, so that both engines hash the same values."""
    kinds = {"double": lambda c: F.round(c, places) + 0.0, "float": lambda c: F.round(c.cast("double"), places) + 0.0}
    whole = ("int", "smallint", "tinyint")
    return df.select(*[(kinds[k](F.col(c)) if k in kinds else F.col(c).cast("bigint") if k in whole else F.col(c)).alias(c) for c, k in df.dtypes])


def _r(spark, d):
    return events.readings(spark, d, STEP)


def _s(spark, d):
    return events.subjects(spark, d)


def _zt(spark, d):
    return bins.zt_bins(_r(spark, d), "activity", 60)


def _marked(spark, d):
    return sleep.marked_minutes(curate.with_moving(_r(spark, d)), HOURLY, STEP)


def _stretches(spark, d):
    """The same from stretches of equal hours, which are as many as events and not as hours."""
    return sleep.marked_minutes(curate.with_moving(events.reading_runs(spark, d, STEP)), HOURLY, STEP)


def _bouts(spark, d):
    return sleep.bouts(_stretches(spark, d))


# Profiles and totals


@query("""SELECT grp, zt_bin_minute::BIGINT AS zt_bin_minute, round(avg(value), 6) AS mean_val, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) AS sem_val,
 count(value) AS n, round((zt_bin_minute + 60.0) / 60, 6)::DOUBLE AS zt_hours FROM zt JOIN subjects USING (id) GROUP BY grp, zt_bin_minute""")
def zt_profile(spark, d):
    return rounded(bins.zt_profile(_zt(spark, d), _s(spark, d), 60))


@query("SELECT grp, zt_bin_minute::BIGINT AS zt_bin_minute, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n FROM zt JOIN subjects USING (id) GROUP BY ALL")
def zt_group_summary(spark, d):
    return rounded(bins.group_summary(_zt(spark, d), _s(spark, d)))


TOTALS = """SELECT id, coalesce(sum(value * 60), 0) AS all_day, coalesce(sum(value * 60) FILTER (zt_bin_minute < 720), 0) AS day_only, coalesce(sum(value * 60) FILTER (zt_bin_minute >= 720), 0) AS night_only,
 coalesce(sum(value * 60) FILTER (zt_bin_minute >= 1320 OR zt_bin_minute < 120), 0) AS custom FROM zt GROUP BY id"""


@query(f"SELECT id, round(all_day, 6) AS all_day, round(day_only, 6) AS day_only, round(night_only, 6) AS night_only, round(custom, 6) AS custom FROM ({TOTALS})")
def day_night_totals(spark, d):
    return rounded(bins.daily_totals(_zt(spark, d), 60, (22.0, 2.0)))


@query(f"""SELECT grp, count(*) AS n, round(avg(all_day), 6) AS all_day, round(CASE WHEN count(*) > 1 THEN stddev_samp(all_day) / sqrt(count(*)) ELSE 0 END, 6) AS all_day_sem
 FROM ({TOTALS}) JOIN subjects USING (id) GROUP BY grp""")
def group_totals(spark, d):
    return rounded(bins.group_totals(bins.daily_totals(_zt(spark, d), 60), _s(spark, d)).select("grp", "n", "all_day", "all_day_sem"))


@query("SELECT grp, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM (SELECT id, avg(activity) AS value FROM readings GROUP BY id) JOIN subjects USING (id) GROUP BY grp")
def metric_summary(spark, d):
    values = _r(spark, d).groupBy("id").agg(F.avg("activity").alias("value")).join(_s(spark, d), "id")
    return rounded(bins.metric_summary(values))


@query("SELECT id, (t // 360)::BIGINT AS bin, min(t)::BIGINT AS t, round(sum(activity), 6) AS activity FROM readings GROUP BY id, t // 360")
def rebinned(spark, d):
    return rounded(bins.rebin(_r(spark, d), "activity", 6, STEP))


@query("SELECT id, (t // 720)::BIGINT AS bin, round(coalesce(avg(activity), -1), 6) AS value FROM readings GROUP BY id, t // 720")
def heatmap(spark, d):
    return rounded(bins.heatmap(_r(spark, d), "activity", 720))


@query("SELECT id, (t - split_minute)::BIGINT AS t, round(activity, 6) AS activity FROM readings JOIN subjects USING (id) WHERE t >= split_minute")
def aligned_to_release(spark, d):
    return rounded(bins.aligned_to_release(_r(spark, d), _s(spark, d)))


ACTOGRAM = """, per AS (SELECT id, (t // 1440) AS day, (t % 1440) // 120 * 120 AS bin, sum(activity) AS x FROM readings GROUP BY ALL),
 acto AS (SELECT grp, day::BIGINT AS day, bin::BIGINT AS bin, avg(x) AS value FROM per JOIN subjects USING (id) GROUP BY ALL)"""


@query("SELECT grp, day, bin, round(value, 6) AS value FROM acto", BASE + ACTOGRAM)
def actogram_matrix(spark, d):
    return rounded(bins.group_actogram(_r(spark, d), _s(spark, d), 120, STEP))


@query("""SELECT grp, day AS row, 0::BIGINT AS place, bin, round(value, 6) AS value FROM acto UNION ALL
 SELECT a.grp, a.day, 1, a.bin, round(b.value, 6) FROM acto a LEFT JOIN acto b ON a.grp = b.grp AND b.day = a.day + 1 AND a.bin = b.bin""", BASE + ACTOGRAM)
def double_plotted(spark, d):
    return rounded(bins.double_plotted(bins.group_actogram(_r(spark, d), _s(spark, d), 120, STEP)))


@query("SELECT grp, day, bin, round(value, 6) AS value, (day * 1440 + bin + 120 <= (SELECT min(split_minute) FROM subjects s WHERE s.grp = acto.grp)) AS is_ld FROM acto", BASE + ACTOGRAM)
def actogram_ld_bins(spark, d):
    acto = bins.group_actogram(_r(spark, d), _s(spark, d), 120, STEP)
    return rounded(bins.ld_bins(acto, bins.group_boundaries(_s(spark, d)), 120)).select("grp", "day", "bin", "value", "is_ld")


@query("SELECT grp, round(1.1 * (max(value) - min(value)), 6) AS scale FROM acto GROUP BY grp", BASE + ACTOGRAM)
def actogram_scale(spark, d):
    return rounded(bins.panel_scale(bins.group_actogram(_r(spark, d), _s(spark, d), 120, STEP)))


@query("SELECT id, (t - (split_minute - 14400) // 1440 * 1440)::BIGINT AS t, round(activity, 6) AS activity FROM readings JOIN subjects USING (id) WHERE t >= (split_minute - 14400) // 1440 * 1440")
def align_on_release(spark, d):
    return rounded(bins.align_on_release(_r(spark, d), _s(spark, d)).select("id", "t", "activity"))


@query("SELECT grp, min(split_minute)::BIGINT AS split_minute, count(DISTINCT split_minute) > 1 AS mixed FROM subjects GROUP BY grp")
def group_boundaries(spark, d):
    return rounded(bins.group_boundaries(_s(spark, d)))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT zt_bin_minute::BIGINT AS zt_bin_minute, " + ", ".join(f"round(avg(value) FILTER (grp = '{g}'), 6) AS \"{g}\"" for g in SEGMENTS) + " FROM zt JOIN subjects USING (id) GROUP BY 1")
def pivot_export(spark, d):
    profile = bins.group_summary(_zt(spark, d), _s(spark, d))
    return rounded(bins.pivot_groups(profile, "zt_bin_minute", "grp", list(SEGMENTS), "mean"))


@query("SELECT grp, id, round(avg(activity), 6) AS activity FROM readings JOIN subjects USING (id) GROUP BY GROUPING SETS ((grp, id), (grp))")
def with_group_means(spark, d):
    return rounded(bins.with_group_means(_r(spark, d).join(_s(spark, d), "id"), "activity"))


@query("SELECT grp, zt_bin_minute::BIGINT AS x, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(y)), 6) AS sem, count(y) AS n FROM (SELECT id, zt_bin_minute, value / max(value) OVER (PARTITION BY id) AS y FROM zt) JOIN subjects USING (id) WHERE y IS NOT NULL AND NOT isnan(y) GROUP BY 1, 2")
def mean_scaled_curves(spark, d):
    curves = _zt(spark, d).select("id", F.col("zt_bin_minute").alias("x"), F.col("value").alias("y"))
    return rounded(bins.mean_curves(bins.scaled_curves(curves), _s(spark, d)))


# Runs, gaps and windows


@query("SELECT id, count(*) FILTER (activity > 0) AS moving, count(*) FILTER (activity = 0) AS still, count(*) FILTER (activity IS NULL) AS missing FROM readings GROUP BY id")
def moving_mask(spark, d):
    rows = curate.with_moving(_r(spark, d)).groupBy("id")
    return rows.agg(F.count(F.when(F.col("moving") == 1, 1)).alias("moving"), F.count(F.when(F.col("moving") == 0, 1)).alias("still"), F.count(F.when(F.col("moving").isNull(), 1)).alias("missing"))


@query("SELECT id, count(*) FILTER (filled IS NOT NULL AND moving IS NULL) AS filled, coalesce(sum(filled), 0)::BIGINT AS active FROM f3 GROUP BY id", SLEEP)
def short_gap_fill(spark, d):
    rows = runs.fill_short_gaps(curate.with_moving(_r(spark, d)), "moving", "filled", most=2)
    return rows.groupBy("id").agg(F.count(F.when(F.col("moving").isNull() & F.col("filled").isNotNull(), 1)).alias("filled"), F.coalesce(F.sum("filled"), F.lit(0)).cast("bigint").alias("active"))


@query("SELECT id, t::BIGINT AS t, round(avg(activity) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 6) AS mean FROM readings")
def rolling_activity(spark, d):
    return rounded(runs.rolling_mean(_r(spark, d), "activity", 24, "mean").select("id", "t", "mean"))


@query("SELECT id, t::BIGINT AS t, round(CASE WHEN count(activity) OVER w >= 3 THEN avg(activity) OVER w END, 6) AS mean FROM readings WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)")
def smoothed_activity(spark, d):
    return rounded(runs.smoothed(_r(spark, d), "activity", 6, "mean").select("id", "t", "mean"))


@query("""SELECT id, t::BIGINT AS t, round(coalesce(activity, x0 + (x1 - x0) * (t - t0) / (t1 - t0)), 6) AS filled FROM (SELECT id, t, activity,
 last_value(CASE WHEN activity IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, last_value(activity IGNORE NULLS) OVER a AS x0,
 first_value(CASE WHEN activity IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1, first_value(activity IGNORE NULLS) OVER b AS x1 FROM readings
 WINDOW a AS (PARTITION BY id ORDER BY t), b AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def interpolated(spark, d):
    return rounded(runs.interpolate(_r(spark, d), "activity", "filled").select("id", "t", "filled"))


@query("SELECT id, gap_start::BIGINT AS gap_start, gap_end::BIGINT AS gap_end, (gap_end - gap_start)::BIGINT AS minutes FROM (SELECT id, t AS gap_end, lag(t) OVER (PARTITION BY id ORDER BY t) AS gap_start FROM readings WHERE activity IS NOT NULL) WHERE gap_end - gap_start > 60")
def gap_scan(spark, d):
    return rounded(runs.gaps(_r(spark, d), "activity", threshold=60))


@query("""SELECT id, seg_start::BIGINT AS seg_start, seg_end::BIGINT AS seg_end, (seg_end - seg_start)::BIGINT AS minutes FROM (
 SELECT id, seg_start, seg_end, row_number() OVER (PARTITION BY id ORDER BY seg_end - seg_start DESC, seg_start) AS k FROM (
  SELECT id, piece, min(a) FILTER (NOT cut AND NOT m) AS seg_start, max(b) FILTER (NOT cut AND NOT m) AS seg_end FROM (
   SELECT *, sum(cut::INT) OVER (PARTITION BY id ORDER BY r) AS piece FROM (
    SELECT *, m AND coalesce(lead(a) OVER (PARTITION BY id ORDER BY r), b) - a >= 120 AS cut FROM (
     SELECT id, r, first(m) AS m, min(t) AS a, max(t) AS b FROM (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY t) AS r FROM (SELECT id, t, activity IS NULL AS m, coalesce((activity IS NULL) <> lag(activity IS NULL) OVER (PARTITION BY id ORDER BY t), false)::INT AS c FROM readings)) GROUP BY id, r))) GROUP BY id, piece) WHERE seg_start IS NOT NULL) WHERE k = 1""")
def longest_segment(spark, d):
    return rounded(runs.longest_segment(_r(spark, d), "activity", threshold=120, step=STEP))


@query("""SELECT id, block_start::BIGINT AS block_start, block_end::BIGINT AS block_end, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, block_start) AS k FROM (
 SELECT id, b, min(t) AS block_start, max(t) AS block_end, count(*) AS n FROM (SELECT id, t, sum(c) OVER (PARTITION BY id ORDER BY t) AS b FROM (SELECT id, t, coalesce(t - lag(t) OVER (PARTITION BY id ORDER BY t) > 120, false)::INT AS c FROM readings WHERE activity IS NOT NULL)) GROUP BY id, b)) WHERE k = 1""")
def longest_block(spark, d):
    return rounded(runs.longest_block(_r(spark, d), "activity", bridge=60, step=STEP))


@query("""SELECT id, state::BIGINT AS state, count(*) AS n, round(avg(len), 6) AS mean_length, round(stddev_samp(len), 6) AS sd_length FROM (SELECT id, r, first(m) AS state, count(*) AS len FROM (
 SELECT id, t, m, sum(c) OVER (PARTITION BY id ORDER BY t) AS r FROM (SELECT id, t, m, (m IS DISTINCT FROM lag(m) OVER (PARTITION BY id ORDER BY t))::INT AS c FROM (SELECT id, t, (activity > 0)::INT AS m FROM readings WHERE activity IS NOT NULL))) GROUP BY id, r) GROUP BY id, state""")
def state_run_lengths(spark, d):
    rows = curate.with_moving(_r(spark, d)).withColumn("state", F.col("moving"))
    return rounded(hmm.bout_lengths(rows))


@query("SELECT id, t::BIGINT AS t, round(sum(coalesce(activity, 0)) OVER (PARTITION BY id, t // 1440 ORDER BY t), 6) AS total FROM readings")
def running_totals(spark, d):
    rows = _r(spark, d).withColumn("day", S.day_index("t"))
    return rounded(runs.running_total(rows, "activity", "total", keys=["id", "day"], order="t").select("id", "t", "total"))


# Phases and curation


@query("SELECT id, count(activity) FILTER (t >= split_minute) AS dd, count(activity) FILTER (t < split_minute) AS ld, count(activity) FILTER (t >= split_minute + 1440) AS dd_late FROM readings JOIN subjects USING (id) GROUP BY id")
def phase_view_totals(spark, d):
    r, s = _r(spark, d), _s(spark, d)
    views = [phase.select_phase(r, s, p, ["activity"], late).groupBy("id").agg(F.count("activity").alias(n)) for p, late, n in (("DD", False, "dd"), ("LD", False, "ld"), ("DD", True, "dd_late"))]
    return views[0].join(views[1], "id").join(views[2], "id").join(s.select("id"), "id", "left_semi")


@query("SELECT CASE WHEN t < split_minute THEN 'LD' ELSE 'DD' END AS phase, count(DISTINCT id) AS subjects, count(activity) AS measured, count(*) - count(activity) AS missing FROM readings JOIN subjects USING (id) GROUP BY 1")
def split_report(spark, d):
    return phase.split_report(_r(spark, d), _s(spark, d))


@query("SELECT id, (t - 17280)::BIGINT AS t, round(activity, 6) AS activity FROM readings WHERE t >= 17280")
def split_rows(spark, d):
    return rounded(phase.split_phase(_r(spark, d), _s(spark, d), "DD").select("id", "t", "activity"))


@query("SELECT id, round(days, 6) AS days, days >= 4 AS enough FROM (SELECT id, CASE WHEN count(activity) >= 2 THEN (max(t) FILTER (activity IS NOT NULL) - min(t) FILTER (activity IS NOT NULL)) / 1440.0 ELSE 0 END AS days FROM readings GROUP BY id)")
def record_days(spark, d):
    return rounded(phase.record_days(_r(spark, d)))


@query("SELECT DISTINCT round(split_minute / 1440.0)::BIGINT AS onset_day FROM subjects")
def onset_days(spark, d):
    return rounded(phase.onset_days(_s(spark, d)))


@query("""SELECT id, count(*) FILTER (al = 1) AS live, count(*) FILTER (al = 0) AS dead, count(*) FILTER (al IS NULL) AS unknown FROM (
 SELECT id, CASE WHEN coalesce(long AND t <= fin, false) THEN 1 WHEN m IS NULL AND long THEN NULL ELSE 0 END AS al FROM (
  SELECT *, CASE WHEN la >= ls THEN 2147483647 ELSE la END AS fin, (la - f) / 1440.0 >= 2 AS long FROM (
   SELECT id, t, m, max(CASE WHEN rm > 0.08 THEN t END) OVER p AS la, max(CASE WHEN m IS NOT NULL THEN t END) OVER p AS ls, min(t) OVER p AS f FROM (
    SELECT id, t, m, avg(m) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS rm FROM (SELECT id, t, (activity > 0)::INT AS m FROM readings)) WINDOW p AS (PARTITION BY id)))) GROUP BY id""")
def curation_calls(spark, d):
    rows = curate.alive(_r(spark, d), Curation(immobility_proportion=0.08), STEP).groupBy("id")
    return rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("live", F.col("is_alive") == 1), ("dead", F.col("is_alive") == 0), ("unknown", F.col("is_alive").isNull()))])


# Sleep and states


@query("SELECT id, bout::BIGINT AS bout, start_t::BIGINT AS start_t, end_t::BIGINT AS end_t, duration_min, state FROM bouts", SLEEP)
def immobility_bouts(spark, d):
    return rounded(_bouts(spark, d))


@query("SELECT id, count(*) FILTER (sleep = 1) AS sleep, count(*) FILTER (sleep = 1 AND state = 'short') AS short, count(*) FILTER (sleep = 1 AND state = 'intermediate') AS intermediate, count(*) FILTER (sleep = 1 AND state = 'long') AS long FROM minutes GROUP BY id", SLEEP)
def sleep_minutes(spark, d):
    m = sleep.minutes(_stretches(spark, d))
    return rounded(bins.state_totals(m, ["sleep", "sleep_short", "sleep_intermediate", "sleep_long"])).toDF("id", "sleep", "short", "intermediate", "long")


@query("SELECT id, count(*) AS n_bouts, round(median(duration_min), 6) AS median_duration_min, round(pow(10, avg(log10(duration_min))), 6) AS log_mean_duration_min FROM bouts GROUP BY id", SLEEP)
def bout_summary(spark, d):
    return rounded(sleep.bout_summary(_bouts(spark, d)))


@query("""SELECT b.id, g.j::BIGINT AS j, round(g.x, 4) AS x, round(avg((b.duration_min > g.x + 1e-9)::INT), 6) AS y FROM bouts b JOIN (SELECT id FROM bouts GROUP BY id HAVING count(*) >= 2) USING (id)
 CROSS JOIN (SELECT j, lo + j * (hi - lo) / 49 AS x FROM (SELECT min(duration_min) AS lo, max(duration_min) AS hi FROM bouts JOIN (SELECT id FROM bouts GROUP BY id HAVING count(*) >= 2) USING (id)), range(50) r(j)) g GROUP BY b.id, g.j, g.x""", SLEEP)
def bout_survival(spark, d):
    return rounded(sleep.survival(_bouts(spark, d), 50)).withColumn("x", F.round("x", 4))


@query("SELECT id, bout::BIGINT AS bout, state FROM bouts JOIN (SELECT id, min(t) FILTER (activity IS NOT NULL) AS lo, max(t) FILTER (activity IS NOT NULL) AS hi FROM readings JOIN subjects USING (id) WHERE t >= split_minute GROUP BY id) USING (id) WHERE start_t BETWEEN lo AND hi", SLEEP)
def bouts_in_phase(spark, d):
    s = _s(spark, d)
    view = phase.select_phase(_r(spark, d).join(s.select("id"), "id", "left_semi"), s, "DD", ["activity"])
    return rounded(sleep.bouts_in_view(_bouts(spark, d), view).select("id", "bout", "state"))


@query("SELECT id, state, bin_hour::BIGINT AS bin_hour, round(coalesce(c, 0) / n_bouts, 6) AS probability, n_bouts FROM (SELECT id, state, count(*) AS n_bouts FROM both_ GROUP BY ALL) CROSS JOIN (SELECT unnest(range(1, 25)) AS bin_hour) LEFT JOIN (SELECT id, state, (start_t % 1440) // 60 + 1 AS bin_hour, count(*) AS c FROM both_ GROUP BY ALL) USING (id, state, bin_hour)", SLEEP + ", both_ AS (SELECT id, start_t, state FROM bouts UNION ALL SELECT id, start_t, 'standard' FROM bouts)")
def initiation_probability(spark, d):
    return rounded(states.initiation(_bouts(spark, d)))


PROFILE = SLEEP + """, prof AS (SELECT id, s.state, t % 1440 AS zt_bin_minute, avg(CASE WHEN sleep IS NOT NULL THEN CASE WHEN s.state = 'standard' THEN sleep ELSE coalesce(minutes.state = s.state, false)::INT END END) * 60.0 AS value
 FROM minutes CROSS JOIN (VALUES ('standard'), ('short'), ('intermediate'), ('long')) s(state) GROUP BY 1, 2, 3)"""


@query("SELECT id, state, zt_bin_minute::BIGINT AS zt_bin_minute, round(value, 6) AS value FROM prof", PROFILE)
def state_profiles(spark, d):
    return rounded(states.profiles(sleep.minutes(_marked(spark, d)), 60))


@query("""SELECT grp, state, zt_bin_minute::BIGINT AS zt_bin_minute, round(mean / scale, 6) AS mean_normalized, round(sem / scale, 6) AS sem_normalized, round(scale, 6) AS scale FROM (SELECT *, max(mean) OVER (PARTITION BY grp, state) AS scale FROM (
 SELECT grp, state, zt_bin_minute, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem FROM prof JOIN subjects USING (id) GROUP BY ALL)) WHERE scale > 0""", PROFILE)
def normalized_waveform(spark, d):
    profile = states.profiles(sleep.minutes(_marked(spark, d)), 60)
    return rounded(states.waveforms(states.group_profiles(profile, _s(spark, d))))


CIRCLE = PROFILE + """, circ AS (SELECT id, state, sqrt(c * c + s * s) / w AS r, ((atan2(s, c) * 12 / pi()) % 24 + 24) % 24 AS h FROM (SELECT id, state, sum(value * cos(a)) AS c, sum(value * sin(a)) AS s, sum(value) AS w
 FROM (SELECT id, state, value, radians((zt_bin_minute + 30.0) / 4) AS a FROM prof WHERE value > 0) GROUP BY ALL) WHERE w > 0 AND sqrt(c * c + s * s) / w > 1e-9)"""


@query("SELECT id, state, round(h, 3) AS mean_phase_h, round(r, 4) AS r, round(degrees(sqrt(2 * (1 - least(1, r)))) / 15, 3) AS angular_deviation_h FROM circ WHERE r < 0.99", CIRCLE)
def circular_centre_of_mass(spark, d):
    profile = states.profiles(sleep.minutes(_marked(spark, d)), 60)
    out = states.circular(profile, 60, "never").where("r < 0.99").select("id", "state", "mean_phase_h", "r", "angular_deviation_h")
    return out.withColumns({c: F.round(c, k) + 0.0 for c, k in (("mean_phase_h", 3), ("r", 4), ("angular_deviation_h", 3))})


@query("SELECT grp, state, count(*) AS n, round(sqrt(avg(cos(h * pi() / 12)) ** 2 + avg(sin(h * pi() / 12)) ** 2), 5) AS r, round(avg(d), 5) AS angular_deviation_h FROM (SELECT *, degrees(sqrt(2 * (1 - least(1, r)))) / 15 AS d FROM circ) JOIN subjects USING (id) GROUP BY grp, state", CIRCLE)
def phase_gates(spark, d):
    profile = states.profiles(sleep.minutes(_marked(spark, d)), 60)
    centres = states.circular(profile, 60, "never")
    gates = states.gates(centres, _s(spark, d)).select("grp", "state", "n", F.round("angular_deviation_h", 5).alias("angular_deviation_h"))
    rayleigh = states.rayleigh(centres.join(_s(spark, d).select("id", "grp"), "id"), ["grp", "state"]).select("grp", "state", F.round("r", 5).alias("r"))
    return gates.join(rayleigh, ["grp", "state"]).select("grp", "state", "n", "r", "angular_deviation_h")


# Deprivation


DAYS_ = SLEEP + ", db AS (SELECT id, t // 1440 AS day, (t % 1440) // 120 * 120 AS zt_bin_minute, avg(sleep) AS value FROM minutes GROUP BY ALL), base AS (SELECT id, zt_bin_minute, avg(value) AS baseline FROM db WHERE day < 10 GROUP BY ALL), rec AS (SELECT id, day, zt_bin_minute, baseline, value, value - baseline AS difference FROM db JOIN base USING (id, zt_bin_minute) WHERE day > 10)"


def _day_bins(spark, d):
    return deprivation.day_bins(sleep.minutes(_marked(spark, d)), 120)


@query("SELECT grp, day::BIGINT AS day, zt_bin_minute::BIGINT AS zt_bin_minute, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) AS sem, count(value) AS n FROM db JOIN subjects USING (id) GROUP BY ALL", DAYS_)
def sd_day_traces(spark, d):
    return rounded(deprivation.day_traces(_day_bins(spark, d), _s(spark, d)))


@query("SELECT id, zt_bin_minute::BIGINT AS zt_bin_minute, day::BIGINT AS day, round(value, 6) AS value, round(baseline, 6) AS baseline, round(difference, 6) AS difference, round(120 * sum(coalesce(difference, 0)) OVER (PARTITION BY id, day ORDER BY zt_bin_minute), 5) AS cumulative_minutes FROM rec", DAYS_)
def sd_baseline_recovery(spark, d):
    return rounded(deprivation.recovery(_day_bins(spark, d), 10, 120)).withColumn("cumulative_minutes", F.round("cumulative_minutes", 5) + 0.0)


@query("""SELECT id, day::BIGINT AS day, part, round(b, 5) AS baseline_min, round(r, 5) AS recovery_min, round(CASE WHEN b > 0 THEN (r - b) / b * 100 END, 5) AS rebound_percent FROM (
 SELECT id, day, part, sum(baseline) * 120 AS b, sum(value) * 120 AS r FROM (SELECT *, 'day' AS part FROM rec UNION ALL SELECT *, CASE WHEN zt_bin_minute < 720 THEN 'light' ELSE 'dark' END FROM rec) GROUP BY ALL)""", DAYS_)
def sd_rebound(spark, d):
    out = deprivation.rebound(deprivation.recovery(_day_bins(spark, d), 10, 120), 120)
    return rounded(out, 5)


# Groups, pairing, sets


@query("SELECT c_custkey AS id, concat_ws('-', coalesce(nullif(c_mktsegment, ''), 'nan'), c_nationkey::VARCHAR) AS grp FROM customer", "")
def group_labels(spark, d):
    return groups.regroup(_s(spark, d), ["grp", "nation"]).select("id", "grp")


@query("SELECT id, grp, nation FROM subjects WHERE (grp = 'BUILDING' AND nation IN (1, 2, 3)) OR (grp = 'MACHINERY' AND nation = 7)")
def subset_keep(spark, d):
    s = _s(spark, d)
    a = groups.subset(s, {"grp": "BUILDING", "nation": ["1", 2.0, 3]})
    return a.union(groups.subset(s, [{"grp": "MACHINERY", "nation": "7"}])).select("id", "grp", "nation")


@query("SELECT id, 'left' AS side FROM (SELECT DISTINCT user_id AS id FROM events) WHERE id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)", "")
def unmatched_ids(spark, d):
    return groups.unmatched(events.event_minutes(spark, d), _s(spark, d))


@query("SELECT DISTINCT grp || '-' || (nation % 2)::VARCHAR AS grp, grp || '-0' AS control_grp FROM subjects")
def control_pairing(spark, d):
    s = _s(spark, d).select("id", F.col("grp").alias("segment"), (F.col("nation") % 2).alias("treated"))
    return groups.matched_controls(groups.regroup(s, ["segment", "treated"]), "treated", 0, ["segment"])


@query("SELECT id::VARCHAR || CASE k WHEN 0 THEN '' ELSE '_b' END AS id, count(*) AS n FROM (SELECT id, 0 AS k FROM readings UNION ALL SELECT id, 1 FROM readings WHERE t < 1440) GROUP BY ALL")
def union_datasets(spark, d):
    r = _r(spark, d)
    return groups.combine(r, r.where("t < 1440")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.id, count(*) AS n FROM readings r WHERE NOT EXISTS (SELECT 1 FROM subjects s WHERE s.id = r.id AND s.grp = 'BUILDING') GROUP BY r.id")
def anti_join_failed(spark, d):
    failed = _s(spark, d).where("grp = 'BUILDING'")
    return _r(spark, d).join(failed, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# Import


def _monitor_rows(spark, d):
    log = events.event_minutes(spark, d)
    ts = F.timestamp_add("MINUTE", F.floor(F.col("t") / 60).cast("int") * 60, F.lit(events.ORIGIN).cast("timestamp_ntz"))
    return log.select(F.col("id").alias("monitor"), F.xxhash64("id", "t", "value").alias("line"), ts.alias("ts"), F.when(F.col("event_type") == "error", 51).otherwise(1).alias("status"), F.lit(1).alias("channel"), F.round("value", 6).alias("value"), "t")


@query("""SELECT user_id AS monitor, count(*) AS slots, count(*) FILTER (ok) AS valid FROM (SELECT user_id, date_trunc('hour', ts) AS h, bool_or(event_type <> 'error') AS ok FROM events GROUP BY ALL) GROUP BY user_id""", "")
def dedup_status(spark, d):
    rows = monitor.resolve_status(_monitor_rows(spark, d))
    return rows.groupBy("monitor").agg(F.count(F.lit(1)).alias("slots"), F.count("value").alias("valid"))


@query("""SELECT monitor, present, (span // 60 + 1)::BIGINT AS expected, n_gaps, longest_gap_min FROM (SELECT user_id AS monitor, count(*) AS present, date_diff('minute', min(h), max(h)) AS span, count(*) FILTER (step > 600) AS n_gaps, coalesce(max(step) FILTER (step > 600), 0) AS longest_gap_min
 FROM (SELECT user_id, h, date_diff('minute', lag(h) OVER (PARTITION BY user_id ORDER BY h), h) AS step FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events)) GROUP BY user_id)""", "")
def time_scan(spark, d):
    rows = _monitor_rows(spark, d)
    span = rows.groupBy("monitor").agg((F.floor(F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")) / 60) + 1).alias("expected"))
    found = monitor.scan_times(rows, 600).select("monitor", "present", "n_gaps", "longest_gap_min")
    return rounded(found.join(span, "monitor").select("monitor", "present", "expected", "n_gaps", "longest_gap_min"))


@query("SELECT id, count(*) AS slots, count(activity) AS valid, 0::BIGINT AS cosmetic, count(*) - count(activity) AS error_only, 0::BIGINT AS absent, (count(*) FILTER (activity IS NULL AND before))::BIGINT AS loss_spans FROM (SELECT *, coalesce(lag(activity IS NOT NULL) OVER (PARTITION BY id ORDER BY t), true) AS before FROM readings) GROUP BY id")
def irregularities(spark, d):
    grid = _r(spark, d).select("id", "t", F.col("activity").isNotNull().alias("has_valid"), F.col("activity").isNull().alias("has_error"))
    return rounded(monitor.irregularities(grid))


@query("SELECT concat_ws('_', '20240101', c_custkey::VARCHAR, r::VARCHAR) AS id, r::BIGINT AS region FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN range(1, 33) WHEN 1 THEN [1, 2, 3, 7] ELSE range(5, 9) END) AS r FROM customer)", "")
def region_expand(spark, d):
    cell = F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, "1-3, 7, 2").otherwise("5..8")
    sheet = _s(spark, d).select(F.col("id").alias("Monitor"), F.lit("2024-01-01 09:00:00").alias("start_datetime"), cell.alias("region_id"))
    return rounded(monitor.expand_metadata(sheet).select("id", "region"))


# Signals, periods, rhythm


@query("SELECT id, t::BIGINT AS t, round(y - (my + coalesce(cov / nullif(vx, 0), 0) * (i - mx)), 5) AS y FROM (SELECT id, t, activity AS y, i, avg(activity) OVER p AS my, avg(i) OVER p AS mx, covar_pop(activity, i) OVER p AS cov, var_pop(i) OVER p AS vx FROM (SELECT id, t, activity, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS i FROM readings WHERE activity IS NOT NULL) WINDOW p AS (PARTITION BY id))")
def linear_detrend(spark, d):
    return rounded(signal.detrended(_r(spark, d), "activity", "y").where("y IS NOT NULL").select("id", "t", "y"), 5)


@query("SELECT id, t::BIGINT AS t, round((activity - avg(activity) OVER p) / coalesce(nullif(stddev_pop(activity) OVER p, 0), 1), 5) AS z FROM readings WINDOW p AS (PARTITION BY id)")
def zscore(spark, d):
    return rounded(signal.standardized(_r(spark, d), "activity", "z").select("id", "t", "z"), 5)


#: The library's range of periods, closer together than a record of 30 days tells apart near a day.
LS_PERIODS = tuple(16 + k / 2 for k in range(41))
LS = BASE + """, y AS (SELECT id, t, activity - avg(activity) OVER (PARTITION BY id) AS y FROM readings WHERE activity IS NOT NULL),
 m AS (SELECT id, p AS period, y, cos(2 * pi() * t / (60.0 * p)) AS c, sin(2 * pi() * t / (60.0 * p)) AS s FROM y CROSS JOIN (SELECT 16 + k / 2.0::DOUBLE AS p FROM range(41) r(k)) v),
 q AS (SELECT id, period, sum(c * c) - sum(c) * sum(c) / count(*) AS cc, sum(s * s) - sum(s) * sum(s) / count(*) AS ss, sum(c * s) - sum(c) * sum(s) / count(*) AS cs, sum(y * c) AS yc, sum(y * s) AS ys, sum(y * y) AS yy FROM m GROUP BY ALL),
 ls AS (SELECT id, period, CASE WHEN yy > 0 THEN (yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs) / ((cc * ss - cs * cs) * yy) END AS power FROM q)"""


@query("SELECT id, period, round(power, 6) AS power FROM ls", LS)
def ls_fixed_grid(spark, d):
    return rounded(period.spectrum(_r(spark, d), list(LS_PERIODS)))


def _calls(spark, d):
    power = period.spectrum(_r(spark, d), list(LS_PERIODS))
    best = power.groupBy("id").agg(F.max(F.struct("power", -F.col("period"))).alias("b")).select("id", F.lit("ls").alias("method"), (-F.col("b")["col2"]).alias("period"), F.col("b.power").alias("strength"), F.lit(None).cast("double").alias("rhythmic_power"))
    return period.classify(best)


@query("""SELECT method, coalesce(grp, 'ALL') AS grp, count(*) AS n_total, count(*) FILTER (r) AS n_rhythmic, count(*) FILTER (NOT r) AS n_arrhythmic, round(100.0 * count(*) FILTER (r) / count(*), 6)::DOUBLE AS percent_rhythmic
 FROM (SELECT 'ls' AS method, grp, coalesce(max(power) > 0.006 AND arg_max(period, (power, -period)) BETWEEN 16 AND 32, false) AS r FROM ls JOIN subjects USING (id) GROUP BY id, grp) GROUP BY GROUPING SETS ((method, grp), (method))""", LS)
def rhythm_summary(spark, d):
    return rounded(period.rhythm_summary(_calls(spark, d), _s(spark, d)))


@query("SELECT threshold, count(p) AS n, count(*) FILTER (p > threshold) AS n_above, round(100.0 * count(*) FILTER (p > threshold) / count(p), 6)::DOUBLE AS percent FROM (SELECT id, max(power) AS p FROM ls GROUP BY id) CROSS JOIN (VALUES (0.002::DOUBLE), (0.006), (0.01), (0.02)) v(threshold) GROUP BY threshold", LS)
def threshold_sweep(spark, d):
    return rounded(period.threshold_sweep(_calls(spark, d), "strength", [0.002, 0.006, 0.01, 0.02]))


@query("""SELECT id, period, round(sum(c * (m - mean) ** 2) / first(var), 4) AS q, (count(*) - 1)::BIGINT AS dof FROM (SELECT id, p AS period, i % (p::BIGINT) AS k, avg(x) AS m, count(*) AS c, first(mean) AS mean, first(var) AS var FROM (
 SELECT id, activity AS x, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS i, avg(activity) OVER (PARTITION BY id) AS mean, var_pop(activity) OVER (PARTITION BY id) AS var FROM readings WHERE activity IS NOT NULL) CROSS JOIN (SELECT k::DOUBLE AS p FROM range(16, 37) r(k)) v WHERE var > 0 GROUP BY ALL) GROUP BY id, period""")
def chi_sq_periodogram(spark, d):
    return rounded(period.chi_square(_r(spark, d), [float(k) for k in range(16, 37)], step=STEP), 4)


@query("""SELECT id, lag / 60.0::DOUBLE AS lag_hours, round(s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY id), 5) AS r FROM (SELECT a.id, l.lag, sum(a.x * b.x) AS s FROM x a CROSS JOIN (SELECT unnest(range(0, 1441, 120)) AS lag) l JOIN x b ON b.id = a.id AND b.t = a.t + l.lag GROUP BY ALL) QUALIFY max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY id) > 0""",
 BASE + ", x AS (SELECT id, t, coalesce(activity - avg(activity) OVER (PARTITION BY id), 0) AS x FROM readings)")
def acf_lags(spark, d):
    return rounded(period.correlogram(_r(spark, d), step=120, max_hours=24), 5)


# Phase markers

PEAKS = BASE + ", peaks AS (SELECT id, (t // 1440) AS day, arg_max(t, (activity, -t))::DOUBLE AS minute, max(activity) AS a FROM readings WHERE activity IS NOT NULL GROUP BY ALL HAVING max(activity) > 0)"


@query("SELECT id, day::BIGINT AS day, minute FROM peaks", PEAKS)
def daily_peaks(spark, d):
    return rounded(signal.daily_peaks(_r(spark, d)))


@query("SELECT id, round(regr_slope(minute, day) / 60, 6) AS slope_hours, round(regr_r2(minute, day), 6) AS r2, count(*) AS n FROM peaks GROUP BY id", PEAKS)
def marker_lines(spark, d):
    return rounded(phase_shift.lines(signal.daily_peaks(_r(spark, d))))


@query("""SELECT s.id, coalesce(status, CASE WHEN pulse_minute IS NULL THEN 'no_pulse' ELSE 'pulse_outside_record' END) AS status, coalesce(npre, 0) AS n_pre_days, coalesce(npost, 0) AS n_post_days, round(a, 5) AS pre_period, round(b, 5) AS post_period,
 round(CASE WHEN status = 'ok' THEN ((raw + b / 2) % b + b) % b - b / 2 END, 5) AS phase_shift_hours FROM subjects s LEFT JOIN (
 SELECT *, CASE WHEN npre < 3 THEN 'insufficient_pre' WHEN npost < 3 THEN 'insufficient_post' WHEN a BETWEEN 16 AND 36 AND b BETWEEN 16 AND 36 THEN 'ok' ELSE 'implausible_period' END AS status FROM (
  SELECT id, count(*) FILTER (d < 0) AS npre, count(*) FILTER (d > 0) AS npost, regr_slope(minute, d) FILTER (d < 0) / 60 AS a, regr_slope(minute, d) FILTER (d > 0) / 60 AS b, (regr_intercept(minute, d) FILTER (d > 0) - regr_intercept(minute, d) FILTER (d < 0)) / 60 AS raw
  FROM (SELECT id, minute, day - pulse_minute // 1440 AS d FROM peaks JOIN subjects USING (id) WHERE pulse_minute IS NOT NULL AND day >= split_minute // 1440) WHERE d <> 0 GROUP BY id)) USING (id)""", PEAKS)
def marker_shifts(spark, d):
    found = phase_shift.shifts(signal.daily_peaks(_r(spark, d)), _s(spark, d))
    return rounded(found.select("id", "status", F.coalesce("n_pre_days", F.lit(0)).alias("n_pre_days"), F.coalesce("n_post_days", F.lit(0)).alias("n_post_days"), "pre_period", "post_period", "phase_shift_hours"), 5)


# Statistics


@query("SELECT grp, count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS var FROM (SELECT id, avg(activity) AS v FROM readings GROUP BY id) JOIN subjects USING (id) GROUP BY grp")
def welch_sufficient_stats(spark, d):
    values = _r(spark, d).groupBy("id").agg(F.avg("activity").alias("v")).join(_s(spark, d), "id")
    return rounded(stats.moments(values, "v"))


@query("SELECT grp, count(*)::BIGINT AS n, sum(r)::DOUBLE AS rank_sum FROM (SELECT grp, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM (SELECT id, sum(activity) AS v FROM readings GROUP BY id) JOIN subjects USING (id)) GROUP BY grp")
def rank_sums(spark, d):
    values = _r(spark, d).groupBy("id").agg(F.sum("activity").alias("v")).join(_s(spark, d), "id")
    return rounded(stats.ranks(values, "v").select("grp", "n", "rank_sum"))


@query("SELECT id, p, round(max(x) OVER (ORDER BY p, id), 6) AS p_holm FROM (SELECT id, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1)) AS x FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 10007 + 1) / 20014.0::DOUBLE AS p FROM customer))", "")
def holm_adjust(spark, d):
    tests = _s(spark, d).select("id", ((F.col("id") * 7919 % 10007 + 1) / F.lit(20014.0)).alias("p"))
    return stats.holm_adjusted(tests, by=None).withColumn("p_holm", F.round("p_holm", 6))


# The minute grid: the library's own bounds of sleep


MINUTES = SLEEP.replace("// 60 * 60)::INT AS t", ")::INT AS t").replace("range(0, 43200, 60)", "range(0, 43200)").replace("size <= 2", "size <= 4").replace("end_t - start_t >= 30", "end_t - start_t >= 5").replace("< 120 THEN", "< 30 THEN").replace("< 360 THEN", "< 60 THEN")


@query("SELECT id, count(*) FILTER (sleep = 1) AS sleep, count(*) FILTER (sleep = 1 AND state = 'short') AS short, count(*) FILTER (sleep = 1 AND state = 'intermediate') AS intermediate, count(*) FILTER (sleep = 1 AND state = 'long') AS long FROM minutes GROUP BY id", MINUTES)
def minute_sleep(spark, d):
    m = sleep.minutes(sleep.marked_minutes(curate.with_moving(events.reading_runs(spark, d, 1))))
    return rounded(bins.state_totals(m, ["sleep", "sleep_short", "sleep_intermediate", "sleep_long"])).toDF("id", "sleep", "short", "intermediate", "long")


@query("SELECT grp, state, round(avg(value), 5) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 5) AS sem, count(value) AS n FROM (SELECT m.id, s.state, count(*) FILTER (sleep = 1 AND (s.state = 'sleep' OR m.state = substr(s.state, 7))) AS value FROM minutes m CROSS JOIN (VALUES ('sleep'), ('sleep_short'), ('sleep_intermediate'), ('sleep_long')) s(state) GROUP BY ALL) JOIN subjects USING (id) GROUP BY grp, state", SLEEP)
def state_bars(spark, d):
    names = ["sleep", "sleep_short", "sleep_intermediate", "sleep_long"]
    return rounded(bins.state_bars(bins.state_totals(sleep.minutes(_stretches(spark, d)), names), _s(spark, d), names), 5)


@query("SELECT id, CASE WHEN duration_min < 240 THEN 'short' WHEN duration_min < 600 THEN 'intermediate' ELSE 'long' END AS state, count(*) AS n FROM bouts GROUP BY ALL", SLEEP)
def reclassified_bouts(spark, d):
    other = Sleep(threshold_seconds=1800, short_max_minutes=240, intermediate_max_minutes=600)
    return sleep.reclassified(_bouts(spark, d), other).groupBy("id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT b.id, b.t::BIGINT AS t, b.state FROM minutes b WHERE b.sleep = 1", SLEEP)
def minutes_of_bouts(spark, d):
    marked = _stretches(spark, d)
    return rounded(sleep.minutes_of_bouts(sleep.bouts(marked), sleep.each_minute(sleep.minutes(marked), STEP), STEP).select("id", "t", "state"))


# Import and files


@query("SELECT user_id AS monitor, CASE WHEN event_type = 'error' THEN 51 ELSE 1 END::BIGINT AS status, count(DISTINCT (date_trunc('minute', ts), value)) AS n, CASE WHEN event_type = 'error' THEN 'no data received' ELSE 'valid data' END AS label FROM events GROUP BY ALL", "")
def status_counts(spark, d):
    return rounded(monitor.status_counts(_monitor_rows(spark, d)).select("monitor", "status", "n", "label"))


@query("SELECT id, (split_minute + id % 4 * 30)::BIGINT AS split_minute FROM subjects WHERE id % 4 <> 0")
def off_grid_starts(spark, d):
    return rounded(monitor.off_grid_starts(_s(spark, d).withColumn("split_minute", (F.col("split_minute") + F.col("id") % 4 * 30).cast("int"))))


@query("SELECT DISTINCT id FROM readings WHERE id % 5 = 0")
def silent_channels(spark, d):
    return monitor.silent_channels(_r(spark, d).withColumn("activity", F.when(F.col("id") % 5 != 0, F.col("activity"))))


WINDOWS = """WITH tubes AS (SELECT c_custkey AS monitor, TIMESTAMP '2024-01-01' + to_days((c_custkey % 5 * 9)::INT) AS start_ts, TIMESTAMP '2024-01-03' + to_days((c_custkey % 5 * 9)::INT) AS stop_ts, c_custkey % 3 AS most FROM customer),
 seen AS (SELECT user_id AS monitor, date_trunc('hour', ts) AS h FROM events), spans AS (SELECT monitor, min(h) AS a, max(h) AS b FROM seen GROUP BY monitor)"""


@query("""SELECT monitor, start_ts, reason FROM (SELECT monitor, start_ts, CASE WHEN a IS NULL THEN 'no_file' WHEN stop_ts < a OR start_ts > b THEN 'window_outside_file' WHEN n = 0 THEN 'no_rows_in_window' WHEN most > 1 THEN 'tubes_outside_file' END AS reason FROM tubes LEFT JOIN spans USING (monitor)
 LEFT JOIN (SELECT monitor, count(*) FILTER (h BETWEEN start_ts AND stop_ts) AS n FROM tubes JOIN seen USING (monitor) GROUP BY monitor) USING (monitor)) WHERE reason IS NOT NULL""", WINDOWS)
def window_checks(spark, d):
    day = F.col("id") % 5 * 9
    start = F.timestamp_add("DAY", day.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    tubes = _s(spark, d).select(F.col("id").alias("monitor"), start.alias("start_ts"), F.timestamp_add("DAY", day.cast("int"), F.lit("2024-01-03").cast("timestamp_ntz")).alias("stop_ts"), (F.col("id") % 3).alias("region"))
    return monitor.check_windows(tubes, _monitor_rows(spark, d))


@query("SELECT id, (t // 1800)::BIGINT AS block, CASE WHEN count(activity) = 30 THEN sum(activity)::BIGINT ELSE -1 END AS value FROM readings GROUP BY id, t // 1800")
def encoded_blocks(spark, d):
    return rounded(sinks.half_hours(_r(spark, d).withColumn("t", (F.col("t") / STEP).cast("int"))))


@query("SELECT id, CASE id % 4 WHEN 0 THEN (id % 24)::DOUBLE WHEN 1 THEN id % 24 + 0.5 END AS hour, id % 4 = 3 AS unreadable FROM subjects")
def pulse_cells(spark, d):
    hour = (F.col("id") % 24).cast("string")
    cell = F.when(F.col("id") % 4 == 0, F.concat(F.lit("zt "), hour)).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), hour, F.lit(".5"))).when(F.col("id") % 4 == 3, "noon").otherwise(" ")
    rows = _s(spark, d).select("id", cell.alias("cell"))
    return rows.select("id", S.parse_zt_hour("cell").alias("hour"), F.coalesce(S.unreadable_zt("cell"), F.lit(False)).alias("unreadable"))


@query("SELECT c_custkey AS id, round(((c_acctbal::DOUBLE / 100 + 12) % 24 + 24) % 24 - 12, 6) AS wrapped, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, replace(c_name, '#', '_') AS name FROM (SELECT *, c_custkey % 997 / 9970.0 AS p FROM customer)", "")
def labels_of_values(spark, d):
    rows = events.table(spark, d, "customer")
    p = F.col("c_custkey") % 997 / F.lit(9970.0)
    return rounded(rows.select(F.col("c_custkey").alias("id"), S.wrap_hours(F.col("c_acctbal").cast("double") / 100).alias("wrapped"), S.stars(p).alias("stars"), S.safe_name("c_name").alias("name")))


@query("SELECT v, row_number() OVER (ORDER BY n) AS ord FROM (SELECT DISTINCT 'ZT' || c_nationkey::VARCHAR AS v, c_nationkey AS n FROM customer)", "")
def ordered_levels(spark, d):
    levels = _s(spark, d).select(F.concat(F.lit("ZT"), F.col("nation").cast("string")).alias("v"))
    return rounded(groups.order_levels(levels, "v"))


# Calls of rhythm, from results as every method gives them


CALLS = BASE + """, res AS (SELECT id, grp, ['ls', 'ac', 'mesa', 'cwt'][m + 1] AS method, 12.0::DOUBLE + (id + m) % 24 AS period, ((id * 7 + m) % 100) / 40.0::DOUBLE AS strength, ((id * 3 + m) % 100) / 100.0::DOUBLE AS rhythmic_power FROM subjects CROSS JOIN range(4) r(m)),
 own AS (SELECT *, period BETWEEN 16 AND 32 AND CASE method WHEN 'ls' THEN strength > 0.006 WHEN 'ac' THEN rhythmic_power > 0.3 WHEN 'cwt' THEN strength > 2.0 ELSE false END AS mine FROM res),
 calls AS (SELECT *, CASE WHEN method = 'mesa' THEN bool_or(mine AND method = 'ac') OVER (PARTITION BY id) ELSE mine END AS rhythmic FROM own)"""


def _results(spark, d):
    rows = _s(spark, d).select("id", F.posexplode(F.array(*map(F.lit, ("ls", "ac", "mesa", "cwt")))).alias("m", "method"))
    return period.classify(rows.select("id", "method", (12.0 + (F.col("id") + F.col("m")) % 24).alias("period"), (((F.col("id") * 7 + F.col("m")) % 100) / F.lit(40.0)).alias("strength"), (((F.col("id") * 3 + F.col("m")) % 100) / F.lit(100.0)).alias("rhythmic_power")))


@query("SELECT id, method, period, strength, rhythmic FROM calls", CALLS)
def rhythm_calls(spark, d):
    return _results(spark, d).select("id", "method", "period", "strength", "rhythmic")


@query("SELECT id, max(period) FILTER (method = 'ls') AS ls_period, max(strength) FILTER (method = 'ls') AS ls_strength, bool_or(rhythmic) FILTER (method = 'ls') AS ls_rhythmic, max(period) FILTER (method = 'cwt') AS cwt_period, max(strength) FILTER (method = 'cwt') AS cwt_strength, bool_or(rhythmic) FILTER (method = 'cwt') AS cwt_rhythmic FROM calls GROUP BY id", CALLS)
def period_table(spark, d):
    return period.wide(_results(spark, d), ["ls", "cwt"])


@query("SELECT s.id, s.grp FROM subjects s JOIN calls c ON s.id = c.id AND c.method = 'ls' AND c.rhythmic", CALLS)
def rhythmic_subjects(spark, d):
    return groups.rhythmic_only(_s(spark, d), _results(spark, d).where("method = 'ls'")).select("id", "grp")


# Markers, responses and tests on few numbers


@query("SELECT id, count(activity) FILTER (pulse_minute IS NULL OR t < pulse_minute OR t >= pulse_minute + 240) AS n FROM readings LEFT JOIN subjects USING (id) GROUP BY id")
def masked_pulses(spark, d):
    return phase_shift.mask_pulse(_r(spark, d), _s(spark, d), duration_minutes=240).groupBy("id").agg(F.count("activity").alias("n"))


@query("SELECT id, coalesce(pulse_minute, split_minute - 1440 + (SELECT median(pulse_minute - split_minute + 1440) FROM subjects WHERE pulse_minute IS NOT NULL))::DOUBLE AS reference_minute FROM subjects")
def reference_pulses(spark, d):
    return phase_shift.reference_pulses(_s(spark, d))


RESPONSES = BASE + """, sh AS (SELECT id, grp, id % 11 / 2.0::DOUBLE - 2 AS h FROM subjects), c AS (SELECT atan2(avg(sin(h * pi() / 12)), avg(cos(h * pi() / 12))) * 12 / pi() AS c FROM sh WHERE grp = 'BUILDING'),
 resp AS (SELECT id, grp, ((c.c - h + 12) % 24 + 24) % 24 - 12 AS response_hours FROM sh, c WHERE grp <> 'BUILDING')"""


def _responses(spark, d):
    s = _s(spark, d)
    shifted = s.select("id", F.lit("ok").alias("status"), (F.col("id") % 11 / F.lit(2.0) - 2).alias("phase_shift_hours"))
    controls = s.select("grp").distinct().where("grp <> 'BUILDING'").withColumn("control_grp", F.lit("BUILDING"))
    return phase_shift.responses(shifted, s, controls)


@query("SELECT id, grp, round(response_hours, 6) AS response_hours FROM resp", RESPONSES)
def phase_responses(spark, d):
    return rounded(_responses(spark, d).select("id", "grp", "response_hours"))


@query("SELECT grp, round(avg(response_hours), 6) AS mean, round(stddev_samp(response_hours), 6) AS sd, round(CASE WHEN count(*) > 1 THEN stddev_samp(response_hours) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM resp GROUP BY grp", RESPONSES)
def response_summary(spark, d):
    return rounded(phase_shift.summarize(_responses(spark, d), "response_hours", ["grp"]))


@query("SELECT grp, n, round(r, 6) AS r, round(greatest(0, least(1, exp(-n * r * r) * CASE WHEN n < 50 THEN 1 + (2 * z - z ** 2) / (4 * n) - (24 * z - 132 * z ** 2 + 76 * z ** 3 - 9 * z ** 4) / (288 * n ** 2) ELSE 1 END)), 6) AS p FROM (SELECT *, n * r * r AS z FROM (SELECT grp, count(*) AS n, sqrt(avg(cos(h * pi() / 12)) ** 2 + avg(sin(h * pi() / 12)) ** 2) AS r FROM (SELECT grp, minute % 1440 / 60 AS h FROM peaks JOIN subjects USING (id) WHERE day < 3) GROUP BY grp))", PEAKS)
def rayleigh_tests(spark, d):
    peaks = signal.daily_peaks(_r(spark, d)).where("day < 3").join(_s(spark, d).select("id", "grp"), "id")
    return rounded(states.rayleigh(peaks.withColumn("mean_phase_h", F.pmod("minute", F.lit(1440.0)) / 60), ["grp"]).select("grp", "n", "r", "p"))


HALVES = BASE + ", diffs AS (SELECT id, grp, avg(activity) FILTER (t >= split_minute) - avg(activity) FILTER (t < split_minute) AS v FROM readings JOIN subjects USING (id) GROUP BY ALL)"


@query("SELECT grp, count(v) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(v) >= 3 AND var_samp(v) > 0 THEN avg(v) / sqrt(var_samp(v) / count(v)) END, 6) AS t, count(v) - 1 AS df FROM diffs WHERE v IS NOT NULL GROUP BY grp", HALVES)
def paired_differences(spark, d):
    rows, s = _r(spark, d), _s(spark, d).select("id", "grp", "split_minute")
    half = lambda c: rows.join(s, "id").where(c).groupBy("id", "grp").agg(F.avg("activity").alias("v"))
    return rounded(stats.compare_paired(half("t < split_minute"), half("t >= split_minute"), "v"))


# Decoded states


DECODED = BASE + ", dec AS (SELECT id, t, ((activity::BIGINT + t // 60 + id) % 4) AS state FROM readings WHERE activity IS NOT NULL)"
SHARES = ", ".join(f"round(avg((state = {k})::INT), 6) AS state_{k}" for k in range(4))


def _decoded(spark, d):
    state = (F.col("activity").cast("bigint") + F.floor(F.col("t") / 60) + F.col("id")) % 4
    return _r(spark, d).where("activity IS NOT NULL").select("id", "t", state.cast("tinyint").alias("state"), (state < 2).cast("tinyint").alias("hmm_sleep"))


@query("SELECT id, " + ", ".join(f"round(100.0 * avg((state = {k})::INT), 6) AS state_{k}" for k in range(4)) + " FROM dec GROUP BY id", DECODED)
def state_occupancy(spark, d):
    return rounded(hmm.occupancy(_decoded(spark, d)))


@query(f"SELECT id, (t % 1440 // 120 * 120)::BIGINT AS zt_bin_minute, {SHARES} FROM dec GROUP BY 1, 2", DECODED)
def state_fractions(spark, d):
    return rounded(hmm.zt_fractions(_decoded(spark, d), 4, 120))


@query("SELECT grp, section::BIGINT AS section, " + ", ".join(f"round(avg(s{k}), 6) AS state_{k}" for k in range(4)) + " FROM (SELECT id, t % 1440 // 360 AS section, " + ", ".join(f"avg((state = {k})::INT) AS s{k}" for k in range(4)) + " FROM dec GROUP BY 1, 2) JOIN subjects USING (id) GROUP BY 1, 2", DECODED)
def state_sections(spark, d):
    return rounded(hmm.section_fractions(_decoded(spark, d), _s(spark, d)))


@query("SELECT grp, round(avg(p), 6) AS sleep_percent, round(stddev_pop(p), 6) AS sleep_percent_sd FROM (SELECT id, 100.0 * avg((state < 2)::INT) AS p FROM dec GROUP BY id) JOIN subjects USING (id) GROUP BY grp", DECODED)
def hidden_sleep_summary(spark, d):
    return rounded(hmm.summary(_decoded(spark, d), _s(spark, d)).select("grp", "sleep_percent", "sleep_percent_sd"))


# Estimators and models: held against known answers in the tests


@query()
def preprocessed(spark, d):
    return period.preprocess(_r(spark, d), Preprocess(bin_minutes=60, lowpass_hours=4, detrend="linear", normalize="zscore"), step=STEP)


@query()
def period_estimates(spark, d):
    return period.classify(period.run(_r(spark, d), Period(step_minutes=STEP, mesa_bin_minutes=60)))


@query()
def phase_markers(spark, d):
    return phase_shift.markers(_r(spark, d), _s(spark, d), step=STEP)


@query()
def group_tests(spark, d):
    values = _r(spark, d).groupBy("id").agg(F.avg("activity").alias("v")).join(_s(spark, d), "id")
    return stats.compare(values, "v", "welch", measure="activity").unionByName(stats.compare(values, "v", "rank", measure="activity"))


@query()
def hidden_states(spark, d):
    settings = Hmm()
    seen, s = hmm.observations(_r(spark, d)), _s(spark, d)
    return hmm.occupancy(hmm.decode(seen, s, hmm.train(seen, s, settings), settings))


#: Cumulative probabilities of a Poisson number with mean one.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


@query("""SELECT grp, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high, n FROM (SELECT grp, avg(v) AS mean, count(v) AS n FROM vals GROUP BY grp) JOIN (
 SELECT grp, stddev_samp(m) AS sd, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT grp, r, sum(w * v) / sum(w) AS m FROM (SELECT grp, r, v, """ + " + ".join(f"(u >= {x!r})::INT" for x in POISSON) + """ AS w FROM (
 SELECT grp, r, v, ('0x' || substr(md5('0:' || id::VARCHAR || ':' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM vals CROSS JOIN range(200) q(r))) GROUP BY grp, r HAVING sum(w) > 0) GROUP BY grp) USING (grp)""",
 BASE + ", vals AS (SELECT id, grp, avg(activity) AS v FROM readings JOIN subjects USING (id) GROUP BY ALL)")
def bootstrap_means(spark, d):
    values = _r(spark, d).groupBy("id").agg(F.avg("activity").alias("v")).join(_s(spark, d), "id")
    return rounded(phase_shift.bootstrap_mean(values, "v", "grp"))


DAILY = PEAKS + """, met AS (
  SELECT id, grp, day - coalesce(pulse_minute, split_minute + 8040) // 1440 AS k, (minute - day * 1440) / 60 AS h FROM peaks JOIN subjects USING (id)
), expected AS (
  SELECT k, avg(h) AS e FROM met WHERE grp = 'BUILDING' GROUP BY k
), ahead AS (
  SELECT id, grp, avg(e - h) FILTER (k IN (2, 3, 4)) AS raw, count(*) FILTER (k IN (2, 3, 4)) AS n, avg(e - h) FILTER (k = -1) AS before FROM met JOIN expected USING (k) WHERE k IN (-1, 2, 3, 4) GROUP BY ALL
)"""


@query("SELECT id, grp, 'BUILDING' AS control_grp, round(raw - coalesce(before, 0), 6) AS response_hours, round(raw, 6) AS response_hours_raw, n AS n_days_used, before IS NOT NULL AS baseline_used FROM ahead WHERE n > 0", DAILY)
def daily_responses(spark, d):
    s = _s(spark, d)
    controls = s.select("grp").distinct().withColumn("control_grp", F.lit("BUILDING"))
    return rounded(phase_shift.daily_responses(signal.daily_peaks(_r(spark, d)), s, controls))


@query("SELECT d AS day, 14400 + d * 1440 AS start_minute, 14400 + (d + 1) * 1440 AS end_minute FROM range((43200 - 14400) // 1440) q(d)", "")
def experiment_days(spark, d):
    return phase.experiment_days(_r(spark, d), _s(spark, d), "DD", STEP)


@query("""SELECT 'LD' AS phase, id, count(activity) FILTER (split_minute IS NULL OR t < split_minute) AS n, round(sum(activity) FILTER (split_minute IS NULL OR t < split_minute), 6) AS total FROM readings LEFT JOIN subjects USING (id) GROUP BY id
 UNION ALL SELECT 'DD', id, count(activity) FILTER (split_minute IS NULL OR t >= split_minute), round(sum(activity) FILTER (split_minute IS NULL OR t >= split_minute), 6) FROM readings LEFT JOIN subjects USING (id) GROUP BY id""")
def epoch_totals(spark, d):
    def totals(view):
        return view.groupBy("id").agg(F.count("activity").alias("n"), F.sum("activity").alias("total"))

    return rounded(phase.per_epoch(_r(spark, d), _s(spark, d), ["activity"], totals))


@query("SELECT id, zt_bin_minute::BIGINT AS zt_bin_minute, round(value, 6) AS value, round(quantile_cont(value, 0.5) OVER (PARTITION BY id ORDER BY zt_bin_minute ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS baseline FROM zt")
def running_median(spark, d):
    return rounded(period.running_median(_zt(spark, d), value="value", order="zt_bin_minute"))


@query("SELECT grp, zt_bin_minute::BIGINT AS zt_bin_minute, round(avg(p), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(p) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM (SELECT id, t % 1440 // 120 * 120 AS zt_bin_minute, avg((state < 2)::INT) AS p FROM dec GROUP BY 1, 2) JOIN subjects USING (id) GROUP BY 1, 2", DECODED)
def state_timecourse(spark, d):
    return rounded(hmm.group_timecourse(_decoded(spark, d), _s(spark, d), bin_minutes=120))


@query("SELECT n_nationkey::BIGINT AS monitor, CASE n_nationkey % 4 WHEN 0 THEN 'in/Monitor' || n_nationkey || '.txt' WHEN 1 THEN 'in/Monitor' || lpad(n_nationkey::VARCHAR, 3, '0') || '.txt' WHEN 2 THEN 'in/monitor' || n_nationkey || '.TXT' END AS path FROM nation", "")
def monitor_files(spark, d):
    n = events.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("monitor"))
    text = F.col("monitor").cast("string")
    spelled = F.when(F.col("monitor") % 4 == 0, F.concat(F.lit("in/Monitor"), text, F.lit(".txt"))).when(F.col("monitor") % 4 == 1, F.concat(F.lit("in/Monitor"), F.lpad(text, 3, "0"), F.lit(".txt"))).when(F.col("monitor") % 4 == 2, F.concat(F.lit("in/monitor"), text, F.lit(".TXT")))
    return monitor.monitor_files(n.select(spelled.alias("path")).where("path IS NOT NULL"), n)


@query()
def bout_density(spark, d):
    return sleep.duration_density(_bouts(spark, d), 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_phase  # noqa: F401  it registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_phase  # noqa: F401

    return dict(SQL)
