"""Queries on phases, spectra over time and their uncertainty; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import curves, phase_response, scalograms, signal, stats
from .params import Period
from .queries import BASE, PEAKS, POISSON, STEP, _r, _s, _zt, query, rounded
from .sources import monitor

WRAP = "((({0}) + 12) % 24 + 24) % 24 - 12"


def _wrap(x: str) -> str:
    return WRAP.format(f"round({x}, 9)")


def _controls(s, itself: bool):
    rows = s.select("grp").distinct()
    return (rows if itself else rows.where("grp <> 'BUILDING'")).withColumn("control_grp", F.lit("BUILDING"))


# Scalograms: the transform as a sum over all samples of a record

#: Wavelet periods in samples of an hour, two to an octave.
WAVES = Period(min_period=16.0, max_period=32.0, voices=2, step_minutes=STEP)
SURFACE = BASE + """, seen AS (
  SELECT id, t, activity, sum(c) OVER (PARTITION BY id ORDER BY t) AS b FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY id ORDER BY t) > 120, false)::INT AS c FROM readings WHERE activity IS NOT NULL)
), longest AS (
  SELECT id, t0, t1 FROM (SELECT id, min(t) AS t0, max(t) AS t1, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(t)) AS k FROM seen GROUP BY id, b) WHERE k = 1
), filled AS (
  SELECT id, (t - t0) // 60 AS i, coalesce(activity, (lag(activity) OVER o + lead(activity) OVER o) / 2) AS x FROM readings JOIN longest USING (id) WHERE t BETWEEN t0 AND t1 WINDOW o AS (PARTITION BY id ORDER BY t)
), record AS (
  SELECT id, grp, i, x - avg(x) OVER (PARTITION BY id) AS x, count(*) OVER (PARTITION BY id) AS n, stddev_pop(x) OVER (PARTITION BY id) AS sd FROM filled JOIN subjects USING (id)
), rec AS (
  SELECT id, grp, i, x, min(n) OVER (PARTITION BY grp) AS m FROM record WHERE n >= 10 AND sd > 0
), kernel AS (
  SELECT p, d, exp(-pow(d / p, 2) / 1.5) * cos(2 * pi() * d / p) / sqrt(1.5 * pi() * p) AS re, exp(-pow(d / p, 2) / 1.5) * sin(2 * pi() * d / p) / sqrt(1.5 * pi() * p) AS im
  FROM (SELECT unnest([16.0::DOUBLE, pow(2, 4.5), 32.0]) AS p), (SELECT unnest(range(-719, 720)) AS d)
), surface AS (
  SELECT id, grp, p, a.i, pow(sum(b.x * re), 2) + pow(sum(b.x * im), 2) AS power
  FROM (SELECT id, grp, i FROM rec WHERE i < m) a JOIN (SELECT id, i, x FROM rec) b USING (id) JOIN kernel ON d = b.i - a.i GROUP BY ALL)"""


@query("SELECT grp, round(p, 6) AS period, i::BIGINT AS hour, count(*) AS n, round(avg(power), 5) AS power FROM surface GROUP BY ALL", SURFACE)
def group_scalograms(spark, d):
    found = scalograms.group_scalograms(_r(spark, d), _s(spark, d), WAVES)
    rows = scalograms.cells(found).join(found.select("grp", "period", "n"), ["grp", "period"])
    return rows.select("grp", F.round("period", 6).alias("period"), F.col("hours").cast("bigint").alias("hour"), "n", (F.round("power", 5) + 0.0).alias("power"))


# Phase responses by regression


REGRESSION = PEAKS + f""", own AS (
  SELECT id, grp, split_minute // 1440 AS sd, coalesce(pulse_minute, split_minute + 8040) // 1440 AS pd FROM subjects
), m AS (
  SELECT id, grp, day - pd - 1 AS x, minute - (pd + 1) * 1440 AS y, (minute - day * 1440) / 60 AS h, day < pd AS pre FROM peaks JOIN own USING (id) WHERE day <> pd AND day >= sd
), lines AS (
  SELECT id, grp, count(*) FILTER (NOT pre) AS n_post, count(*) FILTER (pre) AS n_pre, regr_slope(y, x) FILTER (NOT pre) AS slope, regr_intercept(y, x) FILTER (NOT pre) / 60 AS post,
         regr_slope(y, x) FILTER (pre) AS pre_slope, regr_intercept(y, x) FILTER (pre) / 60 AS pre_at, avg(sin(h * pi() / 12)) FILTER (pre) AS sn, avg(cos(h * pi() / 12)) FILTER (pre) AS cs FROM m GROUP BY ALL
), centre AS (
  SELECT *, CASE WHEN sqrt(sn * sn + cs * cs) > 1e-9 THEN (atan2(sn, cs) * 12 / pi() + 24) % 24 END AS c FROM lines
), near AS (
  SELECT id, avg({_wrap('h - c')}) AS w FROM m JOIN centre USING (id) WHERE pre GROUP BY id
), phases AS (
  SELECT id, grp, n_post, slope / 60 AS period, (round(CASE WHEN n_pre >= 2 AND round(abs(pre_slope - 1440), 9) > 30 THEN pre_at ELSE c + w END, 9) % 24 + 24) % 24 AS pre, (round(post, 9) % 24 + 24) % 24 AS post
  FROM centre LEFT JOIN near USING (id) WHERE n_post >= 3 AND n_pre >= 1 AND slope / 60 BETWEEN 16 AND 36
), moved AS (
  SELECT *, {_wrap('post - pre')} AS change FROM phases
), long AS (
  SELECT id, grp, unnest(['pre', 'post', 'change']) AS what, unnest([pre, post, change]) AS h FROM moved
), centres AS (
  SELECT grp, what, CASE WHEN sqrt(pow(avg(sin(h * pi() / 12)), 2) + pow(avg(cos(h * pi() / 12)), 2)) > 1e-9 THEN (atan2(avg(sin(h * pi() / 12)), avg(cos(h * pi() / 12))) * 12 / pi() + 24) % 24 END AS c FROM long WHERE h IS NOT NULL GROUP BY ALL
), means AS (
  SELECT grp, what, c + avg({_wrap('h - c')}) AS mean FROM long JOIN centres USING (grp, what) GROUP BY grp, what, c
)"""
RESPONSE = f"""SELECT id, p.grp, 'BUILDING' AS control_grp, round({{}}, 6) AS response_hours, round(-({_wrap('post - cp.mean')}), 6) AS response_hours_raw, n_post AS n_days_used, {{}} AS baseline_used,
 round(pre, 6) AS pre_phase_hours, round(post, 6) AS post_phase_hours, round(period, 6) AS period_hours FROM moved p JOIN means cp ON cp.grp = 'BUILDING' AND cp.what = 'post'
 LEFT JOIN means cb ON cb.grp = 'BUILDING' AND cb.what = 'pre' LEFT JOIN means gb ON gb.grp = p.grp AND gb.what = 'pre' LEFT JOIN means cc ON cc.grp = 'BUILDING' AND cc.what = 'change'"""


def _regression(spark, d, baseline):
    s = _s(spark, d)
    return rounded(phase_response.regression_responses(signal.daily_peaks(_r(spark, d)), s, _controls(s, True), baseline=baseline))


@query(RESPONSE.format(f"-({_wrap('post - cp.mean')}) + {_wrap('gb.mean - cb.mean')}", "true"), REGRESSION)
def regression_responses(spark, d):
    return _regression(spark, d, "group")


@query(RESPONSE.format(f"-({_wrap('change - cc.mean')})", "true"), REGRESSION)
def regression_responses_own_baseline(spark, d):
    return _regression(spark, d, "fly")


@query("SELECT grp, count(*) FILTER (p.id IS NULL) AS n_dropped, count(*) AS n_total FROM subjects s LEFT JOIN (SELECT id FROM moved) p USING (id) GROUP BY grp", REGRESSION)
def responses_dropped(spark, d):
    return phase_response.dropped(_regression(spark, d, "none"), _s(spark, d))


# Phases of groups and bootstrap limits of their differences


def _phase_sql(weighted: str, by: str) -> str:
    """Centre and weighted median of ``weighted`` (by, h, w) as SQL."""
    return f""", cen AS (
  SELECT {by}, CASE WHEN sqrt(pow(sum(w * sin(h * pi() / 12)) / sum(w), 2) + pow(sum(w * cos(h * pi() / 12)) / sum(w), 2)) > 1e-9 THEN (atan2(sum(w * sin(h * pi() / 12)) / sum(w), sum(w * cos(h * pi() / 12)) / sum(w)) * 12 / pi() + 24) % 24 END AS c FROM {weighted} GROUP BY {by}
), ph AS (
  SELECT {by}, round(c + median({_wrap('h - c')}), 9) AS peak, count(*) AS n FROM {weighted} JOIN cen USING ({by}) JOIN (SELECT unnest(range(1, 13)) AS k) ON k <= w WHERE c IS NOT NULL GROUP BY {by}, c
)"""


@query(f"""SELECT a.grp, 'BUILDING' AS control_grp, a.day::BIGINT AS day, round(a.peak, 6) AS peak_hours, round(b.peak, 6) AS control_peak_hours, round({_wrap('a.peak - b.peak')}, 6) AS phase_difference_hours,
 round(round({_wrap('a.peak - b.peak')} - ({_wrap('a0.peak - b0.peak')}), 9), 6) AS from_baseline_hours, a.n FROM ph a JOIN ph b ON b.grp = 'BUILDING' AND b.day = a.day LEFT JOIN ph a0 ON a0.grp = a.grp AND a0.day = 3 LEFT JOIN ph b0 ON b0.grp = 'BUILDING' AND b0.day = 3 WHERE a.grp <> 'BUILDING'""",
 PEAKS + ", clock AS (SELECT grp, day, round((minute - day * 1440) / 60, 9) AS h, 1 AS w FROM peaks JOIN subjects USING (id))" + _phase_sql("clock", "grp, day"))
def phase_difference_days(spark, d):
    s = _s(spark, d)
    return rounded(phase_response.phase_differences(signal.daily_peaks(_r(spark, d)), s, _controls(s, False), baseline_day=3))


@query(f"""SELECT grp, 'BUILDING' AS control_grp, day::BIGINT AS day, round(stddev_samp(v), 6) AS phase_difference_sd, round(CASE WHEN count(v) >= 2 THEN quantile_cont(v, 0.025) END, 6) AS phase_difference_low, round(CASE WHEN count(v) >= 2 THEN quantile_cont(v, 0.975) END, 6) AS phase_difference_high,
 round(stddev_samp(b), 6) AS from_baseline_sd, round(CASE WHEN count(b) >= 2 THEN quantile_cont(b, 0.025) END, 6) AS from_baseline_low, round(CASE WHEN count(b) >= 2 THEN quantile_cont(b, 0.975) END, 6) AS from_baseline_high, count(v) AS n_ok
 FROM (SELECT x.grp, x.day, v, round(v - v0, 9) AS b FROM diffs x LEFT JOIN (SELECT grp, r, v AS v0 FROM diffs WHERE day = 3) y ON y.grp = x.grp AND y.r = x.r) GROUP BY grp, day""",
 PEAKS + """, drawn AS (
  SELECT grp, day, r, h, """ + " + ".join(f"(u >= {x!r})::INT" for x in POISSON) + """ AS w FROM (
   SELECT grp, day, r, round((minute - day * 1440) / 60, 9) AS h, u FROM peaks JOIN subjects USING (id) JOIN (
    SELECT id, r, ('0x' || substr(md5('0:' || id::VARCHAR || ':' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT id FROM peaks) CROSS JOIN range(200) q(r)) USING (id))
)""" + _phase_sql("(SELECT * FROM drawn WHERE w > 0)", "grp, day, r") + f""", diffs AS (
  SELECT a.grp, a.day, a.r, {_wrap('a.peak - b.peak')} AS v FROM ph a JOIN ph b ON b.grp = 'BUILDING' AND b.day = a.day AND b.r = a.r WHERE a.grp <> 'BUILDING')""")
def bootstrap_differences(spark, d):
    s = _s(spark, d)
    return rounded(phase_response.bootstrap_differences(signal.daily_peaks(_r(spark, d)), s, _controls(s, False), baseline_day=3))


# Curves, shares and sheets


@query("""SELECT grp, x AS zt_bin_minute, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, n FROM (SELECT grp, zt_bin_minute::BIGINT AS x, avg(value) AS mean, count(value) AS n FROM zt JOIN subjects USING (id) WHERE value IS NOT NULL GROUP BY ALL) JOIN (
 SELECT grp, x, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT grp, x, r, sum(w * v) / sum(w) AS m FROM (SELECT grp, x, r, v, """ + " + ".join(f"(u >= {x!r})::INT" for x in POISSON) + """ AS w FROM (
  SELECT grp, zt_bin_minute::BIGINT AS x, value AS v, r, ('0x' || substr(md5('0:' || id::VARCHAR || ':' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM zt JOIN subjects USING (id) CROSS JOIN range(200) q(r) WHERE value IS NOT NULL)) GROUP BY ALL HAVING sum(w) > 0) GROUP BY grp, x) USING (grp, x)""")
def profile_bands(spark, d):
    return rounded(curves.bands(_zt(spark, d), _s(spark, d), "zt_bin_minute", "value"))


@query("""SELECT 'chi-square' AS test, round(sum(pow(k - n * p, 2) / (n * p * (1 - p))), 6) AS statistic, count(*) - 1.0::DOUBLE AS df FROM (SELECT *, sum(k) OVER () / sum(n) OVER () AS p FROM (
 SELECT grp, count(*)::DOUBLE AS n, count(*) FILTER (active)::DOUBLE AS k FROM (SELECT id, grp, count(*) FILTER (activity > 0) * 16 > count(*) AS active FROM readings JOIN subjects USING (id) GROUP BY ALL) GROUP BY grp HAVING count(*) >= 3)) HAVING min(least(n * p, n * (1 - p))) >= 5""")
def share_tests(spark, d):
    active = F.count(F.when(F.col("activity") > 0, 1)) * 16 > F.count(F.lit(1))
    calls = _r(spark, d).groupBy("id").agg(active.alias("rhythmic")).join(_s(spark, d), "id")
    return rounded(stats.compare_shares(calls).where("test = 'chi-square'").select("test", "statistic", "df"))


@query("""SELECT id, (epoch(first_dd - start_at) / 60)::BIGINT AS split_minute, CASE WHEN pulsed THEN (epoch(pulse - start_at) / 60)::DOUBLE END AS pulse_minute, CASE WHEN pulsed THEN (10 + id % 50)::DOUBLE ELSE 0 END AS pulse_duration_min FROM (
 SELECT c_custkey AS id, c_custkey % 3 = 0 AS pulsed, TIMESTAMP '2024-01-01 09:00:00' AS start_at, TIMESTAMP '2024-01-01 09:00:00' + to_days((3 + c_custkey % 4)::INT) AS first_dd, TIMESTAMP '2024-01-01 09:00:00' + to_days((2 + c_custkey % 4)::INT) + to_minutes((c_custkey % 1440)::BIGINT) AS pulse FROM customer)""", "")
def pulse_minutes(spark, d):
    rows = _s(spark, d).select("id")
    start = F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), start)
    pulse = F.timestamp_add("MINUTE", (F.col("id") % 1440).cast("int"), day(2 + F.col("id") % 4))
    has = F.col("id") % 3 == 0
    sheet = rows.select("id", start.alias("start_ts"), day(3 + F.col("id") % 4).alias("first_dd_ts"), F.when(has, F.date_format(pulse, "yyyy-MM-dd HH:mm")).otherwise(" ").alias("pulse_datetime"), F.when(has, (10 + F.col("id") % 50).cast("string")).alias("pulse_duration"))
    found = monitor.split_minutes(monitor.pulse_columns(sheet, "id"))
    return rounded(found.select("id", "split_minute", "pulse_minute", "pulse_duration_min"))
