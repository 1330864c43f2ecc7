"""Scalar expressions. All are columns; none leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MINUTES_PER_DAY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zt_minute(t) -> Column:
    return F.pmod(_c(t), F.lit(MINUTES_PER_DAY))


def zt_bin(t, bin_minutes: int) -> Column:
    """Start of the bin of the day that a minute falls in."""
    return (F.floor(zt_minute(t) / bin_minutes) * bin_minutes).cast("int")


def closing_edge_hours(bin_start, bin_minutes: int) -> Column:
    """Display label of a bin: its closing edge. Day and night go by the bin's start."""
    return (_c(bin_start) + F.lit(float(bin_minutes))) / 60.0


def day_index(t) -> Column:
    return F.floor(_c(t) / MINUTES_PER_DAY).cast("int")


def day_phase(day, split_minute) -> Column:
    """LD, DD, mixed (the boundary falls inside the day) or all (no boundary)."""
    start, split = _c(day) * MINUTES_PER_DAY, _c(split_minute)
    return F.when(split.isNull(), "all").when(start + MINUTES_PER_DAY <= split, "LD").when(start >= split, "DD").otherwise("mixed")


def wrap_hours(h) -> Column:
    """Hours on the clock face as a difference in [-12, 12)."""
    return F.pmod(_c(h) + 12.0, F.lit(24.0)) - 12.0


def circular_centre(sine, cosine) -> Column:
    """Hours on the clock face from mean sine and cosine; null where the directions cancel out."""
    return F.when(F.hypot(_c(sine), _c(cosine)) > 1e-9, F.pmod(F.atan2(_c(sine), _c(cosine)) * 12 / math.pi, F.lit(24.0)))


def parse_zt_hour(cell) -> Column:
    """"ZT15", "zt 15", "15" and 15 are 15.0; blank and unreadable cells are null (see ``unreadable_zt``)."""
    text = F.upper(F.trim(_c(cell).cast("string")))
    return F.when(text != "", F.regexp_replace(text, "^ZT\\s*", "").try_cast("double"))


def unreadable_zt(cell) -> Column:
    return (F.trim(_c(cell).cast("string")) != "") & parse_zt_hour(cell).isNull()


def pulse_datetime(cell) -> Column:
    """A timestamp from text; ZT texts, plain numbers and blanks are null."""
    text = F.trim(_c(cell).cast("string"))
    plain = F.upper(text).startswith("ZT") | text.try_cast("double").isNotNull()
    return F.when(~plain & (text != ""), text.try_cast("timestamp_ntz"))


def group_label(*columns, sep: str = "-") -> Column:
    """Values as text, joined; blanks and nulls are "nan"."""
    return F.concat_ws(sep, *[F.coalesce(F.nullif(_c(c).cast("string"), F.lit("")), F.lit("nan")) for c in columns])


def in_zt_window(bin_start, start_h: float, end_h: float) -> Column:
    """Bin starts in [start, end) hours; past midnight where end is smaller, the whole day where equal."""
    h = _c(bin_start) / 60.0
    if start_h == end_h:
        return F.lit(True)
    return (h >= start_h) & (h < end_h) if start_h < end_h else (h >= start_h) | (h < end_h)


def pulse_label(zt) -> Column:
    z = _c(zt)
    text = F.regexp_replace(F.format_string("%.6f", z), "\\.?0+$", "")
    return F.when(z.isNull(), "no pulse").otherwise(F.concat(F.lit("ZT"), text))


def stars(p) -> Column:
    q = _c(p)
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").when(q.isNotNull(), "ns")


def format_p(p) -> Column:
    q = _c(p)
    return F.when(q < 0.001, "p < 0.001").when(q.isNotNull(), F.format_string("p = %.3f", q))


def angular_deviation_deg(r) -> Column:
    return F.degrees(F.sqrt(2 * (1 - F.least(F.lit(1.0), _c(r)))))


def sem(x, none=None) -> Column:
    """Standard error; ``none`` where there is one value or none."""
    c = _c(x)
    n = F.count(c)
    return F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).otherwise(F.lit(none).cast("double"))


def number_ranges(numbers) -> Column:
    """A sorted array of distinct whole numbers as text: [1, 2, 3, 5] is "1-3, 5"."""
    xs = F.array_sort(F.array_distinct(_c(numbers)))
    starts = F.filter(xs, lambda x: ~F.array_contains(xs, x - 1))
    ends = F.filter(xs, lambda x: ~F.array_contains(xs, x + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ", ")


def natural_key(text) -> Column:
    """Sorts numbers inside text by value: digits are padded to twelve places."""
    parts = F.regexp_extract_all(F.lower(_c(text)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 12, "0")).otherwise(x)), "")


def level_value(text) -> Column:
    """The number of a level such as "ZT14", "CT3", "5 min" or "2.5"; null for other texts."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(_c(text))), "^(?:ZT|CT)?\\s*(-?[0-9]+(?:\\.[0-9]+)?)\\s*(?:[A-Z%µ]*)$", 1), F.lit("")).try_cast("double")


def safe_name(name) -> Column:
    """A name fit for files: letters, digits, dot, dash and underscore; runs of others become one underscore."""
    return F.trim(F.regexp_replace(F.trim(_c(name)), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


#: Documented read failures of a monitor.
STATUS_LABELS = {1: "valid data", 24: "cable or link error", 50: "no response", 51: "no data received"}


def status_label(code) -> Column:
    out = F.lit("undocumented status")
    for k, label in STATUS_LABELS.items():
        out = F.when(_c(code) == k, label).otherwise(out)
    return out
