"""Light-dark and constant-dark phases. A view keeps all rows and nulls what is out of phase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs, state
from .state import PhaseError

#: What an analysis uses where the phase is "auto", and what it may be given. Periods are read in one
#: phase, for entrained and free runs differ; sleep and its hidden states are those of the entrained day.
POLICY = {
    "period": ("DD", ("LD", "DD")),
    "ultradian": ("DD", ("LD", "DD")),
    "sleep": ("LD", ("LD", "DD", "both")),
    "hmm": ("LD", ("LD", "DD", "both")),
    "deprivation": ("LD", ("LD",)),
    "experiment_days": ("LD", ("LD", "DD", "both")),
    "actogram": ("both", ("LD", "DD", "both")),
}
ONE = {"ld": "LD", "dd": "DD", "both": "both", "auto": "auto"}


def resolve_phase(phase: str, analysis: str, has_boundary: bool = True) -> str:
    """"auto" is the analysis's own phase, and the whole record where there is no boundary. Case does not matter.

    An analysis that is not named here raises: what it may be given has to be stated first.
    """
    if analysis not in POLICY:
        raise PhaseError(f"no phases are stated for {analysis}; known are {', '.join(sorted(POLICY))}")
    default, allowed = POLICY[analysis]
    phase = ONE.get(str(phase).strip().lower(), phase)
    if phase == "auto":
        return default if has_boundary else "both"
    if phase not in allowed:
        raise PhaseError(f"{analysis} does not take phase {phase}; it takes {', '.join(allowed)}")
    return phase


def select_phase(readings: DataFrame, subjects: DataFrame, phase: str, values: list[str], discard_first_dd_day: bool = False) -> DataFrame:
    """``readings`` with ``values`` null out of phase. Subjects without a boundary keep everything.

    The columns carry their phase from then on, also through files: asked for it again they stay as they are, and
    asked for another phase, or for both, they raise.
    """
    if phase not in ("LD", "DD", "both"):
        raise PhaseError(f"unknown phase {phase}")
    if state.can_give(readings, phase, values) or phase == "both":
        return readings
    joined = readings.join(subjects.select("id", F.col("split_minute").alias("__split")), "id", "left")
    inside = F.col("t") < F.col("__split") if phase == "LD" else F.col("t") >= F.col("__split") + (1440 if discard_first_dd_day else 0)
    inside = F.coalesce(inside, F.lit(True))
    return state.stamp(joined.withColumns({v: F.when(inside, F.col(v)) for v in values}).drop("__split"), values, phase=phase, discard_first_dd_day=bool(discard_first_dd_day and phase == "DD"))


def split_phase(readings: DataFrame, subjects: DataFrame, phase: str, discard_first_dd_day: bool = False) -> DataFrame:
    """Only the rows in phase, minutes from the phase's start. With differing boundaries the cautious one holds
    for all: the earliest for LD, the latest for DD."""
    if phase not in ("LD", "DD"):
        raise PhaseError(f"unknown phase {phase}")
    values = [c for c in readings.columns if c not in ("id", "t")]
    state.can_give(readings, phase, values)
    bounds = subjects.where("split_minute IS NOT NULL").agg(F.min("split_minute").alias("lo"), F.max("split_minute").alias("hi"))
    rows = readings.join(F.broadcast(bounds))
    if phase == "LD":
        out = rows.where("t < lo")
    else:
        start = F.col("hi") + (1440 if discard_first_dd_day else 0)
        out = rows.where(F.col("t") >= start).withColumn("t", F.col("t") - start)
    return state.stamp(out.drop("lo", "hi"), values, phase=phase)


def keep_longest(readings: DataFrame, value: str, threshold: int = 60, step: int = 1) -> DataFrame:
    """``value`` null outside each subject's longest segment; minutes at which nobody has one go."""
    segment = runs.longest_segment(readings, value, threshold=threshold, step=step)
    joined = readings.join(segment.select("id", "seg_start", "seg_end"), "id", "left")
    return joined.withColumn(value, F.when(F.col("t").between(F.col("seg_start"), F.col("seg_end")), F.col(value))).drop("seg_start", "seg_end")


def split_report(readings: DataFrame, subjects: DataFrame, value: str = "activity") -> DataFrame:
    """``phase, subjects, measured, missing`` of both phases."""
    joined = readings.join(subjects.select("id", "split_minute"), "id")
    phase = F.when(F.col("split_minute").isNull(), "all").when(F.col("t") < F.col("split_minute"), "LD").otherwise("DD")
    measured = F.count(value)
    return joined.groupBy(phase.alias("phase")).agg(F.countDistinct("id").alias("subjects"), measured.alias("measured"), (F.count(F.lit(1)) - measured).alias("missing"))


def record_days(readings: DataFrame, value: str = "activity", floor_days: float = 4.0) -> DataFrame:
    """``id, days, enough``: span of the measured record; zero below two readings."""
    seen = F.when(F.col(value).isNotNull(), F.col("t"))
    days = F.when(F.count(value) >= 2, (F.max(seen) - F.min(seen)) / 1440.0).otherwise(0.0)
    return readings.groupBy("id").agg(days.alias("days")).withColumn("enough", F.col("days") >= floor_days)


def onset_days(subjects: DataFrame) -> DataFrame:
    """Distinct release days; more than one means cohorts released apart."""
    return subjects.where("split_minute IS NOT NULL").select(F.round(F.col("split_minute") / 1440.0).cast("int").alias("onset_day")).distinct()


def experiment_days(readings: DataFrame, subjects: DataFrame, phase: str = "LD", step: int = 1) -> DataFrame:
    """``day, start_minute, end_minute`` of the whole days of a phase; the earliest boundary holds for all."""
    if phase not in ("LD", "DD", "both"):
        raise PhaseError(f"unknown phase {phase}")
    length = readings.agg((F.max("t") - F.min("t") + step).cast("bigint").alias("length"))
    split = subjects.agg(F.min("split_minute").cast("bigint").alias("split"))
    bounds = F.broadcast(length).join(F.broadcast(split))
    first = F.coalesce("split", F.lit(0)) if phase == "DD" else F.lit(0)
    last = F.least("split", "length") if phase == "LD" else F.col("length")
    days = bounds.select(first.cast("bigint").alias("first"), F.floor((last - first) / 1440).alias("n")).where("n > 0")
    day = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("day")
    return days.select("first", day).select("day", (F.col("first") + F.col("day") * 1440).alias("start_minute"), (F.col("first") + (F.col("day") + 1) * 1440).alias("end_minute"))


def per_epoch(readings: DataFrame, subjects: DataFrame, values: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The tables that ``make`` gives for either phase, one below the other, with ``phase`` first."""
    tables = [make(select_phase(readings, subjects, phase, values)).select(F.lit(phase).alias("phase"), "*") for phase in ("LD", "DD")]
    return tables[0].unionByName(tables[1])
