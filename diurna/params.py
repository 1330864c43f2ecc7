"""Calibrated defaults in one place, and frozen settings for each step.

A step's settings travel with its results as rows (step, key, value), so that a table says how it was made.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MINUTES_PER_DAY = 1440
#: Rhythm cutoffs.
LS_POWER, AC_STRENGTH, FAP = 0.006, 0.3, 0.05
CWT_CUTOFF = {"ar1": 1.0, "global": 1.7, "global_rednoise": 2.0, "ridge": 0.30}
PERIOD_RANGE = (16.0, 36.0)
CLASSIFY_WINDOW = (16.0, 32.0)
MIN_DD_DAYS = 4.0
GAP_MINUTES, BRIDGE_MINUTES = 60, 60
#: Phase markers.
LOWPASS_HOURS, PROMINENCE, DISTANCE_HOURS, HALF_WIDTH_HOURS = 12.0, 0.05, 12.0, 4.0
ONSET_LEVEL, ONSET_SMOOTH_MINUTES, MIN_PRE_DAYS, MIN_POST_DAYS, SKIP_DAYS = 0.75, 180, 3, 3, 0
MESA_BIN_MINUTES, MESA_ORDER_CAP, CURVE_POINTS = 30, 150, 600
CWT_VOICES = 32
GROUP_ALPHA, GROUP_MIN_N = 0.05, 3


class Settings:
    """A frozen step configuration that checks its own keys and goes to rows and back."""

    @classmethod
    def of(cls, values: dict) -> "Settings":
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"{cls.__name__}: unknown settings {unknown}; known are {sorted(known)}")
        return cls(**values)

    def rows(self) -> list[tuple[str, str, str]]:
        return [(type(self).__name__, k, json.dumps(v)) for k, v in dataclasses.asdict(self).items()]

    @classmethod
    def from_rows(cls, rows: list[tuple[str, str, str]]) -> "Settings":
        return cls.of({k: json.loads(v) for step, k, v in rows if step == cls.__name__})


@dataclass(frozen=True)
class Curation(Settings):
    min_alive_days: float = 2.0
    rolling_window_hours: float = 24.0
    immobility_proportion: float = 0.01


@dataclass(frozen=True)
class Split(Settings):
    discard_first_dd_day: bool = False
    gap_threshold_minutes: int = GAP_MINUTES


@dataclass(frozen=True)
class Sleep(Settings):
    threshold_seconds: int = 300
    short_max_minutes: int = 30
    intermediate_max_minutes: int = 60
    bridge_minutes: int = 4
    phase: str = "auto"

    def __post_init__(self) -> None:
        if not 60 <= self.threshold_seconds <= 1800:
            raise ValueError("threshold_seconds must be 60 to 1800")
        if not self.threshold_seconds / 60 <= self.short_max_minutes < self.intermediate_max_minutes:
            raise ValueError("sleep state bounds must rise from the threshold")


@dataclass(frozen=True)
class Preprocess(Settings):
    bin_minutes: int = 1
    smooth_sigma_minutes: float = 0.0
    lowpass_hours: float = 0.0
    detrend: str = "none"
    normalize: str = "none"
    rolling_window_hours: float = 24.0


@dataclass(frozen=True)
class Period(Settings):
    methods: tuple[str, ...] = ("ac", "ls", "mesa", "cwt")
    phase: str = "DD"
    min_period: float = PERIOD_RANGE[0]
    max_period: float = PERIOD_RANGE[1]
    min_days: float = MIN_DD_DAYS
    max_bridge_minutes: int = BRIDGE_MINUTES
    step_minutes: int = 1
    oversampling: int = 8
    ac_peak: int = 2
    mesa_bin_minutes: int = MESA_BIN_MINUTES
    mesa_order: int | None = None
    voices: int = CWT_VOICES
    cwt_method: str = "global_rednoise"


@dataclass(frozen=True)
class Hmm(Settings):
    emission: str = "zip"
    n_states: int = 4
    scope: str = "group"
    constraint: str = "soft"
    decoding: str = "viterbi"
    n_restarts: int = 50
    n_iter: int = 200
    tol: float = 1e-4
    soft_floor: float = 1e-3
    concentration: float = 10.0
    samples_per_day: int = MINUTES_PER_DAY
    phase: str = "auto"

    @classmethod
    def wiggin(cls) -> "Hmm":
        return cls(emission="categorical", constraint="hard", decoding="posterior")

    @classmethod
    def harbison(cls) -> "Hmm":
        return cls(emission="gaussian", constraint="none", scope="subject_day")

    @classmethod
    def improved(cls) -> "Hmm":
        return cls()


def settings_table(spark: SparkSession, *steps: Settings) -> DataFrame:
    return spark.createDataFrame([r for s in steps for r in s.rows()], "step string, key string, value string")
