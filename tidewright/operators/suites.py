"""Quality suites of the data providers: which tests a wave-height series gets, with their thresholds.

A suite is a value; its tests run on all series of a table at once. Instruments get tests for stuck and
drifting sensors, model output only those that show a broken file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from . import qc


@dataclass(frozen=True)
class Suite:
    """Thresholds in metres and seconds; ``None`` leaves a test out."""

    expected_s: float = 3600.0
    fail: tuple[float, float] = (0.0, 25.0)
    suspect: tuple[float, float] = (0.05, 15.0)
    max_change: float = 2.0
    flat_tolerance: float | None = None
    flat_counts: tuple[int, int] = (3, 5)
    mean_window: str | None = None
    mean_deviations: float = 3.0
    mean_periods: int = 6
    provider_flags: bool = False
    steep: tuple[float, float] = (0.07, 0.142)


INSTRUMENT = Suite(flat_tolerance=1e-6, mean_window="24h")
SUITES = {
    "ndbc": INSTRUMENT,
    "cdip": replace(INSTRUMENT, expected_s=1800.0, provider_flags=True),
    "era5": Suite(),
    "wis": Suite(),
}


def run(
    df: DataFrame, suite: Suite, *, by: Sequence[str], time: str, height: str, period: str, tie: str, source_flag: str | None = None
) -> tuple[DataFrame, list[str]]:
    """The rows with one flag column for each test and ``qc_flag``, and the names of the tests.

    Rows without a height are flagged as missing, none is removed.
    """
    out = qc.gap_and_rate(df, by=by, time=time, value=height, tie=tie, expected_s=suite.expected_s, max_change=suite.max_change)
    tests = ["gap_flag", "rate_flag"]
    if suite.flat_tolerance is not None:
        low, high = suite.flat_counts
        out = qc.flat_line(out, by=by, time=time, value=height, tie=tie, suspect_count=low, fail_count=high, tolerance=suite.flat_tolerance)
        tests.append("flat_flag")
    if suite.mean_window is not None:
        out = qc.mean_std(
            out, by=by, time=time, value=height, window=suite.mean_window, n_std=suite.mean_deviations, min_periods=suite.mean_periods
        )
        tests.append("mean_std_flag")
    rowwise = {"range_flag": qc.gross_range(height, suite.fail, suite.suspect), "steepness_flag": qc.steepness(height, period, *suite.steep)}
    if suite.provider_flags:
        if source_flag is None:
            raise ValueError("this suite reads the provider's own flag; name its column")
        rowwise["provider_flag"] = qc.provider_flag(source_flag)
    tests += rowwise
    out = out.withColumns(rowwise)
    return out.withColumn("qc_flag", qc.combine(*tests)), tests
