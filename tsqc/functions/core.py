"""Column functions used by all operators. Missing is NULL throughout: NaN is turned into NULL on reading."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SERIES = ["station", "variable"]
SEASONS = ("DJF", "MAM", "JJA", "SON")
HOUR = 3_600_000_000  # microseconds


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def missing_as_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def yes(c: Column) -> Column:
    """A mask: NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def micros(start: Column, end: Column) -> Column:
    """Microseconds from start to end; works for timestamps without a zone."""
    return F.timestamp_diff("MICROSECOND", start, end)


def hours(start: Column, end: Column) -> Column:
    return micros(start, end) / F.lit(float(HOUR))


def season(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(SEASONS[m % 12 // 3]) for m in range(1, 13)]), F.month(ts))


def season_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEASONS)), name)


def year_phase(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.lit(2.0) * F.pi() * F.dayofyear(ts) / F.lit(365.25)
    return F.sin(angle), F.cos(angle)


#: Rows of one time stand in the order of their values, so that each reading of a series places them alike.
BY_TIME = ["ts", "value"]


def ordered(keys: Sequence[str] = SERIES, by: str | list[str] = "ts") -> Window:
    """Rows of a series by time; or those of a block of it, by their places."""
    return Window.partitionBy(*keys).orderBy(by)


def centred(k: int) -> tuple[int, int]:
    """Row frame of a centred window of k points."""
    return -(k // 2), (k - 1) // 2


def points(window_hours: float, step_us: Column) -> Column:
    """Points of a time window at a step: rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(window_hours * HOUR)) / step_us, 0).cast("int"))


def sanitize(name: str) -> str:
    """A name for files and columns: each run of other characters than letters, digits, dot, underscore and hyphen becomes one underscore."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", str(name)).strip("_")


def sanitized(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
