"""Projections and filters on series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import is_finite

N_PER_NO3 = 14.0 / 62.0  # mass of nitrogen in nitrate


def station_equals(df: DataFrame, station: str | None, field: str | None = "station") -> DataFrame:
    """All rows where there is no such field, or no station is asked for."""
    return df if station is None or field not in df.columns else df.filter(F.col(f"`{field}`") == station)


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both ends included; applied only if both are given."""
    if start is None or end is None:
        return df
    return df.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def by_variable(values: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, v in values.items():
        out = F.when(F.col("variable") == name, F.lit(float(v))).otherwise(out)
    return out


def calibrate(df: DataFrame, offsets: dict[str, float]) -> DataFrame:
    return df.withColumn("value", F.col("value") + by_variable(offsets, 0.0))


def to_nitrogen(c: Column) -> Column:
    return c * F.lit(14.0) / F.lit(62.0)


def to_nitrate(c: Column) -> Column:
    return c * F.lit(62.0) / F.lit(14.0)


def positive_only(c: Column) -> Column:
    return F.when(is_finite(c) & (c > 0), c)
