"""Reading observation tables, wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, missing_as_null, sanitize
from tsqc.operators.project import station_equals


def read_csv(
    spark: SparkSession, path: str, timestamp_col: str = "timestamp", station_field: str | None = None, station_value: str | None = None,
    usecols: list[str] | None = None, dedupe: str = "first",
) -> DataFrame:
    """A wide table of strings and a ts column (TIMESTAMP_NTZ).

    Rows whose timestamp can't be parsed are left out. The station filter comes before de-duplication, so stations don't take
    rows from one another. dedupe: first (in file order) or none.
    """
    df = spark.read.csv(path, header=True)
    if usecols:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in {*usecols, timestamp_col, station_field}])
    df = station_equals(df, station_value, station_field)
    text = F.col(f"`{timestamp_col}`").cast("string")
    # The wall clock counts: a fixed offset at the end is the station's own zone.
    ts = F.expr(f"try_cast(regexp_replace(`{timestamp_col}`, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', '') AS timestamp_ntz)")
    df = df.withColumn("ts", ts).filter(text.isNotNull() & F.col("ts").isNotNull())
    return first_per_time(df, ["ts"]) if dedupe == "first" else df


def first_per_time(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The first row of each key, in file order unless a column gives another."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    w = Window.partitionBy(*keys).orderBy("place__")
    return df.withColumn("place__", place).withColumn("rank__", F.row_number().over(w)).filter("rank__ = 1").drop("place__", "rank__")


def to_long(df: DataFrame, columns: list[str], ts: str = "ts", station: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(station, variable, ts, value) of those columns that are there, by their sanitized names, and the columns `keep`; NaN and text that is no number become
    NULL."""
    found = [c for c in columns if c in df.columns]
    names = [sanitize(c) for c in found]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash once sanitized: {sorted(names)}")
    if not found:
        return df.sparkSession.createDataFrame([], "station string, variable string, ts timestamp_ntz, value double")
    values = F.array(*[F.struct(F.lit(name).alias("variable"), F.expr(f"try_cast(`{c}` AS double)").alias("value")) for c, name in zip(found, names)])
    who = F.col(f"`{station}`").cast("string") if station in df.columns else F.lit(station or "")
    long = df.select(who.alias("station"), F.col(ts).cast("timestamp_ntz").alias("ts"), *keep, F.inline(values))
    return long.select(*SERIES, "ts", missing_as_null(F.col("value")).alias("value"), *keep)


def long_from(df: DataFrame, variable: str, ts: str, value: str, station: str = "S1") -> DataFrame:
    """A table that is long already."""
    return df.select(F.lit(station).alias("station"), F.col(variable).cast("string").alias("variable"), F.col(ts).cast("timestamp_ntz").alias("ts"), missing_as_null(F.col(value)).alias("value"))
