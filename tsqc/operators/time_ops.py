"""Steps, gaps, resampling, elapsed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import HOUR, SERIES, micros, ordered, yes

DEFAULT_STEP = 15 * 60 * 1_000_000


def infer_step(df: DataFrame) -> DataFrame:
    """Per series: step_us, the median of positive steps cut to a whole number; the default below three rows or without one."""
    d = micros(F.lag("ts").over(ordered()), F.col("ts"))
    steps = df.select(*SERIES, d.alias("d"))
    found = F.expr("CAST(percentile(CASE WHEN d > 0 THEN d END, 0.5) AS bigint)")
    return steps.groupBy(*SERIES).agg(F.when(F.count(F.lit(1)) >= 3, F.coalesce(found, F.lit(DEFAULT_STEP))).otherwise(F.lit(DEFAULT_STEP)).alias("step_us"))


def with_gaps(df: DataFrame, gap_hours: float = 2.0) -> DataFrame:
    """is_gap: the row comes more than gap_hours after the one before it."""
    d = micros(F.lag("ts").over(ordered()), F.col("ts"))
    return df.withColumn("is_gap", yes(d > F.lit(int(gap_hours * HOUR))))


def null_after_gaps(df: DataFrame, gap_hours: float = 2.0, column: str = "value") -> DataFrame:
    """The row after a gap, and only that, loses its value."""
    return with_gaps(df, gap_hours).withColumn(column, F.when(~F.col("is_gap"), F.col(column)))


def resample_median(df: DataFrame, freq: str) -> DataFrame:
    """Medians by bins of freq (such as '1 hour'); bins without rows between the first and the last are there with NULL."""
    bins = df.groupBy(*SERIES, F.window("ts", freq).alias("w")).agg(F.expr("percentile(value, 0.5)").alias("value")).select(*SERIES, F.col("w.start").cast("timestamp_ntz").alias("ts"), "value")
    ends = bins.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select(*SERIES, F.explode(F.expr(f"sequence(a, b, INTERVAL {freq})")).alias("ts"))
    return grid.join(bins, [*SERIES, "ts"], "left")


def elapsed_days(df: DataFrame) -> DataFrame:
    start = F.min("ts").over(Window.partitionBy(*SERIES))
    return df.withColumn("days", micros(start, F.col("ts")) / F.lit(86_400_000_000.0))


def break_on_gaps(df: DataFrame, column: str = "value", factor: int = 10) -> DataFrame:
    """For drawing: no value where the step from the row before is over factor usual steps."""
    d = micros(F.lag("ts").over(ordered()), F.col("ts"))
    return df.join(infer_step(df), SERIES).withColumn(column, F.when(yes(d > F.col("step_us") * factor), F.lit(None)).otherwise(F.col(column))).drop("step_us")


def years(df: DataFrame) -> DataFrame:
    """Per series: the years of its first and its last row."""
    return df.groupBy(*SERIES).agg(F.year(F.min("ts")).alias("first_year"), F.year(F.max("ts")).alias("last_year"))
