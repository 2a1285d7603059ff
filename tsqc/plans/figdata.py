"""The data behind each figure; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, ordered
from tsqc.operators import runs, smooth, stats, time_ops


def series(timeseries: DataFrame) -> DataFrame:
    return timeseries.select(*SERIES, "ts", "raw", "clean", "accepted")


def decimal_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    return stats.decimal_histogram(df, bins).select(*SERIES, F.posexplode("hist").alias("bin", "n"), "chisq", "p")


def differences(df: DataFrame) -> DataFrame:
    return df.select(*SERIES, "ts", F.abs(F.col("value") - F.lag("value").over(ordered())).alias("abs_diff"))


def flat_spans(df: DataFrame, **options) -> DataFrame:
    return runs.flat_values(df, **options).select(*SERIES, "start", "end", F.lit("flat_values").alias("type")).union(runs.flat_slopes(df, **options).select(*SERIES, "start", "end", F.lit("flat_slopes").alias("type")))


def coverage(df: DataFrame) -> DataFrame:
    return stats.season_stats(df).select(*SERIES, "season", "season_rank", "coverage_pct")


def gaussian(df: DataFrame, sigma: int) -> DataFrame:
    return smooth.gaussian_trend(df, sigma).select(*SERIES, "ts", "value", "trend", "residual")


def residuals(fitted: DataFrame) -> DataFrame:
    return fitted.select(*SERIES, "ts", "value", "yhat", "residual", "spike")


def band_lines(bands: DataFrame) -> DataFrame:
    """Bands and values, broken at gaps."""
    lines = time_ops.break_on_gaps(bands.withColumn("value", F.col("raw") if "raw" in bands.columns else F.col("obs")))
    return lines.select(*SERIES, "ts", "value", "qcband_top", "qcband_bottom", "masked", "is_flagged")
