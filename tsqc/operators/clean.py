"""Sentinel codes and duplicate times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES
from tsqc.sources.readers import first_per_time

SENTINELS = (-9.0, -99.0, -999.0, -9999.0)


def sentinels_used(df: DataFrame, values=SENTINELS, min_count: int = 5, min_frac: float = 0.001) -> DataFrame:
    """Per series: used, the sorted codes that are there min_count times, or in a share of min_frac of all rows."""
    counts = [F.count_if(F.col("value") == v).alias(f"c{i}") for i, v in enumerate(values)]
    agg = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), *counts)
    able = [F.when((F.col(f"c{i}") >= min_count) | (F.col(f"c{i}") / F.col("n") >= min_frac), F.lit(int(v))) for i, v in enumerate(values)]
    return agg.select(*SERIES, F.array_sort(F.array_compact(F.array(*able))).alias("used"))


def mask_sentinels(df: DataFrame, values=SENTINELS, min_count: int = 5, min_frac: float = 0.001) -> DataFrame:
    """value without used codes, and is_sentinel. One aggregation by series; the codes come back by a join on the series."""
    used = sentinels_used(df, values, min_count, min_frac)
    hit = F.coalesce(F.array_contains(F.transform("used", lambda x: x.cast("double")), F.col("value")), F.lit(False))
    return df.join(used, SERIES).withColumn("is_sentinel", hit).withColumn("value", F.when(~hit, F.col("value"))).drop("used")


def resolve_duplicates(df: DataFrame, how: str = "median") -> DataFrame:
    """One row per time. how: median, mean, first (in file order) or none; n_dup counts rows that share their time."""
    keys = [*SERIES, "ts"]
    if how == "none":
        return df.withColumn("n_dup", F.lit(0).cast("long"))
    if how == "first":
        return first_per_time(df, keys)
    value = F.avg("value") if how == "mean" else F.expr("percentile(value, 0.5)")
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(value.alias("value"), F.when(n > 1, n).otherwise(F.lit(0)).alias("n_dup"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Per series: duplicates, all rows that share their time with another."""
    n = df.groupBy(*SERIES, "ts").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*SERIES).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicates"))
