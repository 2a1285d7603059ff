"""Range and missing flags of a streaming (or static) long table; windows over rows stay with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.operators.checks import check_missing, check_range
from tsqc.operators.stats import any_of


def row_flags(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    out = check_missing(check_range(df, ranges))
    return out.withColumn("flagged", any_of(F.col("range"), F.col("missing")))
