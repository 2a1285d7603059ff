"""Places in a series, and windows over blocks of rows, for series too long for one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES

BLOCK_ROWS = 200_000


def with_pos(df: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """pos: 0, 1, ... by time in each series; the columns `ties` order rows of one time."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*SERIES).orderBy("ts", *ties)).cast("long") - 1)


def with_pos_by_day(df: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """The same without a whole series in one task: counts by day, their running sum, and ranks within days. Rows without a time
    come first; the columns `ties` order rows of one time."""
    df = df.withColumn("day__", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    days = df.groupBy(*SERIES, "day__").agg(F.count(F.lit(1)).alias("n__"))
    before = days.withColumn("before__", F.coalesce(F.sum("n__").over(Window.partitionBy(*SERIES).orderBy("day__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    both = df.join(before, [*SERIES, "day__"])
    rank = F.row_number().over(Window.partitionBy(*SERIES, "day__").orderBy("ts", *ties)).cast("long") - 1
    return both.withColumn("pos", F.col("before__") + rank).drop("day__", "before__")


def over_blocks(df: DataFrame, before: int, after: int, make: Callable[[DataFrame, list[str]], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """make(df, keys) over blocks of rows instead of whole series.

    make adds columns by windows partitioned by keys and ordered by ts whose frames reach at most `before` rows back and `after`
    rows on. Each block carries so many rows of its neighbours, which are dropped afterwards. df has the column pos.
    """
    at = F.floor(F.col("pos") / rows)
    low, high = F.floor((F.col("pos") - after) / rows), F.floor((F.col("pos") + before) / rows)
    spread = df.withColumn("home__", at).withColumn("block__", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    return make(spread, [*SERIES, "block__"]).filter("home__ = block__").drop("home__", "block__")
