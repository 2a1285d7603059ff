"""Gaussian trend."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import HOUR, SERIES, ordered
from tsqc.operators.time_ops import infer_step
from tsqc.operators.windows import by_points


def sigma_points(step_us: int, sigma_hours: float = 6.0, unit: str = "compat") -> int:
    """Deviation in rows. compat counts a step under an hour as one hour."""
    step_hours = step_us / HOUR
    return max(1, round(sigma_hours / (max(1, round(step_hours)) if unit == "compat" else step_hours)))


def kernel(sigma: int, cut: float = 4.0) -> list[float]:
    reach = int(cut * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [x / sum(w) for x in w]


def filled(df: DataFrame, column: str = "value") -> DataFrame:
    """Missing values take the last one before, or else (only those before the series' first value) the first one after."""
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("filled", F.coalesce(F.last(column, True).over(upto), F.first(column, True).over(whole)))


def gaussian_trend(df: DataFrame, sigma: int) -> DataFrame:
    """trend, and residual of the value against it; past the ends the first and the last value go on."""
    w = kernel(sigma)
    reach = len(w) // 2
    df = filled(df)
    o = ordered()
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"first__": F.first("filled").over(whole), "last__": F.last("filled").over(whole)})
    terms = [F.coalesce(F.lag("filled", reach - i).over(o), "first__") if i < reach else F.coalesce(F.lead("filled", i - reach).over(o), "last__") for i in range(len(w))]
    df = df.withColumns({f"t{i}__": x for i, x in enumerate(terms)})
    trend = sum((F.col(f"t{i}__") * x for i, x in enumerate(w)), F.lit(0.0))
    df = df.withColumn("trend", F.when(F.col("first__").isNotNull(), trend)).drop("filled", "first__", "last__", *(f"t{i}__" for i in range(len(w))))
    return df.withColumn("residual", F.col("value") - F.col("trend"))


def gaussian_trend_hours(df: DataFrame, hours: float = 6.0) -> DataFrame:
    """The same with a deviation in hours, by each series' step."""
    steps = infer_step(df)
    sizes = steps.select(*SERIES, F.greatest(F.lit(1), F.round(F.lit(hours) / F.greatest(F.lit(1), F.round(F.col("step_us") / HOUR)))).cast("int").alias("sigma__"))
    return by_points(df.join(sizes, SERIES), "sigma__", gaussian_trend).drop("sigma__")
