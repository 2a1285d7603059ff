"""Rolling statistics over centred row windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, centred, ordered

#: Means and deviations of longer windows come from running sums, whose cost doesn't grow with the window.
DIRECT = 100
TRIANGLE = (1.0, 2.0, 3.0, 2.0, 1.0)


def min_count(k: int, share: float = 0.3) -> int:
    return max(3, math.ceil(share * k))


def rolling(df: DataFrame, k: int, name: str, median: bool = False, column: str = "value", need: int | None = None, keys: Sequence[str] = SERIES, by: str = "ts") -> DataFrame:
    """Adds <name>_ma (mean, or median) and <name>_sd (population deviation), NULL below `need` values."""
    need = min_count(k) if need is None else need
    lo, hi = centred(k)
    o = ordered(keys, by)
    w = o.rowsBetween(lo, hi)
    x = F.col(column)
    enough = F.count(x).over(w) >= need
    if k <= DIRECT:
        mean = F.expr(f"percentile({column}, 0.5)").over(w) if median else F.avg(x).over(w)
        return df.withColumns({f"{name}_ma": F.when(enough, mean), f"{name}_sd": F.when(enough, F.stddev_pop(x).over(w))})
    # Running sums of values less the mean of all, so that little cancels; a window is a difference of two of them.
    total = Window.partitionBy(*keys)
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("c__", F.avg(x).over(total)).withColumn("x__", x - F.col("c__"))
    df = df.withColumns({"s1__": F.coalesce(F.sum("x__").over(upto), F.lit(0.0)), "s2__": F.coalesce(F.sum(F.col("x__") * F.col("x__")).over(upto), F.lit(0.0)), "n__": F.count("x__").over(upto)})

    def between(c: str) -> Column:
        end = F.coalesce(F.lead(c, hi).over(o), F.last(c).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        return end - F.coalesce(F.lag(c, -lo + 1).over(o), F.lit(0))

    df = df.withColumns({"w1__": between("s1__"), "w2__": between("s2__"), "wn__": between("n__")})
    n = F.nullif(F.col("wn__"), F.lit(0))
    m = F.col("w1__") / n
    var = F.greatest(F.col("w2__") / n - m * m, F.lit(0.0))
    enough = F.col("wn__") >= need
    mean = F.expr(f"percentile({column}, 0.5)").over(w) if median else F.col("c__") + m
    out = df.withColumns({f"{name}_ma": F.when(enough, mean), f"{name}_sd": F.when(enough, F.sqrt(var))})
    return out.drop("c__", "x__", "s1__", "s2__", "n__", "w1__", "w2__", "wn__")


def triangular(df: DataFrame, name: str, column: str = "value", need: int = 3, keys: Sequence[str] = SERIES, by: str = "ts") -> DataFrame:
    """The same with weights 1, 2, 3, 2, 1 over five rows; missing rows and those past the ends have no weight."""
    o = ordered(keys, by)
    xs = [F.lag(column, 2).over(o), F.lag(column, 1).over(o), F.col(column), F.lead(column, 1).over(o), F.lead(column, 2).over(o)]
    df = df.withColumn("t__", F.array(*xs))
    x = [F.get("t__", F.lit(i)) for i in range(5)]
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in zip(x, TRIANGLE)), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in x), F.lit(0))
    df = df.withColumn("m__", F.when(count >= need, sum((F.coalesce(c * w, F.lit(0.0)) for c, w in zip(x, TRIANGLE)), F.lit(0.0)) / weight))
    var = sum((F.coalesce((c - F.col("m__")) * (c - F.col("m__")) * w, F.lit(0.0)) for c, w in zip(x, TRIANGLE)), F.lit(0.0)) / weight
    return df.withColumns({f"{name}_ma": F.col("m__"), f"{name}_sd": F.when(F.col("m__").isNotNull(), F.sqrt(var))}).drop("t__", "m__")


def by_points(df: DataFrame, k: str, make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """make(rows, points) for each different number of points in column k: frames are fixed when a plan is made. There are few
    different ones, however many series; only they come to the driver."""
    found = sorted(r[0] for r in df.select(k).distinct().collect())
    as_column = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    parts = [make(df.filter(F.col(k) == as_column(x)), x) for x in found]
    if not parts:
        return make(df, [1, 1] if df.schema[k].dataType.typeName() == "array" else 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
