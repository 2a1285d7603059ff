"""Decimals, quantization, seasons, shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import SEASONS, SERIES, is_finite, ordered, season, season_rank
from tsqc.operators.time_ops import infer_step


def fraction(c: Column) -> Column:
    """Fractional part modulo 1; that of -12.3 is 0.7."""
    return F.pmod(c, F.lit(1.0))


def edges(nbins: int) -> list[float]:
    """Equal edges as evenly spaced floats have them: edge 3 of 10 is 0.30000000000000004."""
    step = 1.0 / nbins
    return [i * step for i in range(nbins)] + [1.0]


def decimal_histogram(df: DataFrame, nbins: int = 10) -> DataFrame:
    """Per series: hist (counts of fractions by bin), chisq against equal counts, and its p value. Without values: zeros and NULL."""
    f = fraction(F.when(is_finite(F.col("value")), F.col("value")))
    e = edges(nbins)
    bin_of = F.lit(nbins - 1)
    for i in range(nbins - 1, 0, -1):
        bin_of = F.when(F.col("f") < e[i], F.lit(i - 1)).otherwise(bin_of)
    counts = df.select(*SERIES, f.alias("f")).groupBy(*SERIES).agg(*[F.count_if(F.col("f").isNotNull() & (bin_of == i)).alias(f"h{i}") for i in range(nbins)])
    hist = F.array(*[F.col(f"h{i}") for i in range(nbins)])
    n = sum((F.col(f"h{i}") for i in range(nbins)), F.lit(0))
    mean = n / F.lit(float(nbins))
    chisq = sum(((F.col(f"h{i}") - mean) * (F.col(f"h{i}") - mean) for i in range(nbins)), F.lit(0.0)) / F.nullif(mean, F.lit(0.0))
    return counts.select(*SERIES, hist.alias("hist"), chisq.alias("chisq")).withColumn("root__", F.sqrt(F.col("chisq") / 2)).withColumn("p", chi_square_tail(F.col("root__"), nbins - 1)).drop("root__")


def chi_square_tail(root: Column, dof: int) -> Column:
    """Probability above 2 * root ** 2, for whole degrees of freedom: a finite sum, so no Python is needed."""
    half = root * root
    if dof % 2 == 0:
        terms = [F.pow(half, F.lit(float(k))) / math.factorial(k) for k in range(dof // 2)]
        return F.exp(-half) * sum(terms[1:], terms[0])
    terms = [F.pow(half, F.lit(k + 0.5)) / math.gamma(k + 1.5) for k in range((dof - 1) // 2)]
    return erfc(root) + (F.exp(-half) * sum(terms[1:], terms[0]) if terms else F.lit(0.0))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: a series in nested form below 3, a continued fraction above."""
    nested = F.lit(1.0)
    for n in range(45, 0, -1):
        nested = nested * (2.0 / (2 * n + 1)) * x * x + 1.0
    fraction = F.lit(0.0)
    for k in range(40, 0, -1):
        fraction = F.lit(k / 2.0) / (x + fraction)
    tail = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 3, F.lit(1.0) - tail * 2.0 * x * nested).otherwise(tail / (x + fraction))


def dominant_decimal(df: DataFrame) -> DataFrame:
    """Per series: the commonest two decimals (least of ties) and its share. Missing values don't count."""
    d = F.bround(fraction(F.when(is_finite(F.col("value")), F.col("value"))) * 100, 0).cast("int")
    counts = df.select(*SERIES, d.alias("dom")).filter("dom IS NOT NULL").groupBy(*SERIES, "dom").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*SERIES).agg(F.max(F.struct("n", (-F.col("dom")).alias("m"))).alias("x"), F.sum("n").alias("total"))
    return best.select(*SERIES, (-F.col("x.m")).alias("dom"), (F.col("x.n") / F.col("total")).alias("frac"))


def quantization(df: DataFrame, tol: float = 1e-3, accept: float = 0.7) -> DataFrame:
    """Per series: step that most positive differences of successive values are multiples of, and is_quantized."""
    d = F.abs(F.col("value") - F.lag("value").over(ordered()))
    diffs = df.select(*SERIES, d.alias("d")).filter(is_finite(F.col("d")) & (F.col("d") > 0))
    q = diffs.groupBy(*SERIES).agg(F.expr("percentile(d, array(0.1, 0.25, 0.5))").alias("q"))
    tries = [F.get("q", F.lit(0)), F.get("q", F.lit(1)), *[F.get("q", F.lit(2)) / i for i in range(1, 10)]]
    cands = q.select(*SERIES, F.array(*tries).alias("c"))
    # Every difference tries all candidates in place: eleven sums by series, no rows are multiplied.
    both = diffs.join(cands, SERIES)
    r = lambda i: F.col("d") / F.get("c", F.lit(i))
    shares = both.groupBy(*SERIES).agg(F.first("c").alias("c"), *[F.avg((F.abs(r(i) - F.bround(r(i), 0)) <= tol).cast("double")).alias(f"s{i}") for i in range(11)])
    scored = F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i"), F.get("c", F.lit(i)).alias("c")) for i in range(11)])
    best = F.array_max(scored)
    found = shares.select(*SERIES, F.when(best["s"] > accept, best["c"]).alias("step"))
    every = df.select(*SERIES).distinct()
    return every.join(found, SERIES, "left").withColumn("is_quantized", F.col("step").isNotNull())


def season_stats(df: DataFrame, flat_values: DataFrame | None = None, flat_slopes: DataFrame | None = None) -> DataFrame:
    """Per series and season (always four, in order): coverage and missing percent, and runs of two hours by season of their start."""
    step = infer_step(df)
    agg = df.withColumn("season", season(F.col("ts"))).groupBy(*SERIES, "season").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(F.col("value"))).alias("nnan"), F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("span")
    )
    frame = step.withColumn("season", F.explode(F.array(*map(F.lit, SEASONS))))
    out = frame.join(agg, [*SERIES, "season"], "left")
    expected = F.greatest(F.lit(1), F.bround((F.col("span") + F.col("step_us")) / F.col("step_us"), 0).cast("long"))
    out = out.withColumns({
        "coverage_pct": F.coalesce(F.lit(100.0) * (F.col("n") - F.col("nnan")) / expected, F.lit(0.0)),
        "nan_pct": F.coalesce(F.lit(100.0) * F.col("nnan") / F.greatest(F.lit(1), F.col("n")), F.lit(0.0)),
    })
    for name, runs in (("flat_values_events", flat_values), ("flat_slopes_events", flat_slopes)):
        if runs is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
            continue
        counts = runs.filter("hours >= 2.0").groupBy(*SERIES, season(F.col("start")).alias("season")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, [*SERIES, "season"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))
    return out.select(*SERIES, "season", season_rank(F.col("season")).alias("season_rank"), "coverage_pct", "nan_pct", "flat_values_events", "flat_slopes_events")


def availability(df: DataFrame, flag: str = "is_flagged", value: str = "value") -> DataFrame:
    """Per series: percent of rows with a value, and percent flagged."""
    return df.groupBy(*SERIES).agg((F.avg(is_finite(F.col(value)).cast("double")) * 100).alias("available_pct"), (F.avg(F.col(flag).cast("double")) * 100).alias("flagged_pct"))


def low_percentile(df: DataFrame, p: float = 0.005) -> DataFrame:
    """Per series: a low percentile of the positive values, a floor for logarithmic axes."""
    return df.filter(is_finite(F.col("value")) & (F.col("value") > 0)).groupBy(*SERIES).agg(F.expr(f"percentile(value, {p})").alias("floor"))


def any_of(*masks: Column) -> Column:
    """Or of masks in which NULL is false."""
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return out
