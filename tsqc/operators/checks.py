"""The check suite. Each adds a BOOLEAN column without NULLs; constants is plateau, and unilof is zscore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import BY_TIME, HOUR, SERIES, is_finite, micros, ordered, points, yes
from tsqc.operators.positions import with_pos
from tsqc.operators.runs import flat_values, mask_from_runs, rle
from tsqc.operators.stats import any_of
from tsqc.operators.time_ops import infer_step

CHECKS = ["range", "missing", "plateau", "constants", "variance", "zscore", "jumps", "isolated", "unilof"]


def check_range(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    out = F.lit(False)
    for name, (low, high) in ranges.items():
        bad = any_of(*([F.col("value") < low] if low is not None else []), *([F.col("value") > high] if high is not None else []))
        out = F.when(F.col("variable") == name, bad).otherwise(out)
    return df.withColumn("range", out)


def check_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("missing", F.col("value").isNull())


def check_plateau(df: DataFrame, min_hours: float = 2.0, mode: str = "compat") -> DataFrame:
    return mask_from_runs(df, flat_values(df.select(*SERIES, "ts", "value"), min_hours, mode=mode), "plateau").withColumn("constants", F.col("plateau"))


def _sliding(df: DataFrame, variance_hours: float | None, zscore_hours: float | None, flat: float = 1e-12, threshold: float = 4.0, block_rows: int = 50_000) -> DataFrame:
    """variance and zscore, as far as they have hours, over centred windows of as many rows as each series' step gives.

    Medians of sliding windows have no built-in that does less than sort each window anew, and frames of Spark are fixed when a
    plan is made, so pandas slides them, over blocks of rows with the rows in reach around them. Only flagged rows come back.
    """
    names = [n for n, h in (("variance", variance_hours), ("zscore", zscore_hours)) if h is not None]
    hours = [h for h in (variance_hours, zscore_hours) if h is not None]
    lengths = infer_step(df).select(*SERIES, *(points(h, F.col("step_us")).alias(f"k_{n}__") for n, h in zip(names, hours)))
    rows = with_pos(df, ["value"])
    reach = F.greatest(*(F.col(f"k_{n}__") * (2 if n == "zscore" else 1) for n in names), F.lit(1))
    block = lambda at: F.floor(at / block_rows)
    near = F.sequence(F.greatest(block(F.col("pos") - reach), F.lit(0)), block(F.col("pos") + reach))
    spread = rows.select(*SERIES, "pos", "value").join(lengths, SERIES).withColumns({"home__": block(F.col("pos")), "block__": F.explode(near)})

    def variance(value: pd.Series, k: int) -> pd.Series:
        need = max(3, k // 3)
        if need > k:
            return pd.Series(False, index=value.index)
        window = value.rolling(k, min_periods=need, center=True)
        wide = window.max() - window.min()
        low = wide == 0
        # Two values this far apart alone give more than the threshold; what is left is summed directly.
        for i in np.flatnonzero((wide > 0) & (wide * wide <= 2 * k * flat)):
            near = value.iloc[max(0, i - k // 2) : i + (k - 1) // 2 + 1]
            low.iloc[i] = near.var(ddof=1) <= flat
        return low

    def zscore(value: pd.Series, k: int) -> pd.Series:
        need = max(5, k // 3)
        if need > k:
            return pd.Series(False, index=value.index)
        off = value - value.rolling(k, min_periods=need, center=True).median()
        mad = off.abs().rolling(k, min_periods=need, center=True).median()
        return (0.6745 * off / mad.where(mad != 0)).abs() >= threshold

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        value = pdf["value"].astype(float)
        found = pdf.assign(**{n: {"variance": variance, "zscore": zscore}[n](value, int(pdf[f"k_{n}__"].iloc[0])) for n in names})
        return found[(pdf["home__"] == pdf["block__"]) & found[names].any(axis=1)][[*SERIES, "pos", *names]]

    bad = spread.groupBy(*SERIES, "block__").applyInPandas(judge, "station string, variable string, pos long, " + ", ".join(f"{n} boolean" for n in names))
    out = rows.join(bad, [*SERIES, "pos"], "left").drop("pos")
    return out.withColumns({n: yes(F.col(n)) for n in names})


def check_variance(df: DataFrame, hours: float = 6.0, threshold: float = 1e-12) -> DataFrame:
    return _sliding(df, hours, None, flat=threshold)


def check_zscore(df: DataFrame, hours: float = 24.0, threshold: float = 4.0) -> DataFrame:
    """Robust z of a value against its window's median and the median of deviations, each from its own row's median. unilof is the
    same."""
    return _sliding(df, None, hours, threshold=threshold).withColumn("unilof", F.col("zscore"))


def check_windows(df: DataFrame, variance_hours: float = 6.0, zscore_hours: float = 24.0) -> DataFrame:
    """Both of them, in one pass."""
    return _sliding(df, variance_hours, zscore_hours).withColumn("unilof", F.col("zscore"))


def check_jumps(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    return df.withColumn("jumps", yes(F.abs(F.col("value") - F.lag("value").over(ordered(by=BY_TIME))) >= threshold))


def check_isolated(df: DataFrame, gap_hours: float = 3.0, group_hours: float = 0.5, mode: str = "compat") -> DataFrame:
    """Short runs of finite rows with a gap before their first row and one after them."""
    o = ordered(by=BY_TIME)
    step = infer_step(df).select(*SERIES, points(group_hours, F.col("step_us")).alias("most__"))
    df = with_pos(df, ["value"])
    marked = df.withColumns({
        "fin__": is_finite(F.col("value")),
        "gap__": yes(micros(F.lag("ts").over(o), F.col("ts")) > F.lit(int(gap_hours * HOUR))),
    })
    runs = rle(marked, "fin__", mode).join(step, SERIES).filter("len <= most__").withColumn("next_pos", F.col("start_pos") + F.col("len"))
    gaps = marked.filter("gap__").select(*SERIES, "pos")
    found = runs.join(gaps.withColumnRenamed("pos", "start_pos"), [*SERIES, "start_pos"], "left_semi").join(gaps.withColumnRenamed("pos", "next_pos"), [*SERIES, "next_pos"], "left_semi")
    rows = found.select(*SERIES, F.explode(F.sequence("start_pos", F.col("next_pos") - 1)).alias("pos"), F.lit(True).alias("isolated")).distinct()
    return df.join(rows, [*SERIES, "pos"], "left").withColumn("isolated", yes(F.col("isolated"))).drop("pos")


def suite(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]] | None = None, mode: str = "compat") -> DataFrame:
    """All checks, suite (any of them) and flag (255 or 0)."""
    out = check_jumps(check_missing(check_range(check_windows(df), ranges or {})))
    out = check_isolated(check_plateau(out, mode=mode), mode=mode)
    bad = any_of(*[F.col(c) for c in CHECKS])
    return out.withColumn("suite", bad).withColumn("flag", F.when(bad, F.lit(255)).otherwise(F.lit(0)))
