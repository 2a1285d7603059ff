"""Local weighted regression on time and season, and outliers of its residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, is_finite, year_phase, yes
from tsqc.operators.time_ops import elapsed_days

HALF_WIDTH = 90.0  # days
LEAST_WEIGHT = 1e-3


def reach(half_width: float = HALF_WIDTH) -> float:
    """Days beyond which weights are too small to count."""
    return half_width * math.sqrt(-math.log(LEAST_WEIGHT))


#: Weights that a task holds at once.
CELLS = 4_000_000
#: Normal equations of a worse condition are solved from the rows themselves.
CONDITION = 1e9


def _predict(t: np.ndarray, x: np.ndarray, y: np.ndarray, q: np.ndarray | None, hq: float, own: np.ndarray, half_width: float, minp: int) -> np.ndarray:
    """Weighted least squares at each own row: the moments of many rows by one product of matrices, then a batch of solutions."""
    out = np.full(len(t), np.nan)
    if not own.any():
        return out
    # Near 1 and about 0, so that squares lose little.
    mid, size = x.mean(0), np.maximum(x.std(0), 1e-12)
    a = (x - mid) / size
    a[:, 0] = 1.0
    p = a.shape[1]
    moments = np.concatenate(((a[:, :, None] * a[:, None, :]).reshape(len(t), p * p), a * y[:, None]), 1)
    rows = np.flatnonzero(own)
    for part in np.array_split(rows, max(1, len(rows) * len(t) // CELLS)):
        w = np.exp(-(((t[None, :] - t[part, None]) / half_width) ** 2))
        if q is not None:
            w *= np.exp(-(((q[None, :] - q[part, None]) / hq) ** 2))
        w[w <= LEAST_WEIGHT] = 0.0
        enough = (w > 0).sum(1) >= minp
        part, w = part[enough], w[enough]
        if not len(part):
            continue
        # Rows are multiplied by their weights, so squares of weights count in the sum of squares.
        sums = (w * w) @ moments
        left, right = sums[:, : p * p].reshape(-1, p, p), sums[:, p * p :]
        good = np.linalg.cond(left) < CONDITION
        beta = np.zeros((len(part), p))
        beta[good] = np.linalg.solve(left[good], right[good][:, :, None])[:, :, 0]
        for i in np.flatnonzero(~good):
            use = w[i] > 0
            beta[i] = np.linalg.lstsq(a[use] * w[i][use, None], y[use] * w[i][use], rcond=None)[0]
        out[part] = (a[part] * beta).sum(1)
    return out


def local_regression(df: DataFrame, discharge: str | None = None, half_width: float = HALF_WIDTH, minp: int = 30, block_days: float = 237.0) -> DataFrame:
    """Adds yhat and residual. Blocks of days with the rows in reach on both sides are fitted apart, so a series is never in one task."""
    df = elapsed_days(df)
    sin, cos = year_phase(F.col("ts"))
    usable = is_finite(F.col("value")) & (is_finite(F.col(discharge)) if discharge else F.lit(True))
    rows = df.filter(usable).select(*SERIES, "ts", F.col("value").alias("y"), "days", sin.alias("s"), cos.alias("c"), (F.col(discharge) if discharge else F.lit(None).cast("double")).alias("q"))
    sums = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n__"), F.expr("percentile(q, 0.5)").alias("qm__"))
    rows = rows.join(sums, SERIES)
    spread = rows.withColumn("d__", F.abs(F.col("q") - F.col("qm__"))).groupBy(*SERIES).agg(F.greatest(F.lit(1e-9), 3 * F.expr("percentile(d__, 0.5)")).alias("hq"))
    r = reach(half_width)
    low, high = F.floor((F.col("days") - r) / block_days), F.floor((F.col("days") + r) / block_days)
    halo = rows.join(spread, SERIES).withColumn("home__", F.floor(F.col("days") / block_days)).withColumn("block__", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("days")
        t = pdf["days"].to_numpy()
        columns = [np.ones(len(t)), t, pdf["s"].to_numpy(), pdf["c"].to_numpy()]
        q = pdf["q"].to_numpy() if discharge else None
        if q is not None:
            columns.append(q)
        own = (pdf["home__"] == pdf["block__"]).to_numpy()
        enough = pdf["n__"].iloc[0] >= max(minp, 10)
        yhat = _predict(t, np.column_stack(columns), pdf["y"].to_numpy(), q, float(pdf["hq"].iloc[0]) if discharge else 1.0, own & enough, half_width, minp)
        return pdf.assign(yhat=yhat)[[*SERIES, "ts", "yhat"]][own]

    # One row for each time, however often it is there.
    fitted = halo.groupBy(*SERIES, "block__").applyInPandas(fit, "station string, variable string, ts timestamp_ntz, yhat double").dropDuplicates([*SERIES, "ts"])
    fitted = fitted.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))
    return df.join(fitted, [*SERIES, "ts"], "left").withColumn("residual", F.col("value") - F.col("yhat"))


def residual_outliers(df: DataFrame, column: str = "residual", threshold: float = 4.0) -> DataFrame:
    """spike: robust z over the whole series reaches the threshold."""
    med = df.groupBy(*SERIES).agg(F.expr(f"percentile({column}, 0.5)").alias("med__"))
    df = df.join(med, SERIES)
    mad = df.withColumn("dev__", F.abs(F.col(column) - F.col("med__"))).groupBy(*SERIES).agg(F.expr("percentile(dev__, 0.5)").alias("mad__"))
    z = (F.col(column) - F.col("med__")) / (F.lit(1.4826) * F.col("mad__") + F.lit(1e-9))
    return df.join(mad, SERIES).withColumn("z", z).withColumn("spike", yes(F.abs(F.col("z")) >= threshold)).drop("med__", "mad__")
