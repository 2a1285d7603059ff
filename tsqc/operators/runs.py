"""Runs of a mask, and the events made of them.

Two ways of cutting runs. islands: each maximal stretch of true rows. compat: rows whose change flag differs from the next
row's are bounds; a run goes from one bound to the next, the last bound starts none. In compat a stretch of three or more true rows
gives all but its last row, then its last row with what follows; a lone true row gives nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.functions.core import BY_TIME, SERIES, hours, is_finite, micros, ordered, yes
from tsqc.operators.positions import over_blocks, with_pos, with_pos_by_day

#: Rows of a block of slopes.
BLOCK_ROWS = 50_000
EVENT_COLUMNS = ["station", "variable", "type", "start", "end", "pre", "post", "pre_val", "post_val", "hours"]


def rle(df: DataFrame, mask: str, mode: str = "compat", first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Per true run: start_pos and len; start and end, its times (compat ends on the row past it, islands on its last row); and
    the columns `first` of its first row and `last` of its last one. df has pos. One pass over the series, nothing is joined."""
    w = ordered()
    change = F.coalesce(F.col(mask) != F.lag(mask).over(w), F.lit(True))
    if mode == "islands":
        runs = df.withColumn("c__", change).withColumn("g__", F.sum(F.col("c__").cast("long")).over(w))
        return runs.filter(F.col(mask)).groupBy(*SERIES, "g__").agg(
            F.min("pos").alias("start_pos"), F.count(F.lit(1)).alias("len"), F.min("ts").alias("start"), F.max("ts").alias("end"),
            *[F.min_by(c, "pos").alias(c) for c in first], *[F.max_by(c, "pos").alias(c) for c in last],
        ).drop("g__")
    marked = df.select(*SERIES, "ts", "pos", F.col(mask).alias("m__"), change.alias("c__"), *first, *[F.lag(c).over(w).alias(c) for c in last])
    bounds = marked.withColumn("d__", F.coalesce(F.lead("c__").over(w), F.lit(True))).filter("c__ != d__")
    # The last row of a run comes right before the next bound.
    bounds = bounds.withColumns({"len": F.lead("pos").over(w) - F.col("pos"), "end": F.lead("ts").over(w), **{c: F.lead(c).over(w) for c in last}})
    return bounds.filter("m__ AND len IS NOT NULL").select(*SERIES, F.col("pos").alias("start_pos"), "len", F.col("ts").alias("start"), "end", *first, *last)


def _long(runs: DataFrame, min_hours: float) -> DataFrame:
    return runs.withColumn("hours", hours(F.col("start"), F.col("end"))).filter(F.col("hours") >= min_hours)


def flat_values(df: DataFrame, min_hours: float = 2.0, tol: float = 0.0, mode: str = "compat") -> DataFrame:
    """Runs of rows that equal the row before them, of min_hours at least."""
    df = with_pos(df, ["value"])
    v, p = F.col("value"), F.lag("value").over(ordered(by=BY_TIME))
    same = yes((F.abs(v - p) <= tol) | (~is_finite(v) & (v == p)))
    marked = df.withColumn("eq__", same)
    return _long(rle(marked, "eq__", mode, first=["value"]), min_hours)


def rolling_slope(df: DataFrame, win: int = 25, minp: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """slope: least squares of value on seconds in a centred window of rows, over blocks of rows."""
    return _slopes(df, win, minp, block_rows).drop("pos")


def _slopes(df: DataFrame, win: int, minp: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    h = max(3, win) // 2
    minp = max(5, win // 3) if minp is None else minp

    def make(rows: DataFrame, keys: list[str]) -> DataFrame:
        start = F.min("ts").over(Window.partitionBy(*keys))
        rows = rows.withColumn("sec__", micros(start, F.col("ts")) / F.lit(1e6)).withColumn("v__", F.when(is_finite(F.col("value")), F.col("value")))
        w = ordered(keys, "pos").rowsBetween(-h, h)
        return rows.withColumn("slope", F.when(F.count("v__").over(w) >= minp, F.expr("regr_slope(v__, sec__)").over(w))).drop("sec__", "v__")

    return over_blocks(with_pos_by_day(df), h, h, make, block_rows)


def flat_slopes(df: DataFrame, min_hours: float = 2.0, win: int = 25, abs_slope: float = 0.0, mode: str = "compat") -> DataFrame:
    marked = _slopes(df, win).withColumns({"flat__": yes(F.abs("slope") <= abs_slope), "value": F.lit(0.0)})
    return _long(rle(marked, "flat__", mode, first=["value"]), min_hours)


def binary_switches(df: DataFrame, zero_tol: float = 1e-12, min_dur: int = 1, mode: str = "compat") -> DataFrame:
    """Runs of zeros with finite neighbours of which at least one is not zero. A run at an end is its own neighbour there."""
    w = ordered()
    near = with_pos(df).select(
        *SERIES, "ts", "pos", (is_finite(F.col("value")) & (F.abs("value") <= zero_tol)).alias("zero__"), F.col("ts").alias("stop"),
        F.coalesce(F.lag("ts").over(w), F.col("ts")).alias("pre"), F.coalesce(F.lead("ts").over(w), F.col("ts")).alias("post"),
        F.when(F.lag("pos").over(w).isNull(), F.col("value")).otherwise(F.lag("value").over(w)).alias("pre_val"),
        F.when(F.lead("pos").over(w).isNull(), F.col("value")).otherwise(F.lead("value").over(w)).alias("post_val"),
    )
    found = rle(near, "zero__", mode, first=["pre", "pre_val"], last=["stop", "post", "post_val"]).filter(F.col("len") >= min_dur)
    good = is_finite(F.col("pre_val")) & is_finite(F.col("post_val")) & ((F.col("pre_val") != 0) | (F.col("post_val") != 0))
    return found.filter(good).withColumn("end", F.col("stop")).drop("stop")


def mask_from_runs(df: DataFrame, runs: DataFrame, name: str = "in_run") -> DataFrame:
    """Rows with start <= ts <= end of any run: a sweep over rows and run starts by time, no range join."""
    rows = df.withColumn("stop__", F.lit(None).cast("timestamp_ntz")).withColumn("kind__", F.lit(1))
    starts = runs.select(*SERIES, F.col("start").alias("ts"), F.col("end").alias("stop__"), F.lit(0).alias("kind__"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*SERIES).orderBy("ts", "kind__").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, yes(F.max("stop__").over(w) >= F.col("ts"))).filter("kind__ = 1").drop("stop__", "kind__")


def events(df: DataFrame, min_hours: float = 2.0, win: int = 25, abs_slope: float = 0.0, mode: str = "compat") -> DataFrame:
    """Binary switches, flat values and flat slopes in one table."""
    parts = [
        binary_switches(df, mode=mode).withColumn("type", F.lit("binary_switch")).drop("start_pos", "len"),
        flat_values(df, min_hours, mode=mode).withColumn("type", F.lit("flat_values")).drop("start_pos", "len", "value"),
        flat_slopes(df, min_hours, win, abs_slope, mode).withColumn("type", F.lit("flat_slopes")).drop("start_pos", "len", "value"),
    ]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select(*EVENT_COLUMNS)
