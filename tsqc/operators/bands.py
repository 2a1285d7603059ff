"""Five-pass statistical bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, centred, is_finite, ordered
from tsqc.operators.positions import over_blocks, with_pos_by_day
from tsqc.operators.project import between, calibrate, positive_only, to_nitrate, to_nitrogen
from tsqc.operators.stats import any_of
from tsqc.operators.windows import min_count, rolling, triangular
from tsqc.plans.config import Sensor, sensor
from tsqc.sources.writers import to_wide

FLAGS = ["flag_sensor", "flag_run1", "flag_run2", "flag_run3", "flag_run4", "flag_run5"]
EXPORT = ["flag_global", "is_flagged", "flag_reason", "qcband_top", "qcband_bottom", "masked"]


def sensor_error(s: Sensor, x: Column) -> Column:
    """The sensor's own error values."""
    bad = [x == v for v in s.exact] + [x < 0]
    if s.ceiling is not None:
        bad.append(x >= s.ceiling)
    if s.missing_is_error:
        bad.append(~is_finite(x))
    return any_of(*bad)


def outside(s: Sensor, x: Column, top: Column, bottom: Column) -> Column:
    """With uncertainty, both ends of the value's range are above the band or both below; no band, no flag."""
    if s.percent is not None:
        low, high = x * (1 - s.percent), x * (1 + s.percent)
    elif s.constant is not None:
        low, high = x - s.constant, x + s.constant
    else:
        return any_of(x > top, x < bottom)
    return any_of((low > top) & (high > top), (low < bottom) & (high < bottom))


#: Rows of a block; the longest window of all sensors reaches 480 rows past its ends.
BLOCK_ROWS = 50_000


def detect(df: DataFrame, code: int, ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bands for series of one sensor code, over blocks of rows. All passes read the same values: none masks for the next. Rows of
    one time each have windows of their own, in the order of the columns `ties`."""
    reach = [centred(p.window) for p in sensor(code).passes]
    before, after = max(-lo for lo, _ in reach), max(hi for _, hi in reach)
    return over_blocks(with_pos_by_day(df, ties), before, max(after, 2), lambda rows, keys: _detect(rows, code, keys), block_rows).drop("pos")


def _detect(df: DataFrame, code: int, keys: Sequence[str]) -> DataFrame:
    s = sensor(code)
    x = positive_only(F.col("value"))
    out = df.withColumns({"raw__": x, "obs": to_nitrogen(x) if s.nitrate else x, "mask_pre": x.isNull()})
    out = out.withColumn("flag_sensor", sensor_error(s, F.col("obs")))
    for i, p in enumerate(s.passes, 1):
        name = f"p{i}"
        out = triangular(out, name, "obs", keys=keys, by="pos") if i == 5 else rolling(out, p.window, name, median=i == 3, column="obs", keys=keys, by="pos")
        out = out.withColumns({f"{name}_top": F.col(f"{name}_ma") + p.above + F.col(f"{name}_sd") * p.factor, f"{name}_bot": F.col(f"{name}_ma") - p.below - F.col(f"{name}_sd") * p.factor})
        out = out.withColumn(f"flag_run{i}", outside(s, F.col("obs"), F.col(f"{name}_top"), F.col(f"{name}_bot"))).drop(f"{name}_ma", f"{name}_sd")
    k = s.passes[4].window
    supported = F.count("obs").over(ordered(keys, "pos").rowsBetween(*centred(k))) >= min_count(k)
    back = to_nitrate if s.nitrate else lambda c: c
    flagged = any_of(*[F.col(c) for c in FLAGS])
    out = out.withColumns({
        "qcband_top": back(F.when(supported, F.col("p5_top"))),
        "qcband_bottom": back(F.when(supported, F.col("p5_bot"))),
        "is_flagged": flagged,
        "flag_global": F.when(flagged, F.lit(200)).otherwise(F.lit(100)),
        "flag_reason": F.concat_ws(" ", *[F.when(F.col(c), F.lit(c)) for c in FLAGS]),
        "masked": F.when(~flagged, F.col("raw__")),
    })
    return out.drop("raw__", *[f"p{i}_{e}" for i in range(1, 6) for e in ("top", "bot")])


def detect_all(df: DataFrame, codes: dict[str, int], offsets: dict[str, float] | None = None, start: str | None = None, end: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """All variables that have a code; each code is one branch, whose series run together."""
    df = calibrate(between(df, start, end), offsets or {})
    out = None
    for code in sorted(set(codes.values())):
        names = [v for v, c in codes.items() if c == code]
        part = detect(df.filter(F.col("variable").isin(names)), code, ties)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no variable has a sensor code")
    return out


def export_wide(bands: DataFrame, variables: list[str], keys: Sequence[str] = ("station", "ts")) -> DataFrame:
    """Six columns per variable."""
    return to_wide(bands.select(*keys, "variable", *EXPORT), EXPORT, variables, keys)
