"""Output folders, wide exports and tables as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.functions.core import sanitize


def output_paths(root: str, station: str) -> dict[str, str]:
    """Paths only: stores of objects have no folders to make."""
    name = sanitize(station)
    root = root.rstrip("/")
    return {"root": root, "figs": f"{root}/reports/figures/{name}", "tabs": f"{root}/reports/tables/{name}", "logs": f"{root}/reports/logs/{name}", "processed": f"{root}/processed/{name}"}


def to_wide(df: DataFrame, columns: list[str], variables: list[str], keys: Sequence[str] = ("station", "ts")) -> DataFrame:
    """One row per time (or other keys): for each variable (given, so that no job looks for them) the columns named <variable>__<column>."""
    each = df.groupBy(*keys).pivot("variable", variables).agg(*[F.first(c).alias(c) for c in columns])
    names = {f"{v}_{c}" if len(columns) > 1 else v: f"{sanitize(v)}__{c}" for v in variables for c in columns}
    return each.select(*keys, *[F.col(f"`{a}`").alias(b) for a, b in names.items() if a in each.columns])


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; arrays become text like [1, 2]."""
    flat = [F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)
    return path
