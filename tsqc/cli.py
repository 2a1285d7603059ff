"""spark-submit tsqc/cli.py --csv FILE --station NAME --out DIR --vars COLUMN... [--range COLUMN:MIN:MAX]..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from tsqc.plans.config import RANGES, VARIABLES, Settings
from tsqc.plans.pipeline import run_file


def limits(text: str) -> tuple[str, tuple[float | None, float | None]]:
    name, low, high = text.rsplit(":", 2)
    return name, (float(low) if low else None, float(high) if high else None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Quality control of sensor series")
    p.add_argument("--csv", required=True)
    p.add_argument("--station", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--vars", nargs="+", default=list(VARIABLES))
    p.add_argument("--station-field")
    p.add_argument("--timestamp-col", default="timestamp")
    p.add_argument("--wrtds-q-col")
    p.add_argument("--gap-hours", type=float, default=2.0)
    p.add_argument("--rle", choices=("compat", "islands"), default="compat")
    p.add_argument("--range", dest="ranges", type=limits, action="append", default=[])
    p.add_argument("--no-checks", action="store_true")
    p.add_argument("--no-bands", action="store_true")
    return p


def main(argv: list[str] | None = None) -> dict[str, str] | None:
    a = parser().parse_args(argv)
    settings = replace(Settings(), gap_hours=a.gap_hours, rle=a.rle, apply_checks=not a.no_checks, apply_bands=not a.no_bands, regression=a.wrtds_q_col in a.vars, discharge=a.wrtds_q_col if a.wrtds_q_col in a.vars else None)
    spark = SparkSession.builder.appName("tsqc").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = run_file(spark, a.csv, a.station, a.vars, a.out, a.station_field, a.timestamp_col, {**RANGES, **dict(a.ranges)}, settings)
    for name, path in (found or {}).items():
        print(name, path)
    return found


if __name__ == "__main__":
    main()
