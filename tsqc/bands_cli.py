"""spark-submit tsqc/bands_cli.py --csv FILE --out FILE [--offset COLUMN:VALUE]... [--start TIME --end TIME]: the band detector alone."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tsqc.plans.pipeline import run_bands_file


def offset(text: str) -> tuple[str, float]:
    name, value = text.rsplit(":", 1)
    return name, float(value)


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description="Five-pass bands of sensor series")
    p.add_argument("--csv", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--offset", dest="offsets", type=offset, action="append", default=[])
    p.add_argument("--start")
    p.add_argument("--end")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tsqc").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    path = run_bands_file(spark, a.csv, a.out, a.start, a.end, offsets=dict(a.offsets))
    print(path)
    return path


if __name__ == "__main__":
    main()
