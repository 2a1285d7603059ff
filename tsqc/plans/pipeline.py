"""The quality-control pipeline over all series at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, is_finite, sanitize, yes
from tsqc.operators import bands, checks, clean, regress, runs, smooth, stats, time_ops
from tsqc.operators.project import between
from tsqc.plans.config import VARIABLES, Settings
from tsqc.sources import readers, writers


@dataclass
class Result:
    """All lazy; timeseries and events are long."""

    timeseries: DataFrame
    events: DataFrame
    seasonal: DataFrame
    meta: DataFrame
    decimals: DataFrame
    variables: list[str]


def run(obs: DataFrame, settings: Settings | None = None, ranges: dict | None = None, codes: dict[str, int] | None = None, variables: list[str] | None = None) -> Result:
    """Sentinels, duplicates, gaps, events, statistics, checks, bands and regression, in this order.

    obs is (station, variable, ts, value). Bands work on raw values and are merged into accepted only if the settings say so.
    """
    st = settings or Settings()
    masked = clean.mask_sentinels(obs)
    single = clean.resolve_duplicates(masked.select(*SERIES, "ts", "value"), st.dedupe)
    series = time_ops.null_after_gaps(single, st.gap_hours).select(*SERIES, "ts", "value")
    if st.persist:  # events, statistics and checks all start here
        series = series.persist()
    flat_v = runs.flat_values(series, st.flat_hours, mode=st.rle)
    flat_s = runs.flat_slopes(series, st.flat_hours, st.flat_slope_win, st.flat_slope_abs, st.rle)
    events = runs.events(series, st.flat_hours, st.flat_slope_win, st.flat_slope_abs, st.rle)
    seasonal = stats.season_stats(series, flat_v, flat_s)
    decimals = stats.decimal_histogram(series, st.dec_bins).join(stats.dominant_decimal(series), SERIES, "left").join(stats.quantization(series), SERIES, "left")
    raw = clean.resolve_duplicates(obs, "median").select(*SERIES, "ts", F.col("value").alias("raw"))
    out = series.withColumnRenamed("value", "clean").join(raw, [*SERIES, "ts"])
    bad = ~is_finite(F.col("clean"))
    if st.apply_checks:
        flags = checks.suite(series, ranges, st.rle).select(*SERIES, "ts", F.col("suite").alias("check_flag"))
        out = out.join(flags, [*SERIES, "ts"])
        bad = bad | F.col("check_flag")
    known = {v: c for v, c in (codes or {}).items()}
    if st.apply_bands and known:
        band = bands.detect_all(raw.withColumnRenamed("raw", "value"), known).select(*SERIES, "ts", F.col("masked").alias("sm_masked"), F.col("is_flagged").alias("sm_flagged"), F.col("flag_reason").alias("sm_flagreason"))
        out = out.join(band, [*SERIES, "ts"], "left")
        if st.accept_uses_bands:
            bad = bad | yes(F.col("sm_flagged"))
    if st.regression:
        source = series
        if st.discharge:
            q = series.filter(F.col("variable") == sanitize(st.discharge)).select("station", "ts", F.col("value").alias("q_discharge"))
            source = series.join(q, ["station", "ts"], "left")
        spikes = regress.residual_outliers(regress.local_regression(source, "q_discharge" if st.discharge else None))
        out = out.join(spikes.select(*SERIES, "ts", "spike"), [*SERIES, "ts"], "left")
        bad = bad | yes(F.col("spike"))
    if st.gaussian:
        trend = smooth.gaussian_trend_hours(series, st.gauss_sigma_hours)
        out = out.join(trend.select(*SERIES, "ts", "trend", F.col("residual").alias("trend_residual")), [*SERIES, "ts"], "left")
    out = out.withColumn("accepted", F.when(~bad, F.col("clean")))
    meta = (
        time_ops.infer_step(single)
        .join(clean.sentinels_used(obs), SERIES)
        .join(clean.duplicate_count(obs), SERIES)
        .select("station", F.col("variable").alias("col"), F.col("step_us"), F.col("used").alias("sentinel_used"), "duplicates", F.lit(st.regression).alias("wrtds_ok"))
    )
    return Result(out, events, seasonal, meta, decimals, variables or [])


def run_file(
    spark: SparkSession, csv_path: str, station: str, columns: list[str], base_out: str, station_field: str | None = None, timestamp_col: str = "timestamp",
    ranges: dict | None = None, settings: Settings | None = None,
) -> dict[str, str] | None:
    """Reads a wide CSV, runs the pipeline and writes all tables. None if no column is there."""
    wide = readers.read_csv(spark, csv_path, timestamp_col, station_field, station, [*columns], "none")
    found = [c for c in columns if c in wide.columns]
    if not found:
        return None
    obs = readers.to_long(wide.withColumn("station__", F.lit(station)), found, station="station__")
    codes = {sanitize(v): c for v, c in VARIABLES.items() if v in found}
    limits = {sanitize(v): r for v, r in (ranges or {}).items()}
    names = [sanitize(c) for c in found]
    return write(run(obs, settings, limits, codes, names), station, base_out)


def write(result: Result, station: str, base_out: str) -> dict[str, str]:
    """Wide Parquet, and CSV tables: events, seasons and meta. Tables by variable are partitions of one folder."""
    paths = writers.output_paths(base_out, station)
    name = sanitize(station)
    columns = [c for c in result.timeseries.columns if c not in (*SERIES, "ts")]
    wide = writers.to_wide(result.timeseries, columns, result.variables)
    return paths | {
        "timeseries": writers.write_parquet(wide, f"{paths['processed']}/{name}__qc_timeseries.parquet"),
        "events_all": writers.write_csv(result.events.withColumnRenamed("variable", "col").orderBy("col", "type", "start"), f"{paths['tabs']}/{name}__events_all.csv"),
        "seasonal_all": writers.write_csv(result.seasonal.orderBy("variable", "season_rank").withColumnRenamed("variable", "col").drop("season_rank"), f"{paths['tabs']}/{name}__seasonal_all.csv"),
        "meta": writers.write_csv(result.meta, f"{paths['tabs']}/{name}__meta.csv"),
        **{f"events_{v}": writers.write_csv(result.events.filter(F.col("variable") == v).drop("station", "variable"), f"{paths['tabs']}/{v}__events.csv") for v in result.variables},
        **{f"seasonal_{v}": writers.write_csv(result.seasonal.filter(F.col("variable") == v).orderBy("season_rank").drop("station", "variable", "season_rank"), f"{paths['tabs']}/{v}__seasonal_summary.csv") for v in result.variables},
    }


def run_bands_file(
    spark: SparkSession, csv_path: str, out_csv: str, start: str | None = None, end: str | None = None, codes: dict[str, int] | None = None,
    offsets: dict[str, float] | None = None,
) -> str:
    """The band detector alone: the full input by time, with six columns per variable.

    Nothing is de-duplicated: each row, also of several at one time, has flags of its own, in file order within a time. Offsets are
    added to columns, in the output too. Rows whose time can't be parsed have no place among the others and are left out.
    """
    codes = codes or VARIABLES
    wide = readers.read_csv(spark, csv_path, dedupe="none").withColumn("place__", F.monotonically_increasing_id())
    wide = between(wide, start, end)
    for c, v in (offsets or {}).items():
        if c in wide.columns:
            wide = wide.withColumn(c, F.expr(f"try_cast(`{c}` AS double)") + float(v))
    found = [c for c in codes if c in wide.columns]
    if found:
        obs = readers.to_long(wide, found, keep=["place__"])
        result = bands.detect_all(obs, {sanitize(c): codes[c] for c in found}, ties=["place__"])
        wide = wide.join(bands.export_wide(result, [sanitize(c) for c in found], ["place__"]), "place__")
    return writers.write_csv(wide.orderBy("ts", "place__").drop("ts", "place__"), out_csv)
