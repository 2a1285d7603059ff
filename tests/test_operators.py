"""Small series with results worked out by hand, and checks against plain numpy."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsqc.functions.core import sanitize
from tsqc.operators import bands, checks, clean, regress, runs, smooth, stats, time_ops
from tsqc.operators.positions import over_blocks, with_pos, with_pos_by_day
from tsqc.operators.windows import rolling, triangular
from tsqc.plans.config import Settings
from tsqc.plans.pipeline import run, run_bands_file, run_file
from tsqc.sources import readers
from tsqc.streaming.row_checks import row_flags

START = dt.datetime(2024, 3, 1)
SCHEMA = "station string, variable string, ts timestamp_ntz, value double"


def series(spark, values, step=15, times=None, name="v"):
    times = times or [i * step for i in range(len(values))]
    rows = [("s", name, START + dt.timedelta(minutes=t), None if v is None else float(v)) for t, v in zip(times, values)]
    return spark.createDataFrame(rows, SCHEMA)


TABLE = [
    ("TTTTT", [(0, 4)], [(0, 5)]), ("FFTTTFF", [(2, 2), (4, 1)], [(2, 3)]), ("FFTTFF", [(2, 1), (3, 1)], [(2, 2)]), ("FFTFF", [], [(2, 1)]),
    ("FTFTF", [], [(1, 1), (3, 1)]), ("FFTTTTT", [(2, 4)], [(2, 5)]), ("TTTFF", [(0, 2), (2, 1)], [(0, 3)]), ("FFFTTTF", [(3, 2)], [(3, 3)]),
    ("TTTFTTT", [(0, 2), (2, 2), (4, 2)], [(0, 3), (4, 3)]), ("FFFTT", [(3, 1)], [(3, 2)]), ("T", [], [(0, 1)]),
]


def test_run_truth_table(spark):
    rows = [("s", mask, START + dt.timedelta(minutes=i), i, c == "T") for mask, _, _ in TABLE for i, c in enumerate(mask)]
    df = spark.createDataFrame(rows, "station string, variable string, ts timestamp_ntz, pos long, m boolean")
    for mode, at in (("compat", 1), ("islands", 2)):
        got: dict = {}
        for r in runs.rle(df, "m", mode).collect():
            got.setdefault(r.variable, []).append((r.start_pos, r.len))
        for row in TABLE:
            assert sorted(got.get(row[0], [])) == row[at], (mode, row[0])


def test_step_and_gaps(spark):
    df = series(spark, [1, 2, 3, 4], times=[0, 15, 30, 200])
    assert time_ops.infer_step(df).first().step_us == 15 * 60_000_000
    assert [r.is_gap for r in time_ops.with_gaps(df).orderBy("ts").collect()] == [False, False, False, True]
    assert [r.value for r in time_ops.null_after_gaps(df).orderBy("ts").collect()] == [1, 2, 3, None]
    assert time_ops.infer_step(series(spark, [1, 2])).first().step_us == time_ops.DEFAULT_STEP


def test_empty_series(spark):
    empty = series(spark, [])
    assert runs.events(empty).count() == 0
    assert checks.suite(empty, {}).count() == 0
    assert stats.season_stats(empty).count() == 0
    assert clean.mask_sentinels(empty).count() == 0


def test_sentinels(spark):
    df = series(spark, [-99, 1, 2, 3])  # one hit is over a thousandth of four rows
    assert clean.sentinels_used(df).first().used == [-99]
    assert [r.value for r in clean.mask_sentinels(df).orderBy("ts").collect()] == [None, 1, 2, 3]
    assert clean.sentinels_used(series(spark, [-9] + [1] * 2000)).first().used == []


def test_duplicates(spark):
    df = series(spark, [1, 5, None, 7], times=[0, 0, 0, 15])
    got = {r.ts.minute: (r.value, r.n_dup) for r in clean.resolve_duplicates(df).collect()}
    assert got == {0: (3.0, 3), 15: (7.0, 0)}
    assert clean.duplicate_count(df).first().duplicates == 3
    assert clean.resolve_duplicates(df, "mean").filter("n_dup > 0").first().value == 3.0


def test_flat_values_and_switches(spark):
    df = series(spark, [1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 2, 3])
    r = runs.flat_values(df, mode="islands").collect()
    assert len(r) == 1 and r[0].hours == 2.0 and r[0].value == 5.0
    z = series(spark, [1, 0, 0, 0, 2, 3])
    got = [(r.pre_val, r.post_val) for r in runs.binary_switches(z, mode="islands").collect()]
    assert got == [(1.0, 2.0)]
    assert sorted((r.pre_val, r.post_val) for r in runs.binary_switches(z).collect()) == [(0.0, 2.0), (1.0, 0.0)]


def test_slope_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=60)
    got = [r.slope for r in runs.rolling_slope(series(spark, v), win=7, minp=5).orderBy("ts").collect()]
    t = np.arange(60) * 900.0
    for i in range(60):
        a, b = max(0, i - 3), min(60, i + 4)
        if b - a >= 5:
            assert got[i] == pytest.approx(np.polyfit(t[a:b], v[a:b], 1)[0], abs=1e-12)
        else:
            assert got[i] is None


def test_decimals(spark):
    df = series(spark, [-12.3, 0.71, 1.7, None, 2.7])
    row = stats.decimal_histogram(df).first()
    assert sum(row.hist) == 4 and row.hist[6] + row.hist[7] == 4  # 0.7 is just below the edge
    assert stats.dominant_decimal(df).first().dom == 70
    u = stats.decimal_histogram(series(spark, [i / 10 + 0.05 for i in range(10)])).first()
    assert u.chisq == 0 and u.p == pytest.approx(1.0)
    none = stats.decimal_histogram(series(spark, [None, None])).first()
    assert sum(none.hist) == 0 and none.chisq is None


@pytest.mark.parametrize("dof", [1, 2, 4, 9])
def test_chi_square_tail(spark, dof):
    df = spark.range(1, 60).select((F.col("id") * 0.5).alias("x")).withColumn("root", F.sqrt(F.col("x") / 2)).withColumn("p", stats.chi_square_tail(F.col("root"), dof))
    for r in df.collect():
        # By integrating the density.
        n = 20000
        g = np.linspace(r.x, r.x + 200, n)
        want = np.trapezoid(g ** (dof / 2 - 1) * np.exp(-g / 2), g) / (2 ** (dof / 2) * math.gamma(dof / 2))
        assert r.p == pytest.approx(want, rel=2e-3, abs=1e-9)


def test_quantization(spark):
    rng = np.random.default_rng(2)
    q = stats.quantization(series(spark, np.round(rng.normal(0, 0.8, 300) / 0.5) * 0.5)).first()
    assert q.is_quantized and q.step in (0.5, 0.25, 1.0, 0.125)
    assert not stats.quantization(series(spark, rng.normal(size=300))).first().is_quantized


def test_seasons_are_always_four(spark):
    got = stats.season_stats(series(spark, [1, None, 3, 4])).orderBy("season_rank").collect()
    assert [r.season for r in got] == ["DJF", "MAM", "JJA", "SON"]
    assert got[1].coverage_pct == 75.0 and got[1].nan_pct == 25.0 and got[2].coverage_pct == 0.0


def test_checks(spark):
    v = [10.0] * 5 + [10.1, 9.9] * 50
    v[60] = 80.0
    got = checks.suite(series(spark, v), {"v": (None, 50.0)}).orderBy("ts").collect()
    assert got[60]["range"] and got[60].jumps and got[61].jumps and got[60].suite and got[60].flag == 255
    assert got[60].zscore and not got[20].zscore
    assert all(c is not None for r in got for c in r)


def test_checks_of_rows_of_one_time(spark):
    """Rows of one time stand in the order of their values, whatever order they arrive in."""
    rows = []
    for i in range(240):
        at = START + dt.timedelta(minutes=15 * i)
        rows.append(("s", "v", at, 10.0 + 0.1 * (i % 3), 2 * i))
        if i % 20 == 10:
            rows.append(("s", "v", at, 80.0, 2 * i + 1))
    # Each reading of the source gives its rows in another order, as fetches of a shuffle may.
    df = spark.createDataFrame(rows, SCHEMA + ", place long").coalesce(1).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), SCHEMA + ", place long")
    got = {r.place: r for r in checks.suite(df).collect()}
    assert len(got) == len(rows)
    for i in range(240):
        assert not got[2 * i].zscore and got[2 * i].jumps == (i % 20 == 11)
        if i % 20 == 10:
            odd = got[2 * i + 1]
            assert odd.zscore and odd.jumps and odd.suite and not got[2 * i].suite


def test_isolated_alone(spark):
    df = series(spark, [1, 2, 3, 4, 5, 6], times=[0, 15, 400, 415, 800, 815])
    got = [r.isolated for r in checks.check_isolated(df, group_hours=1.0, mode="islands").orderBy("ts").collect()]
    assert not any(got)  # no series of all finite rows has runs inside
    df = series(spark, [1, None, 3, None, 5], times=[0, 15, 400, 800, 815])
    got = [r.isolated for r in checks.check_isolated(df, mode="islands").orderBy("ts").collect()]
    assert got == [False, False, True, False, False]


def test_rolling_by_running_sums(spark):
    rng = np.random.default_rng(3)
    v = list(rng.normal(100, 5, 400))
    for i in range(0, 400, 17):
        v[i] = None
    got = rolling(series(spark, v), 120, "x").orderBy("ts").collect()
    for i in (0, 30, 59, 60, 200, 370, 399):
        w = [x for x in v[max(0, i - 60) : i + 60] if x is not None]
        assert got[i].x_ma == pytest.approx(np.mean(w), abs=1e-9) and got[i].x_sd == pytest.approx(np.std(w), abs=1e-8)


def test_triangular(spark):
    got = triangular(series(spark, [1, 2, 4, 8, 16]), "t").orderBy("ts").collect()
    assert got[0].t_ma == pytest.approx((3 * 1 + 2 * 2 + 1 * 4) / 6)
    assert got[2].t_ma == pytest.approx((1 + 4 + 12 + 16 + 16) / 9)


def test_bands_flag_spike_and_errors(spark):
    v = [8 + 0.01 * (i % 5) for i in range(200)]
    v[100], v[150], v[160] = 14.0, 25.0, -1.0
    got = bands.detect(series(spark, v), 400).orderBy("ts").collect()
    assert got[100].is_flagged and "flag_run3" in got[100].flag_reason
    assert "flag_sensor" in got[150].flag_reason and got[160].flag_reason == "flag_sensor" and got[160].mask_pre
    assert got[20].flag_global == 100 and got[20].masked == got[20].obs


def test_blocks_equal_whole_series(spark):
    df = series(spark, list(np.random.default_rng(4).normal(size=300)), step=60)
    assert [r.pos for r in with_pos_by_day(df).orderBy("ts").collect()] == list(range(300))

    def make(rows, keys):
        from pyspark.sql import Window

        return rows.withColumn("m", F.avg("value").over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(-5, 4)))

    whole = make(with_pos(df), ["station", "variable"]).orderBy("ts").collect()
    parts = over_blocks(with_pos_by_day(df), 5, 4, make, rows=40).orderBy("ts").collect()
    assert [r.m for r in whole] == pytest.approx([r.m for r in parts])


def test_local_regression_follows_a_line(spark):
    df = series(spark, [2 + 0.01 * i for i in range(400)], step=1440)
    got = regress.local_regression(df).orderBy("ts").collect()
    assert max(abs(r.residual) for r in got) < 1e-6
    few = regress.local_regression(series(spark, [1.0] * 20, step=1440)).collect()
    assert all(r.yhat is None for r in few)


def test_gaussian_keeps_constants(spark):
    got = smooth.gaussian_trend(series(spark, [None, 3, 3, None, 3, 3]), 2).collect()
    assert all(r.trend == pytest.approx(3.0) for r in got)
    assert smooth.sigma_points(900_000_000) == 6 and smooth.sigma_points(900_000_000, unit="hours") == 24


def test_names():
    assert sanitize("SurfaceWaterConcentration_O2 [mg*L-1]") == "SurfaceWaterConcentration_O2_mg_L-1"


def test_files_end_to_end(spark, tmp_path):
    path = tmp_path / "in.csv"
    lines = ["timestamp,site,SurfaceWaterConcentration_O2 [mg*L-1],SurfaceWaterpH [pH]"]
    for i in range(120):
        t = (START + dt.timedelta(minutes=15 * i)).isoformat()
        lines.append(f"{t}+01:00,A,{'' if i == 7 else 8 + i % 3 * 0.1},{7 + i % 2 * 0.01}")
        lines.append(f"{t}+01:00,B,1,1")
    lines.append("not a time,A,1,1")
    path.write_text("\n".join(lines))
    columns = ["SurfaceWaterConcentration_O2 [mg*L-1]", "SurfaceWaterpH [pH]", "absent"]
    out = run_file(spark, str(path), "A", columns, str(tmp_path / "out"), "site", ranges={columns[0]: (0, 8.15)})
    wide = spark.read.parquet(out["timeseries"])
    assert wide.count() == 120
    assert {"SurfaceWaterpH_pH__raw", "SurfaceWaterConcentration_O2_mg_L-1__accepted", "SurfaceWaterConcentration_O2_mg_L-1__sm_flagged"} <= set(wide.columns)
    assert wide.filter("`SurfaceWaterConcentration_O2_mg_L-1__clean` > 8.15 AND `SurfaceWaterConcentration_O2_mg_L-1__accepted` IS NOT NULL").count() == 0
    o2 = "SurfaceWaterConcentration_O2_mg_L-1"
    assert wide.filter(f"`{o2}__clean` IS NOT NULL").count() == 119 and wide.filter(f"`{o2}__raw` > 8.15").count() == 40
    assert 0 < wide.filter(f"`{o2}__accepted` IS NOT NULL").count() <= 79 and wide.filter(f"`{o2}__sm_flagged` IS NULL").count() == 0
    assert wide.filter("SurfaceWaterpH_pH__clean = SurfaceWaterpH_pH__raw").count() == 120
    assert spark.read.csv(out["seasonal_all"], header=True).count() == 8
    assert spark.read.csv(out[f"seasonal_{o2}"], header=True).count() == 4
    assert {r["col"] for r in spark.read.csv(out["meta"], header=True).collect()} == {o2, "SurfaceWaterpH_pH"}
    assert run_file(spark, str(path), "A", ["absent"], str(tmp_path / "none")) is None
    csv = run_bands_file(spark, str(path), str(tmp_path / "bands.csv"), codes={columns[1]: 410})
    both = spark.read.csv(csv, header=True)
    assert both.count() == 240 and both.filter("SurfaceWaterpH_pH__flag_global IS NULL").count() == 0


def test_name_clash_is_an_error(spark):
    df = spark.createDataFrame([(START, 1.0, 2.0)], "ts timestamp_ntz, `a b` double, `a*b` double")
    with pytest.raises(ValueError):
        readers.to_long(df, ["a b", "a*b"])


def test_pipeline_counts_bands_only_if_told(spark):
    v = [8 + 0.01 * (i % 5) for i in range(120)]
    v[60] = 12.0
    df = series(spark, v, name="o")
    a = run(df, Settings(apply_checks=False), codes={"o": 400}).timeseries.filter("sm_flagged").first()
    b = run(df, Settings(apply_checks=False, accept_uses_bands=True), codes={"o": 400}).timeseries.filter("sm_flagged").first()
    assert a.accepted == 12.0 and b.accepted is None


def test_stream_flags(spark, tmp_path):
    series(spark, [1, None, 99]).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "s"))
    q = row_flags(stream, {"v": (0, 50)}).writeStream.format("memory").queryName("flags").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.flagged for r in spark.table("flags").collect()) == [False, True, True]


def test_sliding_checks_over_blocks_equal_whole_series(spark):
    rnd = random.Random(4)
    rows = [("S", v, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), None if rnd.random() < 0.1 else 5.0 if 100 < i < 190 else 5.0 + 1e-9 * rnd.random() if i < 60 else rnd.gauss(0, 1) * (30 if rnd.random() < 0.02 else 1)) for v in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "station string, variable string, ts timestamp_ntz, value double")
    whole, cut = checks._sliding(df, 6.0, 24.0), checks._sliding(df, 6.0, 24.0, block_rows=37)
    key = lambda x: sorted((r.variable, r.ts, r.variance, r.zscore) for r in x.collect())
    got = key(whole)
    assert got == key(cut) and len(got) == 1400

    def windows(v, k):
        return [np.array([x for x in v[max(0, i - k // 2) : i + (k - 1) // 2 + 1] if x is not None and not np.isnan(x)]) for i in range(len(v))]

    for name in "ab":
        v = [r[3] for r in rows if r[1] == name]
        flat = [len(x) >= 12 and x.var(ddof=1) <= 1e-12 for x in windows(v, 36)]
        off = [np.nan if x is None or len(w) < 48 else x - np.median(w) for x, w in zip(v, windows(v, 144))]
        mad = [np.median(np.abs(w)) if len(w) >= 48 else 0 for w in windows(off, 144)]
        far = [bool(m) and abs(0.6745 * o / m) >= 4 for o, m in zip(off, mad)]
        assert [(r[2], r[3]) for r in got if r[0] == name] == list(zip(flat, far)) and any(flat) and any(far)


def test_gaussian_trend_with_missing_start(spark):
    values = [None, None, 2.0, None, 4.0, 4.0, None]
    df = spark.createDataFrame([("S", "a", dt.datetime(2024, 1, 1, i), v) for i, v in enumerate(values)], "station string, variable string, ts timestamp_ntz, value double")
    full = [2.0, 2.0, 2.0, 2.0, 4.0, 4.0, 4.0]
    w = smooth.kernel(1)
    want = [sum(x * full[min(6, max(0, i + j - len(w) // 2))] for j, x in enumerate(w)) for i in range(7)]
    got = [r.trend for r in smooth.gaussian_trend(df, 1).orderBy("ts").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12
    by_hours = smooth.gaussian_trend_hours(df, 1.0).orderBy("ts").collect()
    assert [r.trend for r in by_hours] == got


def test_local_regression_equals_row_by_row(spark):
    rng = np.random.default_rng(2)
    days = np.sort(rng.uniform(0, 700, 500))
    x = np.column_stack([np.ones(500), days, np.sin(days / 58), np.cos(days / 58), rng.gamma(2, 3, 500)])
    y = 3 + 0.01 * days + 2 * x[:, 2] + 0.3 * x[:, 4] + rng.normal(0, 0.3, 500)
    for q, columns in ((None, x[:, :4]), (x[:, 4], x), (None, np.column_stack([x[:, :3], x[:, 2]]))):  # the last has two equal columns
        got = regress._predict(days, columns, y, q, 5.0, np.ones(500, bool), 90.0, 30)
        for i in range(0, 500, 23):
            w = np.exp(-(((days - days[i]) / 90) ** 2)) * (1 if q is None else np.exp(-(((q - q[i]) / 5.0) ** 2)))
            use = w > 1e-3
            if use.sum() < 30:
                assert np.isnan(got[i])
                continue
            beta = np.linalg.lstsq(columns[use] * w[use, None], y[use] * w[use], rcond=None)[0]
            assert abs(got[i] - columns[i] @ beta) < 1e-6


def test_bands_and_slopes_over_blocks_equal_whole_series(spark):
    rng = np.random.default_rng(8)
    v = [None if rng.random() < 0.05 else 8 + x for x in rng.normal(0, 0.3, 1500)]
    v[700], v[999] = 20.0, 25.0
    df = series(spark, v)
    key = lambda x: [(r.ts, r.flag_reason, r.mask_pre, r.masked) for r in x.orderBy("ts").collect()]
    whole, cut = key(bands.detect(df, 400)), key(bands.detect(df, 400, block_rows=131))
    assert whole == cut and len(whole) == 1500 and any("flag_run1" in r[1] for r in whole)
    slopes = [[r.slope for r in runs.rolling_slope(df, block_rows=n).orderBy("ts").collect()] for n in (50_000, 41)]
    assert slopes[0] == pytest.approx(slopes[1], abs=1e-12) and len(slopes[0]) == 1500


def test_band_export_keeps_each_row_of_a_time(spark, tmp_path):
    path, name = tmp_path / "in.csv", "SurfaceWaterpH [pH]"
    rows = [(START + dt.timedelta(minutes=15 * i), 7.0 + i % 2 * 0.01) for i in range(60)]
    rows[30:30] = [(rows[30][0], 12.0)]  # a spike that shares its time with a good value
    shuffled = random.Random(1).sample([r for r in rows if r != rows[30] and r != rows[31]], 59) + [rows[30], rows[31]]
    path.write_text("\n".join([f"timestamp,{name}", *(f"{t.isoformat()},{x}" for t, x in shuffled)]))
    got = spark.read.csv(run_bands_file(spark, str(path), str(tmp_path / "out"), codes={name: 410}, offsets={name: 0.5, "absent": 1.0}), header=True).collect()
    assert [r["timestamp"] for r in got] == [t.isoformat() for t, _ in rows]
    assert [float(r[name]) for r in got] == pytest.approx([x + 0.5 for _, x in rows])
    flags = [r["SurfaceWaterpH_pH__flag_global"] for r in got]
    assert flags[30] == "200" and flags.count("200") < 10 and flags[31] in ("100", "200")
    both = (START + dt.timedelta(minutes=15 * 10)).isoformat(), (START + dt.timedelta(minutes=15 * 19)).isoformat()
    assert spark.read.csv(run_bands_file(spark, str(path), str(tmp_path / "cut"), *both, codes={name: 410}), header=True).count() == 10
    plain = spark.read.csv(run_bands_file(spark, str(path), str(tmp_path / "plain"), codes={"absent": 410}), header=True)
    assert plain.columns == ["timestamp", name] and plain.count() == 61
