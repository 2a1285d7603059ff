"""Queries of the library's own operators over the driver's tables, each with the same in SQL.

The series are the rows of `events` by event type, with codes, zeros, plateaus and holes put in by the same expression on
both sides, and the order and shipping dates of `orders` and `lineitem`, of which many rows share a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsqc.functions.core import SERIES, sanitized, season
from tsqc.operators import bands, checks, clean, project, regress, runs, smooth, stats, time_ops
from tsqc.operators.positions import over_blocks, with_pos, with_pos_by_day
from tsqc.plans import figdata
from tsqc.plans.pipeline import run as run_pipeline
from tsqc.plans.config import Settings
from tsqc.sources.readers import first_per_time, long_from, to_long
from tsqc.sources.writers import to_wide

TYPES = ["click", "error", "purchase", "signup", "view"]
#: One sensor code for each event type.
CODES = {"click": 400, "error": 410, "purchase": 157787, "signup": 2477034, "view": 2477787}
RANGES = {"click": (1.0, 120.0), "error": (None, 100.0), "purchase": (0.5, None)}
INJECTED = "CASE WHEN event_id % 97 = 0 THEN -9999.0 WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 400 < 20 THEN 0.0 WHEN event_id % 1000 BETWEEN 500 AND 620 THEN 12.5 ELSE value END"
CLEANED = "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 400 < 20 THEN 0.0 WHEN event_id % 1000 BETWEEN 500 AND 620 THEN 12.5 ELSE value END"

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PREFIX + sql
        return f

    return add


def _events(spark: SparkSession, d: str, value: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").withColumn("v", F.expr(value))
    return long_from(df, "event_type", "ts", "v")


def plain(spark, d):
    return _events(spark, d, "value")


def injected(spark, d):
    return _events(spark, d, INJECTED)


def cleaned(spark, d):
    return _events(spark, d, CLEANED)


def orders(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    return long_from(df, "o_orderpriority", "o_orderdate", "o_totalprice")


def lines(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    return long_from(df, "l_returnflag", "l_shipdate", "l_extendedprice")


def daily(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderdate").alias("ts")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return long_from(df.withColumn("name", F.lit("price")), "name", "ts", "v")


S = "'S1' AS station"
PREFIX = f"""
WITH plain AS (SELECT {S}, event_type AS variable, ts, value FROM events),
injected AS (SELECT {S}, event_type AS variable, ts, ({INJECTED})::DOUBLE AS value FROM events),
cleaned AS (SELECT {S}, event_type AS variable, ts, ({CLEANED})::DOUBLE AS value FROM events),
ords AS (SELECT {S}, o_orderpriority AS variable, o_orderdate AS ts, o_totalprice AS value FROM orders),
lns AS (SELECT {S}, l_returnflag AS variable, l_shipdate AS ts, l_extendedprice AS value FROM lineitem),
daily AS (SELECT {S}, 'price' AS variable, o_orderdate AS ts, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderdate),
cpos AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY ts) - 1 AS pos FROM cleaned),
steps AS (SELECT variable, CASE WHEN count(*) >= 3 THEN coalesce(floor(quantile_cont(d, 0.5) FILTER (WHERE d > 0))::BIGINT, 900000000) ELSE 900000000 END AS step_us
    FROM (SELECT variable, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY variable ORDER BY ts)) AS d FROM cleaned) GROUP BY variable),
gapped AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY variable ORDER BY ts)) > 7200000000, false) AS is_gap FROM cleaned),
nulled AS (SELECT station, variable, ts, CASE WHEN NOT is_gap THEN value END AS value FROM gapped)
"""


def bounds(source: str, mask: str, mode: str = "compat") -> str:
    """CTEs of runs of a mask: m (rows with pos and mask) and r (start_pos, len)."""
    m = f"m AS (SELECT *, row_number() OVER o - 1 AS pos, coalesce({mask}, false) AS x FROM ({source}) WINDOW o AS (PARTITION BY variable ORDER BY ts))"
    c = "c AS (SELECT *, coalesce(x <> lag(x) OVER o, true) AS c FROM m WINDOW o AS (PARTITION BY variable ORDER BY ts))"
    if mode == "islands":
        return f", {m}, {c}, g AS (SELECT *, sum(c::INT) OVER (PARTITION BY variable ORDER BY ts) AS g FROM c), r AS (SELECT variable, min(pos) AS start_pos, count(*) AS len FROM g WHERE x GROUP BY variable, g.g)"
    return f""", {m}, {c}, b AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY variable ORDER BY ts), true) AS c1 FROM c),
n AS (SELECT *, lead(pos) OVER (PARTITION BY variable ORDER BY pos) - pos AS len FROM b WHERE c <> c1), r AS (SELECT variable, pos AS start_pos, len FROM n WHERE x AND len IS NOT NULL)"""


EQUALS = "SELECT *, abs(value - lag(value) OVER (PARTITION BY variable ORDER BY ts)) <= 0 AS eq FROM "
ZERO = "abs(value) <= 1e-12"
SLOPES = """SELECT *, CASE WHEN count(value) OVER w >= 8 THEN regr_slope(value, sec) OVER w END AS slope FROM
(SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY variable)) / 1e6 AS sec FROM nulled)
WINDOW w AS (PARTITION BY variable ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"""


def placed(mode: str = "compat", value: str = "a.value") -> str:
    """Runs with their times, in hours of two at least."""
    past = "r.start_pos + r.len" + (" - 1" if mode == "islands" else "")
    return f""", t AS (SELECT a.variable, r.start_pos, r.len, a.ts AS start, z.ts AS "end", {value} AS value, (epoch_us(z.ts) - epoch_us(a.ts)) / 3600000000.0 AS hours
FROM r JOIN (SELECT variable, max(pos) AS last FROM m GROUP BY variable) l USING (variable) JOIN m a ON a.variable = r.variable AND a.pos = r.start_pos
JOIN m z ON z.variable = r.variable AND z.pos = least({past}, l.last)), f AS (SELECT * FROM t WHERE hours >= 2.0)"""


@query(f"SELECT {S}, variable, step_us FROM steps")
def step_infer(spark, d):
    return time_ops.infer_step(cleaned(spark, d))


@query("SELECT station, variable, ts, is_gap FROM gapped")
def gap_flags(spark, d):
    return time_ops.with_gaps(cleaned(spark, d)).select(*SERIES, "ts", "is_gap")


@query("SELECT station, variable, ts, value FROM nulled")
def gap_nulls(spark, d):
    return time_ops.null_after_gaps(cleaned(spark, d)).select(*SERIES, "ts", "value")


SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
SEASON_SQL = """, src AS (SELECT * FROM {src}), dd AS (SELECT variable, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY variable ORDER BY ts)) AS d FROM src),
st AS (SELECT variable, coalesce(floor(quantile_cont(d, 0.5) FILTER (WHERE d > 0))::BIGINT, 900000000) AS step FROM dd GROUP BY variable),
ag AS (SELECT variable, {season} AS season, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nnan, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM src GROUP BY ALL)
SELECT 'S1' AS station, st.variable, s.season, s.rank::BIGINT AS season_rank,
round(coalesce(100.0 * (n - nnan) / greatest(1, round_even((span + step) / step::DOUBLE, 0)::BIGINT), 0.0), 6) AS coverage_pct, round(coalesce(100.0 * nnan / greatest(1, n), 0.0), 6) AS nan_pct
FROM st CROSS JOIN (VALUES ('DJF', 1), ('MAM', 2), ('JJA', 3), ('SON', 4)) s(season, rank) LEFT JOIN ag ON ag.variable = st.variable AND ag.season = s.season"""


def _season(df):
    return stats.season_stats(df).select(*SERIES, "season", "season_rank", F.round("coverage_pct", 6).alias("coverage_pct"), F.round("nan_pct", 6).alias("nan_pct"))


@query(SEASON_SQL.format(src="nulled", season=SEASON))
def season_coverage(spark, d):
    return _season(time_ops.null_after_gaps(cleaned(spark, d)))


@query(SEASON_SQL.format(src="daily", season=SEASON))
def season_coverage_daily(spark, d):
    return _season(daily(spark, d))


@query(f"SELECT variable, {SEASON} AS season, count(*) AS n FROM ords GROUP BY ALL")
def season_label(spark, d):
    return orders(spark, d).groupBy("variable", season(F.col("ts")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT variable, ts, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY variable)) / 86400000000.0, 6) AS days FROM cleaned")
def elapsed(spark, d):
    return time_ops.elapsed_days(cleaned(spark, d)).select("variable", "ts", F.round("days", 6).alias("days"))


@query("""SELECT station, variable, ts, value, coalesce(used AND value = -9999, false) AS is_sentinel FROM (SELECT station, variable, ts, CASE WHEN value = -9999 AND used THEN NULL ELSE value END AS value, used, value AS raw FROM
(SELECT *, count(*) FILTER (WHERE value = -9999) OVER (PARTITION BY variable) >= 5 OR count(*) FILTER (WHERE value = -9999) OVER (PARTITION BY variable) / (count(*) OVER (PARTITION BY variable))::DOUBLE >= 0.001 AS used FROM injected))""".replace("coalesce(used AND value = -9999, false)", "coalesce(used AND raw = -9999, false)"))
def sentinel_mask(spark, d):
    return clean.mask_sentinels(injected(spark, d)).select(*SERIES, "ts", "value", "is_sentinel")


@query("SELECT station, variable, ts, quantile_cont(value, 0.5) AS value, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n_dup FROM ords GROUP BY ALL")
def dup_median(spark, d):
    return clean.resolve_duplicates(orders(spark, d), "median")


@query("SELECT station, variable, ts, round(avg(value), 6) AS value, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n_dup FROM lns GROUP BY ALL")
def dup_mean(spark, d):
    return clean.resolve_duplicates(lines(spark, d), "mean").withColumn("value", F.round("value", 6))


@query("SELECT station, variable, ts, value FROM (SELECT 'S1' AS station, o_orderpriority AS variable, o_orderdate AS ts, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def dup_first(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    df = df.select(F.lit("S1").alias("station"), F.col("o_orderpriority").alias("variable"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("place"))
    return first_per_time(df, [*SERIES, "ts"], "place").drop("place")


@query("SELECT 'S1' AS station, variable, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS duplicates FROM (SELECT variable, ts, count(*) AS n FROM ords GROUP BY ALL) GROUP BY variable")
def dup_count(spark, d):
    return clean.duplicate_count(orders(spark, d))


def _zero(df):
    return with_pos(df).withColumn("zero", F.coalesce(F.abs("value") <= 1e-12, F.lit(False)))


@query(bounds("SELECT * FROM cleaned", ZERO) + f"SELECT {S}, variable, start_pos, len FROM r")
def rle_compat(spark, d):
    return runs.rle(_zero(cleaned(spark, d)), "zero", "compat").drop("start", "end")


@query(bounds("SELECT * FROM cleaned", ZERO, "islands") + f"SELECT {S}, variable, start_pos, len FROM r")
def rle_islands(spark, d):
    return runs.rle(_zero(cleaned(spark, d)), "zero", "islands").drop("start", "end")


SWITCH = bounds("SELECT * FROM nulled", ZERO) + """, nb AS (SELECT variable, pos, ts, coalesce(lag(ts) OVER o, ts) AS pre, coalesce(lead(ts) OVER o, ts) AS post,
CASE WHEN lag(pos) OVER o IS NULL THEN value ELSE lag(value) OVER o END AS pre_val, CASE WHEN lead(pos) OVER o IS NULL THEN value ELSE lead(value) OVER o END AS post_val FROM m WINDOW o AS (PARTITION BY variable ORDER BY pos)),
sw AS (SELECT a.variable, a.ts AS start, z.ts AS "end", a.pre, z.post, a.pre_val, z.post_val FROM r JOIN nb a ON a.variable = r.variable AND a.pos = r.start_pos JOIN nb z ON z.variable = r.variable AND z.pos = r.start_pos + r.len - 1
WHERE a.pre_val IS NOT NULL AND z.post_val IS NOT NULL AND (a.pre_val <> 0 OR z.post_val <> 0)) """


def nulled(spark, d):
    return time_ops.null_after_gaps(cleaned(spark, d)).select(*SERIES, "ts", "value")


@query(SWITCH + 'SELECT variable, start, "end", pre, post, pre_val, post_val FROM sw')
def binary_switch(spark, d):
    return runs.binary_switches(nulled(spark, d)).select("variable", "start", "end", "pre", "post", "pre_val", "post_val")


@query(bounds(EQUALS + "nulled", "eq") + placed() + 'SELECT variable, start, "end", round(hours, 6) AS hours, value FROM f')
def flat_values(spark, d):
    return runs.flat_values(nulled(spark, d)).select("variable", "start", "end", F.round("hours", 6).alias("hours"), "value")


@query(bounds(EQUALS + "nulled", "eq", "islands") + placed("islands") + 'SELECT variable, start, "end", round(hours, 6) AS hours, value FROM f')
def flat_values_islands(spark, d):
    return runs.flat_values(nulled(spark, d), mode="islands").select("variable", "start", "end", F.round("hours", 6).alias("hours"), "value")


@query(", s AS (" + SLOPES + ") SELECT variable, ts, round(slope, 9) + 0.0 AS slope FROM s")
def rolling_slope(spark, d):
    return runs.rolling_slope(nulled(spark, d)).select("variable", "ts", (F.round("slope", 9) + 0.0).alias("slope"))


@query(bounds(SLOPES, "abs(slope) <= 1e-4") + placed("compat", "0.0") + 'SELECT variable, start, "end", round(hours, 6) AS hours FROM f')
def flat_slopes(spark, d):
    return runs.flat_slopes(nulled(spark, d), abs_slope=1e-4).select("variable", "start", "end", F.round("hours", 6).alias("hours"))


SEASON_RUNS = " SELECT v.variable, s.season, count(f.start) AS events FROM (SELECT DISTINCT variable FROM nulled) v CROSS JOIN (VALUES ('DJF'), ('MAM'), ('JJA'), ('SON')) s(season) LEFT JOIN f ON f.variable = v.variable AND " + SEASON.replace("(ts)", "(f.start)") + " = s.season GROUP BY ALL"


@query(bounds(EQUALS + "nulled", "eq") + placed() + SEASON_RUNS)
def season_flat_values(spark, d):
    df = nulled(spark, d)
    return stats.season_stats(df, flat_values=runs.flat_values(df)).select("variable", "season", F.col("flat_values_events").alias("events"))


@query(bounds(SLOPES, "abs(slope) <= 1e-4") + placed("compat", "0.0") + SEASON_RUNS)
def season_flat_slopes(spark, d):
    df = nulled(spark, d)
    return stats.season_stats(df, flat_slopes=runs.flat_slopes(df, abs_slope=1e-4)).select("variable", "season", F.col("flat_slopes_events").alias("events"))


IN_RUN = bounds(EQUALS + "nulled", "eq") + placed() + "SELECT q.variable, q.ts, EXISTS (SELECT 1 FROM f WHERE f.variable = q.variable AND q.ts BETWEEN f.start AND f.\"end\") AS in_run FROM nulled q"


@query(IN_RUN)
def mask_from_runs(spark, d):
    df = nulled(spark, d)
    return runs.mask_from_runs(df, runs.flat_values(df)).select("variable", "ts", "in_run")


@query(SWITCH + f""", m2 AS (SELECT *, row_number() OVER o - 1 AS pos2, coalesce(eq, false) AS y FROM ({EQUALS} nulled) WINDOW o AS (PARTITION BY variable ORDER BY ts)), sl AS ({SLOPES}),
m3 AS (SELECT *, row_number() OVER o - 1 AS pos2, coalesce(abs(slope) <= 1e-4, false) AS y FROM sl WINDOW o AS (PARTITION BY variable ORDER BY ts)),
mm AS (SELECT 'flat_values' AS type, variable, ts, pos2, y FROM m2 UNION ALL SELECT 'flat_slopes', variable, ts, pos2, y FROM m3),
k AS (SELECT *, coalesce(y <> lag(y) OVER o, true) AS k FROM mm WINDOW o AS (PARTITION BY type, variable ORDER BY pos2)), k1 AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY type, variable ORDER BY pos2), true) AS k1 FROM k),
kr AS (SELECT *, lead(pos2) OVER (PARTITION BY type, variable ORDER BY pos2) AS past FROM k1 WHERE k <> k1), kl AS (SELECT variable, max(pos2) AS last FROM mm GROUP BY variable),
fl AS (SELECT a.type, a.variable, a.ts AS start, z.ts AS "end", (epoch_us(z.ts) - epoch_us(a.ts)) / 3600000000.0 AS hours FROM kr a JOIN kl USING (variable) JOIN mm z ON z.type = a.type AND z.variable = a.variable AND z.pos2 = least(a.past, kl.last) WHERE a.y AND a.past IS NOT NULL)
SELECT variable, 'binary_switch' AS type, start, "end", pre_val, post_val, NULL::DOUBLE AS hours FROM sw UNION ALL SELECT variable, type, start, "end", NULL, NULL, round(hours, 6) FROM fl WHERE hours >= 2""")
def events_union(spark, d):
    return runs.events(nulled(spark, d), abs_slope=1e-4).select("variable", "type", "start", "end", "pre_val", "post_val", F.round("hours", 6).alias("hours"))


DEC = "least(9, greatest(0, " + " + ".join(f"(f >= {i * 0.1!r})::INT" for i in range(1, 10)) + "))"


DEC_SQL = f", f AS (SELECT variable, value % 1.0 AS f FROM cleaned WHERE value IS NOT NULL), b AS (SELECT variable, {DEC} AS bin FROM f), c AS (SELECT v.variable, i.i::INTEGER AS bin, (SELECT count(*) FROM b WHERE b.variable = v.variable AND b.bin = i.i) AS n FROM (SELECT DISTINCT variable FROM f) v CROSS JOIN range(10) i(i))"


@query(DEC_SQL + " SELECT variable, bin, n, round(sum((n - t) * (n - t) / t) OVER (PARTITION BY variable), 6) AS chisq FROM (SELECT *, sum(n) OVER (PARTITION BY variable) / 10.0 AS t FROM c)")
def decimal_hist(spark, d):
    return figdata.decimal_histogram(cleaned(spark, d)).select("variable", "bin", "n", F.round("chisq", 6).alias("chisq"))


@query(f"""{DEC_SQL.replace("cleaned", "ords")}, x AS (SELECT variable, sum((n - t) * (n - t) / t) AS x FROM (SELECT *, sum(n) OVER (PARTITION BY variable) / 10.0 AS t FROM c) GROUP BY variable)
SELECT variable, round(x, 6) AS chisq, round(1 - (SELECT sum(exp((4.5 + k.k) * ln(x / 2) - x / 2 - lgamma(5.5 + k.k))) FROM range(400) k(k)), 9) AS p FROM x""")
def decimal_p(spark, d):
    """The p value; in SQL by the series of the incomplete gamma function."""
    return stats.decimal_histogram(orders(spark, d)).select("variable", F.round("chisq", 6).alias("chisq"), F.round("p", 9).alias("p"))


@query("SELECT variable, dom::INTEGER AS dom, round(n / total::DOUBLE, 9) AS frac FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, dom) AS k, sum(n) OVER (PARTITION BY variable) AS total FROM (SELECT variable, round_even((value % 1.0) * 100, 0) AS dom, count(*) AS n FROM lns WHERE value IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def dominant_decimal(spark, d):
    return stats.dominant_decimal(lines(spark, d)).select("variable", "dom", F.round("frac", 9).alias("frac"))


@query(", df AS (SELECT variable, abs(value - lag(value) OVER (PARTITION BY variable ORDER BY ts)) AS d FROM cleaned), dp AS (SELECT * FROM df WHERE d > 0), q AS (SELECT variable, quantile_cont(d, 0.1) AS a, quantile_cont(d, 0.25) AS b, quantile_cont(d, 0.5) AS c FROM dp GROUP BY variable), cand AS (SELECT variable, 0 AS i, a AS c FROM q UNION ALL SELECT variable, 1, b FROM q UNION ALL SELECT variable, k.k + 1, c / k.k FROM q, range(1, 10) k(k)), s AS (SELECT variable, i, cand.c, avg((abs(d / cand.c - round_even(d / cand.c, 0)) <= 1e-3)::INT) AS s FROM dp JOIN cand USING (variable) GROUP BY ALL) SELECT variable, round(CASE WHEN s > 0.7 THEN c END, 6) AS step, coalesce(s > 0.7, false) AS is_quantized FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY s DESC, i) AS k FROM s) WHERE k = 1")
def quant_step(spark, d):
    return stats.quantization(cleaned(spark, d)).select("variable", F.round("step", 6).alias("step"), "is_quantized")


@query("SELECT variable, ts, coalesce(CASE variable WHEN 'click' THEN value < 1 OR value > 120 WHEN 'error' THEN value > 100 WHEN 'purchase' THEN value < 0.5 ELSE false END, false) AS \"range\" FROM nulled")
def chk_range(spark, d):
    return checks.check_range(nulled(spark, d), RANGES).select("variable", "ts", "range")


@query("SELECT variable, ts, value IS NULL AS missing FROM nulled")
def chk_missing(spark, d):
    return checks.check_missing(nulled(spark, d)).select("variable", "ts", "missing")


@query(IN_RUN.replace("AS in_run FROM", "AS plateau FROM"))
def chk_plateau(spark, d):
    return checks.check_plateau(nulled(spark, d)).select("variable", "ts", "plateau")


def frame(hours: float, share: int, least: int) -> str:
    k = f"greatest(1, round_even({hours * 3600e6} / step_us, 0)::BIGINT)"
    return f", kk AS (SELECT n.*, {k} AS k, greatest({least}, {k} // {share}) AS need FROM nulled n JOIN steps USING (variable))"


FRAME = "PARTITION BY variable ORDER BY ts ROWS BETWEEN (k // 2) PRECEDING AND ((k - 1) // 2) FOLLOWING"


VARIANCE_SQL = frame(6, 3, 3) + f"SELECT variable, ts, coalesce(need <= k AND count(value) OVER w >= need AND var_samp(value) OVER w <= 1e-12, false) AS variance FROM kk WINDOW w AS ({FRAME})"
ZSCORE_CTE = frame(24, 3, 5) + f""", z1 AS (SELECT *, CASE WHEN count(value) OVER w >= need THEN quantile_cont(value, 0.5) OVER w END AS med FROM kk WINDOW w AS ({FRAME})), z2 AS (SELECT *, abs(value - med) AS dev FROM z1),
z3 AS (SELECT *, CASE WHEN count(dev) OVER w >= need THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM z2 WINDOW w AS ({FRAME})), zs AS (SELECT variable, ts, coalesce(need <= k AND abs(0.6745 * (value - med) / nullif(mad, 0)) >= 4, false) AS zscore FROM z3)"""


@query(VARIANCE_SQL)
def chk_variance(spark, d):
    return checks.check_variance(nulled(spark, d)).select("variable", "ts", "variance")


@query(ZSCORE_CTE + "SELECT * FROM zs")
def chk_zscore(spark, d):
    return checks.check_zscore(nulled(spark, d)).select("variable", "ts", "zscore")


@query("SELECT variable, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY variable ORDER BY ts)) >= 5, false) AS jumps FROM nulled")
def chk_jumps(spark, d):
    return checks.check_jumps(nulled(spark, d)).select("variable", "ts", "jumps")


# Gaps of half an hour and groups of an hour on values that keep theirs after gaps, so that groups do get isolated.
ISOLATED = bounds("SELECT * FROM cleaned", "value IS NOT NULL") + """, gp AS (SELECT variable, pos, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY variable ORDER BY pos)) > 1800000000, false) AS gap FROM m),
iso AS (SELECT r.variable, r.start_pos, r.len FROM r JOIN steps USING (variable) JOIN gp a ON a.variable = r.variable AND a.pos = r.start_pos AND a.gap JOIN gp z ON z.variable = r.variable AND z.pos = r.start_pos + r.len AND z.gap
WHERE r.len <= greatest(1, round_even(3600000000.0 / step_us, 0))) SELECT m.variable, m.ts, EXISTS (SELECT 1 FROM iso WHERE iso.variable = m.variable AND m.pos BETWEEN iso.start_pos AND iso.start_pos + iso.len - 1) AS isolated FROM m"""


@query(ISOLATED)
def chk_isolated(spark, d):
    return checks.check_isolated(cleaned(spark, d), gap_hours=0.5, group_hours=1.0).select("variable", "ts", "isolated")


SUITE = ZSCORE_CTE + f""", vr AS (SELECT variable, ts, coalesce(need <= k AND count(value) OVER w >= need AND var_samp(value) OVER w <= 1e-12, false) AS variance
FROM (SELECT n.*, greatest(1, round_even(21600e6 / step_us, 0)::BIGINT) AS k, greatest(3, greatest(1, round_even(21600e6 / step_us, 0)::BIGINT) // 3) AS need FROM nulled n JOIN steps USING (variable)) WINDOW w AS ({FRAME})),
jm AS (SELECT variable, ts, value, coalesce(abs(value - lag(value) OVER (PARTITION BY variable ORDER BY ts)) >= 5, false) AS jumps,
coalesce(CASE variable WHEN 'click' THEN value < 1 OR value > 120 WHEN 'error' THEN value > 100 WHEN 'purchase' THEN value < 0.5 ELSE false END, false) AS rng FROM nulled)""" + bounds(EQUALS + "nulled", "eq") + placed() + """,
pl AS (SELECT q.variable, q.ts, EXISTS (SELECT 1 FROM f WHERE f.variable = q.variable AND q.ts BETWEEN f.start AND f."end") AS plateau FROM nulled q),
su AS (SELECT j.variable, j.ts, j.value, (rng OR jumps OR j.value IS NULL OR variance OR zscore OR plateau) AS suite FROM jm j JOIN vr USING (variable, ts) JOIN zs USING (variable, ts) JOIN pl USING (variable, ts))"""


@query(SUITE + "SELECT variable, ts, suite, CASE WHEN suite THEN 255 ELSE 0 END::INTEGER AS flag FROM su")
def suite_flags(spark, d):
    return checks.suite(nulled(spark, d), RANGES).select("variable", "ts", "suite", "flag")


@query(SUITE + "SELECT su.variable, su.ts, c.value AS raw, su.value AS clean, CASE WHEN NOT suite THEN su.value END AS accepted FROM su JOIN cleaned c USING (variable, ts)")
def accepted(spark, d):
    out = run_pipeline(cleaned(spark, d), Settings(apply_bands=False), RANGES)
    return out.timeseries.select("variable", "ts", "raw", "clean", "accepted")


def _sensor_sql(code: int) -> str:
    return {400: "x IN (30, 25, 0) OR x >= 40 OR x IS NULL", 410: "x = 0 OR x >= 13 OR x IS NULL"}.get(code, "false")


def _band_sql(variable: str, code: int) -> tuple[str, str]:
    """CTEs up to b4, which has the flags, and the columns made of them."""
    from tsqc.plans.config import sensor

    s = sensor(code)
    scale = "* 14.0 / 62.0" if s.nitrate else ""
    back = "* 62.0 / 14.0" if s.nitrate else ""
    cols, flags = [], [f"coalesce({_sensor_sql(code)}, false) AS flag_sensor"]
    for i, p in enumerate(s.passes[:4], 1):
        w = f"(ORDER BY ts ROWS BETWEEN {p.window // 2} PRECEDING AND {(p.window - 1) // 2} FOLLOWING)"
        need = max(3, -(-3 * p.window // 10))
        mean = f"quantile_cont(x, 0.5) OVER {w}" if i == 3 else f"avg(x) OVER {w}"
        cols += [f"CASE WHEN count(x) OVER {w} >= {need} THEN {mean} END AS m{i}", f"CASE WHEN count(x) OVER {w} >= {need} THEN stddev_pop(x) OVER {w} END AS s{i}"]
    parts = [("lag(x, 2) OVER o", 1), ("lag(x) OVER o", 2), ("x", 3), ("lead(x) OVER o", 2), ("lead(x, 2) OVER o", 1)]
    cols += [f"{e} AS t{j}" for j, (e, _) in enumerate(parts)]
    weight = " + ".join(f"CASE WHEN t{j} IS NULL THEN 0.0 ELSE {w}.0 END" for j, (_, w) in enumerate(parts))
    total = " + ".join(f"coalesce(t{j} * {w}, 0.0)" for j, (_, w) in enumerate(parts))
    n = " + ".join(f"(t{j} IS NOT NULL)::INT" for j in range(5))
    var = " + ".join(f"coalesce((t{j} - m5) * (t{j} - m5) * {w}, 0.0)" for j, (_, w) in enumerate(parts))
    tests = []
    for i, p in enumerate(s.passes, 1):
        low, high = (f"x * {1 - s.percent!r}", f"x * {1 + s.percent!r}") if s.percent is not None else (f"x - {s.constant}", f"x + {s.constant}")
        top, bot = f"(m{i} + {p.above} + s{i} * {p.factor})", f"(m{i} - {p.below} - s{i} * {p.factor})"
        tests.append(f"coalesce({low} > {top} AND {high} > {top}, false) OR coalesce({low} < {bot} AND {high} < {bot}, false) AS flag_run{i}")
    p5 = s.passes[4]
    names = ["flag_sensor", *[f"flag_run{i}" for i in range(1, 6)]]
    any_flag = " OR ".join(names)
    reason = "concat_ws(' ', " + ", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in names) + ")"
    ctes = f""", b0 AS (SELECT variable, ts, CASE WHEN value > 0 THEN value END AS raw, CASE WHEN value > 0 THEN value END {scale} AS x FROM injected WHERE variable = '{variable}'),
b1 AS (SELECT *, {", ".join(cols)}, count(x) OVER (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 3 AS sup FROM b0 WINDOW o AS (ORDER BY ts)),
b2 AS (SELECT *, CASE WHEN {n} >= 3 THEN ({total}) / nullif({weight}, 0) END AS m5 FROM b1), b3 AS (SELECT *, CASE WHEN m5 IS NOT NULL THEN sqrt(({var}) / nullif({weight}, 0)) END AS s5 FROM b2),
b4 AS (SELECT *, {", ".join(flags + tests)} FROM b3)"""
    return ctes, f"""{", ".join(names)}, CASE WHEN {any_flag} THEN 200 ELSE 100 END::INTEGER AS flag_global, {reason} AS flag_reason, CASE WHEN NOT ({any_flag}) THEN raw END AS masked,
round(CASE WHEN sup THEN (m5 + {p5.above} + s5 * {p5.factor}) {back} END, 6) AS qcband_top, round(CASE WHEN sup THEN (m5 - {p5.below} - s5 * {p5.factor}) {back} END, 6) AS qcband_bottom"""


def _band_query(name: str, variable: str, code: int):
    def f(spark, d):
        out = bands.detect(injected(spark, d).filter(F.col("variable") == variable), code)
        return out.select("variable", "ts", *bands.FLAGS, "flag_global", "flag_reason", "masked", F.round("qcband_top", 6).alias("qcband_top"), F.round("qcband_bottom", 6).alias("qcband_bottom"))

    ctes, columns = _band_sql(variable, code)
    f.__name__ = name
    query(f"{ctes} SELECT variable, ts, {columns} FROM b4")(f)


for _variable, _code in CODES.items():
    _band_query(f"band_{_code}", _variable, _code)


@query(" UNION ALL ".join(f"(WITH {_band_sql(v, c)[0][2:]} SELECT variable, ts, flag_global, masked FROM (SELECT variable, ts, {_band_sql(v, c)[1]} FROM b4))" for v, c in CODES.items()))
def bands_of_all(spark, d):
    """All sensor codes in one plan."""
    return bands.detect_all(injected(spark, d), CODES).select("variable", "ts", "flag_global", "masked")


@query(_band_sql("click", 400)[0] + f""", fl AS (SELECT variable, ts, {_band_sql("click", 400)[1]} FROM b4),
g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) > 7200000000, false) AS is_gap FROM injected WHERE variable = 'click'),
k AS (SELECT variable, ts, value AS raw, CASE WHEN value <> -9999 AND NOT is_gap THEN value END AS clean FROM g)
SELECT variable, ts, raw, clean, flag_global = 200 AS sm_flagged, CASE WHEN flag_global = 100 THEN clean END AS accepted FROM k JOIN fl USING (variable, ts)""")
def accepted_with_bands(spark, d):
    """The pipeline where bands decide what is accepted."""
    out = run_pipeline(injected(spark, d).filter("variable = 'click'"), Settings(apply_checks=False, accept_uses_bands=True), codes=CODES)
    return out.timeseries.select("variable", "ts", "raw", "clean", "sm_flagged", "accepted")


@query("SELECT variable, min(year(ts)) AS first_year, max(year(ts)) AS last_year FROM lns GROUP BY variable")
def year_span(spark, d):
    return time_ops.years(lines(spark, d)).select("variable", F.col("first_year").cast("long").alias("first_year"), F.col("last_year").cast("long").alias("last_year"))


@query("SELECT variable, round(100 * avg((value > 0)::INT), 6) AS available_pct, round(100 * avg(coalesce(value > 30, false)::INT), 6) AS flagged_pct FROM (SELECT variable, CASE WHEN value > 0 THEN value END AS value FROM injected) GROUP BY variable".replace("avg((value > 0)::INT)", "avg((value IS NOT NULL)::INT)"))
def availability(spark, d):
    df = injected(spark, d).withColumn("value", project.positive_only(F.col("value"))).withColumn("is_flagged", F.coalesce(F.col("value") > 30, F.lit(False)))
    return stats.availability(df).select("variable", F.round("available_pct", 6).alias("available_pct"), F.round("flagged_pct", 6).alias("flagged_pct"))


@query("SELECT variable, round(quantile_cont(value, 0.005), 6) AS floor FROM injected WHERE value > 0 GROUP BY variable")
def low_percentile(spark, d):
    return stats.low_percentile(injected(spark, d)).select("variable", F.round("floor", 6).alias("floor"))


@query(", md AS (SELECT quantile_cont(value, 0.5) AS m FROM daily), mm AS (SELECT quantile_cont(abs(value - m), 0.5) AS mad FROM daily, md) SELECT ts, round((value - m) / (1.4826 * mad + 1e-9), 6) AS z, abs((value - m) / (1.4826 * mad + 1e-9)) >= 2.5 AS spike FROM daily, md, mm")
def robust_residual_z(spark, d):
    return regress.residual_outliers(daily(spark, d), "value", 2.5).select("ts", F.round("z", 6).alias("z"), "spike")


def _regression_sql() -> str:
    """The same fit: moments of the rows in reach about each row, elimination of time, sine and cosine, and substitution back."""
    basis = ["1.0", "(j.days - i.days) / 90.0", "j.s", "j.c"]
    moment = [f"sum(w * w * {basis[a]} * {basis[b]}) AS m{a}{b}" for a in range(4) for b in range(a, 4)]
    right = [f"sum(w * w * {basis[a]} * j.value) AS r{a}" for a in range(4)]
    weight = "exp(-pow((j.days - i.days) / 90.0, 2))"
    sql = f""", o AS (SELECT min(epoch_us(ts)) AS first_us FROM daily), d AS (SELECT ts, value, (epoch_us(ts) - first_us) / 86400000000.0 AS days,
      sin(2 * pi() * dayofyear(ts) / 365.25) AS s, cos(2 * pi() * dayofyear(ts) / 365.25) AS c FROM daily, o),
    l0 AS (SELECT i.ts, i.s, i.c, {", ".join(moment + right)} FROM (SELECT i.ts AS its, j.ts AS jts, {weight} AS w FROM d i JOIN d j ON j.days BETWEEN i.days - {regress.reach()!r} AND i.days + {regress.reach()!r}) x
      JOIN d i ON i.ts = x.its JOIN d j ON j.ts = x.jts WHERE w > 1e-3 AND j.value IS NOT NULL AND i.value IS NOT NULL GROUP BY i.ts, i.s, i.c HAVING count(*) >= 30)"""
    m = lambda a, b: f"m{min(a, b)}{max(a, b)}"
    back, left = [], [0, 1, 2, 3]
    for level, p in enumerate((1, 2, 3)):
        left = [a for a in left if a != p]
        new = [f"{m(a, b)} - {m(a, p)} * {m(p, b)} / {m(p, p)} AS {m(a, b)}" for a in left for b in left if a <= b] + [f"r{a} - {m(a, p)} * r{p} / {m(p, p)} AS r{a}" for a in left]
        own = [f"r{p} AS y{p}", f"{m(p, p)} AS y{p}{p}"] + [f"{m(a, p)} AS y{p}{a}" for a in left]
        kept = [f"y{q}{x}" for q in (1, 2, 3)[:level] for x in ["", q, *(a for a in (0, 1, 2, 3) if a not in (1, 2, 3)[: (1, 2, 3).index(q) + 1])]]
        sql += f", l{level + 1} AS (SELECT ts, s, c, {', '.join(new + own + kept)} FROM l{level})"
    sql += ", b0 AS (SELECT *, r0 / m00 AS b0 FROM l3), b3 AS (SELECT *, (y3 - y30 * b0) / y33 AS b3 FROM b0), b2 AS (SELECT *, (y2 - y20 * b0 - y23 * b3) / y22 AS b2 FROM b3)"
    sql += ", fitted AS (SELECT daily.ts, value, b0 + b2 * s + b3 * c AS yhat FROM daily LEFT JOIN b2 ON b2.ts = daily.ts), med AS (SELECT quantile_cont(value - yhat, 0.5) AS med FROM fitted), mad AS (SELECT quantile_cont(abs(value - yhat - med), 0.5) AS mad FROM fitted, med)"
    return sql + " SELECT ts, value, round(yhat, 4) AS yhat, coalesce(abs((value - yhat - med) / (1.4826 * mad + 1e-9)) >= 4, false) AS spike FROM fitted, med, mad"


@query(_regression_sql())
def local_regression(spark, d):
    fitted = regress.residual_outliers(regress.local_regression(daily(spark, d)))
    return fitted.select("ts", "value", F.round("yhat", 4).alias("yhat"), "spike")


@query(_regression_sql().replace(" SELECT ts, value, round(yhat, 4) AS yhat, ", " SELECT ts, value, CASE WHEN coalesce(abs((value - yhat - med) / (1.4826 * mad + 1e-9)) >= 4, false) THEN NULL ELSE value END AS accepted, "))
def accepted_with_regression(spark, d):
    """The pipeline where spikes against the local regression aren't accepted."""
    out = run_pipeline(daily(spark, d), Settings(apply_checks=False, apply_bands=False, regression=True, gap_hours=1e9))
    return out.timeseries.select("ts", F.col("raw").alias("value"), "spike", "accepted")


def _gauss_sql(sigma: int) -> str:
    w = smooth.kernel(sigma)
    r = len(w) // 2
    ends = "(PARTITION BY variable ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    terms = " + ".join(
        (f"coalesce(lag(v, {r - i}) OVER o, a)" if i < r else "v" if i == r else f"coalesce(lead(v, {i - r}) OVER o, z)") + f" * {x!r}" for i, x in enumerate(w)
    )
    return f""", g0 AS (SELECT variable, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY variable ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM nulled),
g1 AS (SELECT *, first_value(v) OVER {ends} AS a, last_value(v) OVER {ends} AS z FROM g0) SELECT variable, ts, round({terms}, 6) AS trend FROM g1 WINDOW o AS (PARTITION BY variable ORDER BY ts)"""


@query(_gauss_sql(6))
def gaussian_trend(spark, d):
    return smooth.gaussian_trend(nulled(spark, d), smooth.sigma_points(time_ops.DEFAULT_STEP)).select("variable", "ts", F.round("trend", 6).alias("trend"))


@query("SELECT station, variable, ts, abs(value - lag(value) OVER (PARTITION BY variable ORDER BY ts)) AS abs_diff FROM nulled")
def abs_diff(spark, d):
    return figdata.differences(nulled(spark, d))


@query("SELECT variable, ts, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY variable ORDER BY ts)) > 10 * step_us, false) THEN NULL ELSE value END AS value FROM nulled JOIN steps USING (variable)")
def break_on_gaps(spark, d):
    return time_ops.break_on_gaps(nulled(spark, d)).select("variable", "ts", "value")


@query(", b AS (SELECT variable, date_trunc('hour', ts) AS ts, quantile_cont(value, 0.5) AS value FROM cleaned GROUP BY ALL), e AS (SELECT variable, unnest(range(min(ts), max(ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM b GROUP BY variable) SELECT e.variable, e.ts, b.value FROM e LEFT JOIN b USING (variable, ts)")
def resample_median(spark, d):
    return time_ops.resample_median(cleaned(spark, d), "1 hour").select("variable", "ts", "value")


@query("SELECT variable, ts, round(value + CASE variable WHEN 'click' THEN 0.25 WHEN 'view' THEN -1.5 ELSE 0 END, 6) AS value FROM plain")
def calibrate(spark, d):
    return project.calibrate(plain(spark, d), {"click": 0.25, "view": -1.5}).select("variable", "ts", F.round("value", 6).alias("value"))


@query("SELECT variable, ts, round(value * 14.0 / 62.0, 6) AS n, round((value * 14.0 / 62.0) * 62.0 / 14.0, 6) AS no3 FROM plain")
def unit_convert(spark, d):
    df = plain(spark, d).withColumn("n", project.to_nitrogen(F.col("value")))
    return df.select("variable", "ts", F.round("n", 6).alias("n"), F.round(project.to_nitrate(F.col("n")), 6).alias("no3"))


@query("SELECT p_name, trim(regexp_replace(p_name || ' [' || p_brand || ']*', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM part")
def sanitize_names(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet")
    return df.select("p_name", sanitized(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]*"))).alias("name"))


@query("SELECT variable, ts, value FROM plain WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def time_slice(spark, d):
    return project.between(plain(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select("variable", "ts", "value")


@query("SELECT ts, max(value) FILTER (WHERE variable = 'click') AS click__value, max(value) FILTER (WHERE variable = 'error') AS error__value, max(value) FILTER (WHERE variable = 'view') AS view__value FROM plain WHERE variable IN ('click', 'error', 'view') GROUP BY ts")
def wide_export(spark, d):
    df = plain(spark, d).filter(F.col("variable").isin("click", "error", "view"))
    return to_wide(df, ["value"], ["click", "error", "view"]).drop("station")


@query("SELECT variable, ts, value FROM (SELECT o_orderdate AS ts, 'o_totalprice' AS variable, o_totalprice AS value FROM orders UNION ALL SELECT o_orderdate, 'o_custkey', o_custkey::DOUBLE FROM orders)")
def wide_to_long(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    return to_long(df, ["o_totalprice", "o_custkey", "no_such_column"], ts="o_orderdate").select("variable", "ts", "value")


@query("SELECT variable, ts, pos FROM cpos")
def positions_by_day(spark, d):
    return with_pos_by_day(cleaned(spark, d)).select("variable", "ts", "pos")


@query("SELECT variable, ts, round(avg(value) OVER (PARTITION BY variable ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING), 6) AS mean FROM cleaned")
def block_rolling_mean(spark, d):
    from pyspark.sql import Window

    def make(df, keys):
        w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-24, 23)
        return df.withColumn("mean", F.avg("value").over(w))

    out = over_blocks(with_pos_by_day(cleaned(spark, d)), 24, 23, make, rows=500)
    return out.select("variable", "ts", F.round("mean", 6).alias("mean"))


@query("SELECT variable, step_us, CASE WHEN n9999 >= 5 OR n9999 / n::DOUBLE >= 0.001 THEN '-9999' ELSE '' END AS sentinel_used, 0::BIGINT AS duplicates FROM (SELECT variable, count(*) FILTER (WHERE value = -9999) AS n9999, count(*) AS n FROM injected GROUP BY variable) JOIN steps USING (variable)")
def meta_table(spark, d):
    meta = run_pipeline(injected(spark, d), Settings(apply_bands=False, apply_checks=False)).meta
    return meta.select(F.col("col").alias("variable"), "step_us", F.array_join("sentinel_used", ",").alias("sentinel_used"), "duplicates")
