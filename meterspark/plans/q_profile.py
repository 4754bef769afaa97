"""Queries: profiles, aggregates, correlations and chart data (A-*, K-*, V-*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.numeric import rnd, rnd_sql
from ..operators import plotdata as pdata
from ..operators import profile as pf
from ..sources import roles
from ..sources.roles import with_roles
from .registry import query

READ = roles.readings_sql()
READ_Z = roles.readings_sql(zeros=True)
READ_N = roles.readings_sql(nulls=True)
PB = roles.part_buildings_sql()
B = roles.buildings_sql()


def _readings_parts(spark, sf_dir):
    r = roles.readings(spark, sf_dir, nulls=True)
    return r.join(roles.part_buildings(spark, sf_dir).withColumnRenamed("building_id", "l_partkey"), "l_partkey", "left")


_RP_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "building_id", "meter", "ts", "meter_reading",
            "primary_use", "floor_count", "square_feet"]


@query("missing_table", sql=with_roles(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS volume, "
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*) AS percent FROM rp" for c in _RP_COLS),
    r=READ_N, pb=PB, rp="SELECT r.*, pb.primary_use, pb.floor_count, pb.square_feet FROM r LEFT JOIN pb ON pb.building_id = r.l_partkey"))
def missing_table(spark, sf_dir):
    return pf.missing_table(_readings_parts(spark, sf_dir), _RP_COLS)


_LEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_lengths", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
    f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS n_cols"
    for t in _LEN_TABLES))
def table_lengths(spark, sf_dir):
    return pf.table_lengths({t: roles.table(spark, sf_dir, t) for t in _LEN_TABLES})


@query("top_variation", sql=with_roles(
    f"SELECT building_id, {rnd_sql('stddev_samp(meter_reading)', 6)} AS std_dev FROM r GROUP BY 1 "
    "ORDER BY stddev_samp(meter_reading) DESC NULLS LAST, building_id LIMIT 2", r=READ))
def top_variation(spark, sf_dir):
    top = pf.top_variation(roles.readings(spark, sf_dir), "building_id", "meter_reading", 2)
    return top.select("building_id", rnd("std_dev", 6).alias("std_dev"))


_W_COLS = ["air_temperature", "dew_temperature", "wind_speed"]


def _stats_by_column_sql() -> str:
    parts = []
    for c in _W_COLS:
        r = lambda e: rnd_sql(e, 3)
        parts.append(
            f"SELECT '{c}' AS column_name, {r(f'min({c})')} AS min, {r(f'avg({c})')} AS mean, "
            f"{r(f'stddev_samp({c})')} AS std, {r(f'median({c})')} AS median, "
            f"{r(f'avg(abs({c} - (SELECT avg({c}) FROM w)))')} AS mad, {r(f'max({c})')} AS max FROM w")
    return with_roles(" UNION ALL ".join(parts), w=roles.weather_sql())


@query("stats_by_column", sql=_stats_by_column_sql())
def stats_by_column(spark, sf_dir):
    return pf.stats_by_column(roles.weather(spark, sf_dir), _W_COLS)


def _mode_sql(rel: str, by: str, value: str) -> str:
    return (f"SELECT {by}, {value} AS mode FROM (SELECT {by}, {value}, row_number() OVER "
            f"(PARTITION BY {by} ORDER BY count(*) DESC, {value}) AS rn FROM {rel} WHERE {value} IS NOT NULL "
            f"GROUP BY {by}, {value}) WHERE rn = 1")


def _assess_sql(rel: str, by: str, value: str) -> str:
    def fin(e):
        return rnd_sql(f"coalesce(CAST({e} AS DOUBLE), 0.0::DOUBLE)", 2)
    return (f"SELECT s.{by}, CAST(count(*) AS BIGINT) AS count, CAST(trunc({fin(f'min(s.{value})')}) AS BIGINT) AS min, "
            f"{fin(f'avg(s.{value})')} AS mean, {fin(f'stddev_samp(s.{value})')} AS std, "
            f"CAST(trunc({fin('any_value(m.mode)')}) AS BIGINT) AS mode, CAST(trunc({fin(f'max(s.{value})')}) AS BIGINT) AS max "
            f"FROM {rel} s LEFT JOIN ({_mode_sql(rel, by, value)}) m USING ({by}) GROUP BY s.{by}")


@query("assess_by_category", sql=with_roles(_assess_sql("pb", "primary_use", "floor_count"), pb=PB))
def assess_by_category(spark, sf_dir):
    return pf.assess_by_category(roles.part_buildings(spark, sf_dir), "primary_use", "floor_count")


@query("missing_by_category", sql=with_roles("""
SELECT primary_use, volume, volume / n AS perc_row_total,
  coalesce(CASE WHEN sum(volume) OVER () = 0 THEN NULL ELSE volume / sum(volume) OVER () END, 0.0) AS perc_col_total
FROM (SELECT primary_use, count(*) FILTER (WHERE floor_count IS NULL) AS volume, count(*) AS n FROM pb GROUP BY 1)""", pb=PB))
def missing_by_category(spark, sf_dir):
    return pf.missing_by_category(roles.part_buildings(spark, sf_dir), "primary_use", "floor_count")


@query("freq_by_category", sql=with_roles(
    "SELECT meter, site_id, CAST(month(ts) AS INTEGER) AS month, count(*) AS freq FROM r JOIN b USING (building_id) "
    "WHERE meter_reading = 0 GROUP BY 1, 2, 3", r=READ_Z, b=B))
def freq_by_category(spark, sf_dir):
    r = roles.readings(spark, sf_dir, zeros=True).join(roles.buildings(spark, sf_dir), "building_id")
    zeros = r.where(F.col("meter_reading") == 0).withColumn("month", F.month("ts"))
    return pf.freq_by_category(zeros, ["meter", "site_id"], "month")


@query("avg_by_category", sql=with_roles(
    f"SELECT meter, primary_use, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {rnd_sql('avg(meter_reading)', 6)} AS avg_meter_reading "
    "FROM r JOIN pb ON pb.building_id = r.l_partkey GROUP BY 1, 2, 3", r=READ, pb=PB))
def avg_by_category(spark, sf_dir):
    pb = roles.part_buildings(spark, sf_dir).withColumnRenamed("building_id", "l_partkey")
    r = roles.readings(spark, sf_dir).join(pb, "l_partkey").withColumn("day_of_week", F.weekday("ts"))
    out = pf.avg_by_category(r, ["meter", "primary_use"], "day_of_week", "meter_reading")
    return out.withColumn("avg_meter_reading", rnd("avg_meter_reading", 6))


@query("naive_mode_accuracy", sql=with_roles(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE m.mode = d.floor_count) AS n_correct,
  count(*) FILTER (WHERE m.mode = d.floor_count) / count(*) AS accuracy
FROM (SELECT * FROM pbs WHERE floor_count IS NOT NULL) d
LEFT JOIN ({_assess_sql('(SELECT * FROM pbs WHERE train_val_split = 0)', 'primary_use', 'floor_count')}) m USING (primary_use)""",
    pb=PB, pbs=f"SELECT pb.*, {exprs.split_flag_sql(['building_id'], 3)} AS train_val_split FROM pb"))
def naive_mode_accuracy(spark, sf_dir):
    pb = roles.part_buildings(spark, sf_dir).withColumn("train_val_split", exprs.split_flag(["building_id"], 3))
    return pf.naive_mode_accuracy(pb, "primary_use", "floor_count")


_BOUNDS = [10, 20, 50, 100]


@query("count_intervals", sql="""
SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END AS bucket,
  count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY 1""")
def count_intervals(spark, sf_dir):
    return pf.count_intervals(roles.table(spark, sf_dir, "events"), "value", _BOUNDS)


@query("interval_bar", sql=f"""
SELECT bucket, count, {exprs.human_format_sql('count')} AS label FROM (
  SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END AS bucket,
    count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def interval_bar(spark, sf_dir):
    """V8: interval counts with human-readable bar labels."""
    c = pf.count_intervals(roles.table(spark, sf_dir, "events"), "value", _BOUNDS)
    return c.withColumn("label", exprs.human_format("count"))


@query("aggregate_by_field", sql=with_roles(
    f"SELECT building_id, meter, {rnd_sql('sum(meter_reading)', 6)} AS meter_reading_sum, "
    f"{rnd_sql('avg(meter_reading)', 6)} AS meter_reading_mean, max(meter_reading) AS meter_reading_max, "
    "count(meter_reading) AS meter_reading_count FROM r GROUP BY 1, 2", r=READ))
def aggregate_by_field(spark, sf_dir):
    out = pf.aggregate_by_field(roles.readings(spark, sf_dir), ["building_id", "meter"], ["meter_reading"],
                                ["sum", "mean", "max", "count"])
    return out.withColumn("meter_reading_sum", rnd("meter_reading_sum", 6)) \
        .withColumn("meter_reading_mean", rnd("meter_reading_mean", 6))


@query("zero_share_rollup", sql=with_roles("""
SELECT meter, CAST(grouping(meter) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE meter_reading = 0) AS zeros,
  count(*) FILTER (WHERE meter_reading = 0) / count(*) AS zero_share FROM r GROUP BY ROLLUP (meter)""", r=READ_Z))
def zero_share_rollup(spark, sf_dir):
    return pf.zero_share_rollup(roles.readings(spark, sf_dir, zeros=True), "meter", "meter_reading")


@query("meter_extremes", sql=with_roles(
    f"SELECT meter, max(meter_reading) AS max_value, {rnd_sql('stddev_samp(meter_reading)', 6)} AS std_value, "
    "count(DISTINCT building_id) AS n_entities FROM r GROUP BY 1", r=READ))
def meter_extremes(spark, sf_dir):
    out = pf.extremes_by_group(roles.readings(spark, sf_dir), "meter", "meter_reading", "building_id")
    return out.withColumn("std_value", rnd("std_value", 6))


@query("median_by_time_key", sql=with_roles(
    "SELECT ts, site_id, median(meter_reading) AS median_meter_reading FROM r JOIN b USING (building_id) GROUP BY 1, 2",
    r=READ, b=B))
def median_by_time_key(spark, sf_dir):
    r = roles.readings(spark, sf_dir).join(roles.buildings(spark, sf_dir), "building_id")
    return pf.median_by_keys(r, ["ts", "site_id"], "meter_reading", "median_meter_reading")


@query("median_by_time_meter", sql=with_roles(
    "SELECT ts, meter, median(meter_reading) AS median_meter_reading FROM r GROUP BY 1, 2", r=READ))
def median_by_time_meter(spark, sf_dir):
    return pf.median_by_keys(roles.readings(spark, sf_dir), ["ts", "meter"], "meter_reading", "median_meter_reading")


@query("date_coverage_diff", sql="""
WITH d1 AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
d2 AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT (SELECT count(*) FROM d1) AS n_dates_1, (SELECT count(*) FROM d2) AS n_dates_2,
  (SELECT count(*) FROM d1 WHERE d NOT IN (SELECT d FROM d2)) AS missing_in_2,
  (SELECT count(*) FROM d2 WHERE d NOT IN (SELECT d FROM d1)) AS missing_in_1,
  (SELECT count(*) FROM d1 WHERE d NOT IN (SELECT d FROM d2)) = 0 AND (SELECT count(*) FROM d2 WHERE d NOT IN (SELECT d FROM d1)) = 0 AS equal""")
def date_coverage_diff(spark, sf_dir):
    return pf.date_coverage_diff(roles.table(spark, sf_dir, "lineitem"), "l_shipdate",
                                 roles.table(spark, sf_dir, "orders"), "o_orderdate")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols, cond: str = "true", raw: bool = False) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {i} AS i, {j} AS j, {f'corr({a}, {b})' if raw else rnd_sql(f'corr({a}, {b})', 6)} AS corr, "
                         f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM lineitem")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {cond}"


def _corr_spark(spark, sf_dir, cols):
    m = pf.corr_matrix(roles.table(spark, sf_dir, "lineitem"), cols)
    return m.select("var1", "var2", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                    rnd("corr", 6).alias("corr"), "n")


@query("corr_matrix", sql=_corr_sql(_CORR_COLS))
def corr_matrix(spark, sf_dir):
    return _corr_spark(spark, sf_dir, _CORR_COLS)


@query("corr_lower_triangle", sql=_corr_sql(_CORR_COLS, "i >= j"))
def corr_lower_triangle(spark, sf_dir):
    return _corr_spark(spark, sf_dir, _CORR_COLS).where(F.col("i") >= F.col("j"))


_TOPK_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]


@query("corr_topk", sql="WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, l_extendedprice) AS r FROM lineitem" for f in _TOPK_FEATURES) + f""")
SELECT feature, {rnd_sql('r', 6)} AS corr, 'positive' AS direction FROM (SELECT * FROM c ORDER BY r DESC NULLS LAST, feature LIMIT 5)
UNION ALL
SELECT feature, {rnd_sql('r', 6)} AS corr, 'negative' AS direction FROM (SELECT * FROM c ORDER BY r ASC NULLS LAST, feature LIMIT 5)""")
def corr_topk(spark, sf_dir):
    out = pf.corr_topk(roles.table(spark, sf_dir, "lineitem"), "l_extendedprice", _TOPK_FEATURES, 5)
    return out.withColumn("corr", rnd("corr", 6))


def _significance_sql(cols, level: float = 0.05) -> str:
    """r, n and t by their definitions; p by a midpoint rule over 20,000 steps on the density of r, as far as it matters."""
    k = len(cols)
    step = "least(1 - {low}, 12 / sqrt(n)) / 20000"
    area = f"(SELECT sum(exp((n - 4) / 2.0 * ln(1 - pow({{low}} + {step} * (g + 0.5), 2)))) * {step} FROM range(0, 20000) t(g))"
    return f"""
WITH m AS ({_corr_sql(cols, raw=True)}),
c AS (SELECT var1, var2, i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE corr END AS corr, n FROM m),
p AS (SELECT *, CASE WHEN abs(corr) < 1 THEN corr * sqrt((n - 2) / (1 - corr * corr)) END AS t,
  CASE WHEN abs(corr) < 1 THEN {area.format(low='abs(corr)')} / {area.format(low='0.0::DOUBLE')} ELSE 0.0 END AS p FROM c)
SELECT var1, var2, i, j, {rnd_sql('corr', 6)} AS corr, n, {rnd_sql('t', 4)} AS t_stat, {rnd_sql('p', 6)} AS p_value,
  p <= {level} AND p <> 0 AS significant, (SELECT count(*) FROM p WHERE i < j AND p <= {level} AND p <> 0) / {k * (k - 1) // 2} AS share_significant
FROM p"""


@query("corr_significance", sql=_significance_sql(_CORR_COLS))
def corr_significance(spark, sf_dir):
    out = pf.corr_significance(roles.table(spark, sf_dir, "lineitem"), _CORR_COLS)
    return out.withColumn("corr", rnd("corr", 6)).withColumn("t_stat", rnd("t_stat", 4)).withColumn("p_value", rnd("p_value", 6))


# --------------------------------------------------------------------------- K / V
@query("sorted_bar", sql=f"""
SELECT l_suppkey, {rnd_sql('a', 6)} AS avg_l_extendedprice,
  CAST(row_number() OVER (ORDER BY a DESC NULLS LAST, l_suppkey) AS BIGINT) AS rank
FROM (SELECT l_suppkey, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1)""")
def sorted_bar(spark, sf_dir):
    out = pdata.sorted_bar(roles.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    return out.select("l_suppkey", rnd("avg_l_extendedprice", 6).alias("avg_l_extendedprice"),
                      F.col("rank").cast("bigint").alias("rank"))


def _hist_sql(expr: str, bins: int) -> str:
    return f"""
WITH x AS (SELECT CAST({expr} AS DOUBLE) AS x FROM events WHERE {expr} IS NOT NULL),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM x),
c AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) / (mx - mn) * {bins}), {bins - 1}) END AS INTEGER) AS bin,
             count(*) AS count FROM x, r GROUP BY 1),
b AS (SELECT CAST(g AS INTEGER) AS bin, mn, mx FROM r, range(0, {bins}) t(g))
SELECT b.bin, {rnd_sql('mn + b.bin * ((mx - mn) / ' + str(bins) + ')', 6)} AS lo,
  {rnd_sql('mn + (b.bin + 1) * ((mx - mn) / ' + str(bins) + ')', 6)} AS hi, coalesce(c.count, 0) AS count
FROM b LEFT JOIN c USING (bin)"""


def _hist_spark(spark, sf_dir, col, bins):
    h = pdata.histogram(roles.table(spark, sf_dir, "events"), col, bins)
    return h.select("bin", rnd("lo", 6).alias("lo"), rnd("hi", 6).alias("hi"), "count")


@query("histogram", sql=_hist_sql("value", 20))
def histogram(spark, sf_dir):
    return _hist_spark(spark, sf_dir, "value", 20)


@query("histogram_log1p", sql=_hist_sql("ln(1 + value)", 20))
def histogram_log1p(spark, sf_dir):
    return _hist_spark(spark, sf_dir, F.log1p("value"), 20)


_GRID = 50


def _density_sql(expr: str) -> str:
    return f"""
WITH ev AS (SELECT event_type, {expr} AS value FROM events),
s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS mn, max(value) AS mx
           FROM ev WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT event_type, n, h, mn - 3.0 * h AS lo, (mx - mn + 6.0 * h) / {_GRID - 1} AS step FROM s WHERE h > 0),
g AS (SELECT p.*, CAST(t.g AS INTEGER) AS g FROM p, range(0, {_GRID}) t(g))
SELECT g.event_type, g.g, {rnd_sql('any_value(g.lo + g.g * g.step)', 6)} AS x,
  {rnd_sql(f'sum(exp(-0.5 * pow((g.lo + g.g * g.step - e.value) / g.h, 2))) / (any_value(g.n) * any_value(g.h) * {math.sqrt(2 * math.pi)!r})', 6)} AS density
FROM g JOIN ev e USING (event_type) GROUP BY g.event_type, g.g"""


def _density_spark(ev):
    d = pdata.density_by_category(ev, "event_type", "value", _GRID)
    return d.select("event_type", F.col("g").cast("int").alias("g"), rnd("x", 6).alias("x"), rnd("density", 6).alias("density"))


@query("density_by_category", sql=_density_sql("value"))
def density_by_category(spark, sf_dir):
    return _density_spark(roles.table(spark, sf_dir, "events"))


@query("density_log1p", sql=_density_sql("ln(1 + value)"))
def density_log1p(spark, sf_dir):
    """V3: kernel density of log1p(value) per category."""
    ev = roles.table(spark, sf_dir, "events").select("event_type", F.log1p("value").alias("value"))
    return _density_spark(ev)


@query("regr_line", sql=with_roles(
    f"SELECT l_returnflag, {rnd_sql('regr_slope(p, y)', 6)} AS slope, {rnd_sql('regr_intercept(p, y)', 4)} AS intercept, "
    "CAST(regr_count(p, y) AS BIGINT) AS n FROM pr GROUP BY 1", pr=roles.predictions_sql()))
def regr_line(spark, sf_dir):
    out = pdata.regr_line(roles.predictions(spark, sf_dir), "y", "p", ["l_returnflag"])
    return out.select("l_returnflag", rnd("slope", 6).alias("slope"), rnd("intercept", 4).alias("intercept"),
                      F.col("n").cast("bigint").alias("n"))


_PKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("scatter_points", sql=with_roles(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, p, (SELECT min(y) FROM pr) AS y_min, (SELECT max(y) FROM pr) AS y_max "
    "FROM pr", pr=roles.predictions_sql()))
def scatter_points(spark, sf_dir):
    # Every complete point, as the source plots them; the operator's fraction is an option for huge tables.
    return pdata.scatter_points(roles.predictions(spark, sf_dir), "y", "p", _PKEYS, fraction=1.0)
