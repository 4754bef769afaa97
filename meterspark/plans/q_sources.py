"""Queries: scans, encodings, filters, joins (S-*, P-*, F-*, J1-J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import exprs
from ..operators import encode as enc
from ..operators import filters as flt
from ..sources import io, roles
from ..sources.roles import with_roles
from .registry import query

RKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "building_id"]
RKEYS_SQL = ", ".join(RKEYS)
READ = roles.readings_sql()
READ_Z = roles.readings_sql(zeros=True)
READ_N = roles.readings_sql(nulls=True)


# --------------------------------------------------------------------------- S
@query("scan_table", sql="SELECT * FROM lineitem")
def scan_table(spark, sf_dir):
    return io.read_table(spark, f"{sf_dir}/lineitem.parquet", timestamp_cols=["l_shipdate"])


@query("sample_scan", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE {exprs.in_share_sql(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'], 3, 0.1)}""")
def sample_scan(spark, sf_dir):
    df = io.read_table(spark, f"{sf_dir}/lineitem.parquet", sample=0.1,
                       sample_keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], seed=3)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _raw_ts_spark(ev):
    # Three kinds of text: a valid timestamp, a word, an impossible date.
    k = F.col("event_id") % 10
    return F.when(k == 0, F.lit("n/a")).when(k == 1, F.lit("2024-13-45 00:00:00")) \
        .otherwise(F.col("ts").cast("string"))


@query("parse_ts_coerce", sql="""
SELECT event_id, raw, TRY_CAST(raw AS TIMESTAMP) AS parsed FROM (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN event_id % 10 = 1 THEN '2024-13-45 00:00:00'
    ELSE CAST(ts AS VARCHAR) END AS raw FROM events)""")
def parse_ts_coerce(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events")
    raw = ev.select("event_id", _raw_ts_spark(ev).alias("raw"))
    return io.parse_timestamps(raw.withColumn("parsed", F.col("raw")), ["parsed"])


_DOWNCAST_COLS = [("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True),
                  ("l_quantity", False), ("l_extendedprice", False), ("l_discount", False), ("l_tax", False)]


def _downcast_sql() -> str:
    f32 = 3.4028234663852886e38
    parts = []
    for c, is_int in _DOWNCAST_COLS:
        if is_int:
            t = ("CASE WHEN mn > -128 AND mx < 127 THEN 'tinyint' WHEN mn > -32768 AND mx < 32767 THEN 'smallint' "
                 "WHEN mn > -2147483648 AND mx < 2147483647 THEN 'int' ELSE 'bigint' END")
        else:
            t = f"CASE WHEN mn > -{f32}::DOUBLE AND mx < {f32}::DOUBLE THEN 'float' ELSE 'double' END"
        parts.append(f"SELECT '{c}' AS column_name, mn AS min, mx AS max, {t} AS target_type FROM "
                     f"(SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx FROM lineitem)")
    return " UNION ALL ".join(parts)


@query("downcast_plan", sql=_downcast_sql())
def downcast_plan(spark, sf_dir):
    li = roles.table(spark, sf_dir, "lineitem").select(*[c for c, _ in _DOWNCAST_COLS])
    return io.downcast_plan(li, allow_float=True)


@query("missing_predictions", sql="""
WITH p AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) AS prediction FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM p) AS predicted,
  (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.row_id = o.o_orderkey)) AS missing,
  abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM p)) AS abs_diff""")
def missing_predictions(spark, sf_dir):
    ids = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    preds = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")) \
        .agg(F.sum("l_extendedprice").alias("prediction"))
    return io.missing_predictions(ids, preds)


# --------------------------------------------------------------------------- P
@query("unit_convert", sql=with_roles(
    f"SELECT {RKEYS_SQL}, meter, CASE WHEN meter = 0 THEN meter_reading * 0.2931::DOUBLE ELSE meter_reading END AS meter_reading FROM r",
    r=READ))
def unit_convert(spark, sf_dir):
    r = roles.readings(spark, sf_dir)
    return r.select(*RKEYS, "meter", exprs.unit_convert("meter_reading", "meter").alias("meter_reading"))


_METER_CASE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in exprs.METER_NAMES.items())
_METER_REV = " ".join(f"WHEN '{v}' THEN {k}" for k, v in exprs.METER_NAMES.items())


@query("map_labels", sql=with_roles(
    f"SELECT {RKEYS_SQL}, meter, meter_name, CASE meter_name {_METER_REV} END AS meter_code "
    f"FROM (SELECT *, CASE meter {_METER_CASE} END AS meter_name FROM r)", r=READ))
def map_labels(spark, sf_dir):
    r = roles.readings(spark, sf_dir).select(*RKEYS, "meter")
    named = enc.map_labels(r, "meter", exprs.METER_NAMES, out="meter_name")
    return enc.map_labels(named, "meter_name", exprs.METER_NAMES, reverse=True, out="meter_code")


@query("label_encode", sql="""
SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type_code FROM part""")
def label_encode(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    encoded, _ = enc.label_encode(part, "p_type", "p_type_code")
    return encoded


@query("train_val_split", sql=with_roles(
    f"SELECT {RKEYS_SQL}, {exprs.split_flag_sql(RKEYS, 3)} AS train_val_split FROM r", r=READ))
def train_val_split(spark, sf_dir):
    r = roles.readings(spark, sf_dir)
    return r.select(*RKEYS, exprs.split_flag(RKEYS, 3).alias("train_val_split"))


_WEATHER_COLS = ["site_id", "ts", "air_temperature", "dew_temperature", "wind_speed"]


def _null_count_sql(rel: str, cols, extra: str = "") -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS row_count "
             f"FROM {rel}" for c in cols]
    return " UNION ALL ".join(parts)


@query("null_columns", sql=with_roles(
    "SELECT column_name, null_count, null_count > 0 AS dropped FROM ("
    + _null_count_sql("w", _WEATHER_COLS) + ")", w=roles.weather_sql()))
def null_columns(spark, sf_dir):
    w = roles.weather(spark, sf_dir)
    return enc.null_counts(w).select("column_name", "null_count", (F.col("null_count") > 0).alias("dropped"))


_PB_COLS = ["building_id", "primary_use", "floor_count", "square_feet"]


@query("sparse_features", sql=with_roles(
    "SELECT column_name, null_count / row_count AS null_share, null_count / row_count > 0.3 AS dropped FROM ("
    + _null_count_sql("b", _PB_COLS) + ")", b=roles.part_buildings_sql()))
def sparse_features(spark, sf_dir):
    return enc.sparse_feature_report(roles.part_buildings(spark, sf_dir), thresh=0.3)


@query("match_columns", sql=with_roles("SELECT building_id, ts, meter_reading FROM e", e=roles.event_readings_sql()))
def match_columns(spark, sf_dir):
    _, matched = enc.match_columns(roles.readings(spark, sf_dir), roles.event_readings(spark, sf_dir))
    return matched


_SITES = list(range(25))


def _one_hot_sql() -> str:
    cols = [f"CASE WHEN meter = {v} THEN 1 ELSE 0 END AS meter_{v}" for v in range(4)]
    cols += [f"CASE WHEN site_id = {v} THEN 1 ELSE 0 END AS site_id_{v}" for v in _SITES]
    cols += [f"CASE WHEN season = {v} THEN 1 ELSE 0 END AS season_{v}" for v in range(1, 5)]
    return with_roles(
        f"SELECT {RKEYS_SQL}, meter, site_id, season, {', '.join(cols)} FROM (SELECT r.*, b.site_id, "
        "CASE WHEN month(r.ts) IN (12, 1, 2) THEN 1 WHEN month(r.ts) IN (3, 4, 5) THEN 2 "
        "WHEN month(r.ts) IN (6, 7, 8) THEN 3 ELSE 4 END AS season FROM r JOIN b USING (building_id))",
        r=READ, b=roles.buildings_sql())


@query("one_hot", sql=_one_hot_sql())
def one_hot(spark, sf_dir):
    r = roles.readings(spark, sf_dir).join(roles.buildings(spark, sf_dir), "building_id")
    r = r.select(*RKEYS, "meter", "site_id", cal.season("ts").alias("season"))
    return enc.one_hot(r, {"meter": list(range(4)), "site_id": _SITES, "season": [1, 2, 3, 4]})


_LIGHT = ["SMALL", "PROMO"]


@query("use_category", sql=with_roles(f"""
SELECT b.building_id, b.primary_use,
  CASE WHEN b.primary_use IN ('SMALL', 'PROMO') THEN 0
       WHEN s.primary_use IS NOT NULL THEN 1 END AS use_categ
FROM b LEFT JOIN (SELECT DISTINCT primary_use FROM t WHERE primary_use IS NOT NULL) s USING (primary_use)""",
    b=roles.part_buildings_sql(),
    t="SELECT pb.primary_use FROM lineitem l JOIN (" + roles.part_buildings_sql()
      + ") pb ON pb.building_id = l.l_partkey WHERE l.l_returnflag = 'R'"))
def use_category(spark, sf_dir):
    pb = roles.part_buildings(spark, sf_dir)
    # "train" = the uses of parts that appear on returned line items.
    li = roles.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("building_id"))
    train = li.join(pb, "building_id").select("primary_use")
    return enc.use_category(pb.select("building_id", "primary_use"), train, light=_LIGHT)


def _column_diff_sql() -> str:
    train_cols = ["l_orderkey", "l_linenumber", "l_partkey", "building_id", "meter", "ts", "meter_reading"]
    test_cols = ["event_id", "building_id", "site_id", "ts", "meter_reading"]
    rows = []
    for c in sorted(set(train_cols) | set(test_cols)):
        tn = f"(SELECT count(*) FILTER (WHERE {c} IS NULL) FROM tr)" if c in train_cols else "NULL"
        sn = f"(SELECT count(*) FILTER (WHERE {c} IS NULL) FROM te)" if c in test_cols else "NULL"
        rows.append(f"SELECT '{c}' AS column_name, {str(c in train_cols).lower()} AS in_train, "
                    f"{str(c in test_cols).lower()} AS in_test, CAST({tn} AS BIGINT) AS train_nulls, CAST({sn} AS BIGINT) AS test_nulls")
    return with_roles(" UNION ALL ".join(rows), tr=READ_N, te=roles.event_readings_sql())


@query("column_diff", sql=_column_diff_sql())
def column_diff(spark, sf_dir):
    tr = roles.readings(spark, sf_dir, nulls=True)
    te = roles.event_readings(spark, sf_dir)
    a = enc.null_counts(tr).select("column_name", F.col("null_count").alias("train_nulls"))
    b = enc.null_counts(te).select("column_name", F.col("null_count").alias("test_nulls"))
    j = a.join(b, "column_name", "full")
    return j.select("column_name", F.col("train_nulls").isNotNull().alias("in_train"),
                    F.col("test_nulls").isNotNull().alias("in_test"), "train_nulls", "test_nulls")


@query("fill_zero", sql=with_roles(f"SELECT {RKEYS_SQL}, coalesce(meter_reading, 0.0::DOUBLE) AS meter_reading FROM r", r=READ_N))
def fill_zero(spark, sf_dir):
    r = roles.readings(spark, sf_dir, nulls=True).select(*RKEYS, "meter_reading")
    return enc.fill_zero(r, ["meter_reading"])


@query("human_format", sql=f"SELECT o_orderkey, o_totalprice, {exprs.human_format_sql('o_totalprice')} AS label FROM orders")
def human_format(spark, sf_dir):
    o = roles.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", exprs.human_format("o_totalprice").alias("label"))


# --------------------------------------------------------------------------- F
@query("drop_missing", sql=with_roles(f"SELECT {RKEYS_SQL}, meter_reading FROM r WHERE meter_reading IS NOT NULL", r=READ_N))
def drop_missing(spark, sf_dir):
    r = roles.readings(spark, sf_dir, nulls=True).select(*RKEYS, "meter_reading")
    return flt.drop_missing(r, ["meter_reading"])


_SPAN_SQL = with_roles(
    f"SELECT {RKEYS_SQL}, site_id, meter, month, meter_reading FROM rb "
    "WHERE coalesce(site_id <> 0, true) OR coalesce(meter_reading <> 0, true) OR coalesce(month >= 6, false)",
    r=READ_Z, b=roles.buildings_sql(),
    rb="SELECT r.*, b.site_id, CAST(month(r.ts) AS INTEGER) AS month FROM r LEFT JOIN b USING (building_id)")


def _readings_sites(spark, sf_dir):
    r = roles.readings(spark, sf_dir, zeros=True)
    return r.join(roles.buildings(spark, sf_dir).select("building_id", "site_id"), "building_id", "left") \
        .withColumn("month", F.month("ts"))


@query("irregular_span_filter", sql=_SPAN_SQL)
def irregular_span_filter(spark, sf_dir):
    r = _readings_sites(spark, sf_dir)
    return r.where(flt.irregular_span_keep()).select(*RKEYS, "site_id", "meter", "month", "meter_reading")


@query("zero_reading_filter", sql=with_roles(
    f"SELECT {RKEYS_SQL}, meter, meter_reading FROM r WHERE coalesce(meter_reading <> 0, true) OR coalesce(meter <> 0, true)",
    r=READ_Z))
def zero_reading_filter(spark, sf_dir):
    r = roles.readings(spark, sf_dir, zeros=True).select(*RKEYS, "meter", "meter_reading")
    return r.where(flt.zero_reading_keep())


@query("removal_report", sql=with_roles("""
SELECT step, position, rows_before, rows_before - rows_after AS removed,
  CASE WHEN rows_before = 0 THEN NULL ELSE (rows_before - rows_after) / rows_before END AS removed_share FROM (
  SELECT 'irregular_span' AS step, 1 AS position, count(*) AS rows_before, count(*) FILTER (WHERE k1) AS rows_after FROM k
  UNION ALL
  SELECT 'zero_electricity', 2, count(*) FILTER (WHERE k1), count(*) FILTER (WHERE k1 AND k2) FROM k)""",
    r=READ_Z, b=roles.buildings_sql(),
    k="SELECT (coalesce(b.site_id <> 0, true) OR coalesce(r.meter_reading <> 0, true) OR coalesce(month(r.ts) >= 6, false)) AS k1, "
      "(coalesce(r.meter_reading <> 0, true) OR coalesce(r.meter <> 0, true)) AS k2 FROM r LEFT JOIN b USING (building_id)"))
def removal_report(spark, sf_dir):
    r = _readings_sites(spark, sf_dir)
    return flt.removal_report(r, [("irregular_span", flt.irregular_span_keep()),
                                  ("zero_electricity", flt.zero_reading_keep())])


def _share_sql(rel: str, col: str) -> str:
    return f"""SELECT label, volume, volume / sum(volume) OVER () AS percent,
  sum(volume) OVER (ORDER BY volume DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(volume) OVER () AS cumulative_perc,
  CAST(row_number() OVER (ORDER BY volume DESC, label) AS BIGINT) AS rank
  FROM (SELECT {col} AS label, count(*) AS volume FROM {rel} WHERE {col} IS NOT NULL GROUP BY 1)"""


@query("remove_sparse_labels", sql=with_roles(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split FROM li
WHERE split = 1 OR l_suppkey NOT IN (SELECT label FROM sh WHERE cumulative_perc >= 0.995)""",
    li=f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {exprs.split_flag_sql(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'])} AS split FROM lineitem",
    sh=_share_sql("lineitem", "l_suppkey")))
def remove_sparse_labels(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = roles.table(spark, sf_dir, "lineitem").select(*keys, exprs.split_flag(keys).alias("split"))
    return enc.remove_sparse_labels(li, "l_suppkey", 0.995, ignore_col="split", ignore_val=1)


@query("value_share", sql=with_roles(_share_sql("pb", "floor_count"), pb=roles.part_buildings_sql()))
def value_share(spark, sf_dir):
    from ..operators.profile import value_share as vs
    return vs(roles.part_buildings(spark, sf_dir), "floor_count")


@query("sparse_labels", sql=f"SELECT label, volume, percent FROM ({_share_sql('events', 'user_id')}) WHERE percent <= 0.005")
def sparse_labels(spark, sf_dir):
    return enc.sparse_labels(roles.table(spark, sf_dir, "events"), "user_id", 0.005)


@query("combine_sparse_labels", sql=f"""
SELECT event_id, CASE WHEN user_id IN (SELECT label FROM ({_share_sql('events', 'user_id')}) WHERE percent <= 0.005)
  THEN 'NonTraditionalUsage' ELSE CAST(user_id AS VARCHAR) END AS user_label FROM events""")
def combine_sparse_labels(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "user_id")
    labels = enc.sparse_labels(ev, "user_id", 0.005)
    return enc.combine_sparse_labels(ev, "user_id", labels, out="user_label").select("event_id", "user_label")


# --------------------------------------------------------------------------- J
@query("join_inner", sql=with_roles(
    f"SELECT {RKEYS_SQL}, meter, ts, meter_reading, site_id, square_feet FROM r JOIN b USING (building_id)",
    r=READ, b=roles.buildings_sql()))
def join_inner(spark, sf_dir):
    return roles.readings(spark, sf_dir).join(roles.buildings(spark, sf_dir), "building_id", "inner")


@query("join_left", sql=with_roles(
    "SELECT event_id, building_id, e.site_id AS site_id, ts, meter_reading, b.site_id AS building_site, square_feet "
    "FROM e LEFT JOIN b USING (building_id)", e=roles.event_readings_sql(), b=roles.buildings_sql()))
def join_left(spark, sf_dir):
    b = roles.buildings(spark, sf_dir).withColumnRenamed("site_id", "building_site")
    return roles.event_readings(spark, sf_dir).join(b, "building_id", "left")


@query("join_weather", sql=with_roles(
    "SELECT e.*, air_temperature, dew_temperature, wind_speed FROM e LEFT JOIN w USING (site_id, ts)",
    e=roles.event_readings_sql(), w=roles.weather_sql()))
def join_weather(spark, sf_dir):
    return roles.event_readings(spark, sf_dir).join(roles.weather(spark, sf_dir), ["site_id", "ts"], "left")
