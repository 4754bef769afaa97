"""Queries: calendar features, log/min-max transforms, samples and splits (T5-T6, X-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import exprs
from ..functions.numeric import rnd, rnd_sql
from ..operators import features as fx
from ..sources import roles
from ..sources.roles import with_roles
from . import forecast
from .q_clean import two_stage_sql
from .q_timeseries import CLEAN_WEATHER_SQL
from .registry import query

# The events span January 2024: the query passes that month's holidays.
HOLIDAYS_2024_JAN = ["2024-01-01", "2024-01-15"]
LKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "building_id"]


@query("calendar_parts", sql="""
SELECT event_id, ts, date_trunc('day', ts) AS date, CAST(month(ts) AS INTEGER) AS month,
  strftime(ts, '%H:%M:%S') AS time, CAST(hour(ts) AS INTEGER) AS hr FROM events""")
def calendar_parts(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "ts")
    parts = cal.calendar_parts("ts")
    parts["date"] = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return ev.select("event_id", "ts", *[c.alias(n) for n, c in parts.items()])


@query("calendar_features", sql=f"SELECT event_id, ts, {cal.calendar_features_sql('ts', HOLIDAYS_2024_JAN)} FROM events")
def calendar_features(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "ts")
    return ev.select("event_id", "ts", *[c.alias(n) for n, c in cal.calendar_features("ts", HOLIDAYS_2024_JAN).items()])


@query("log_transform", sql=f"""
WITH m AS (SELECT least(min(s_acctbal), min(CAST(s_nationkey AS DOUBLE))) AS g FROM supplier)
SELECT s_suppkey AS building_id,
  {rnd_sql("ln(s_acctbal + CASE WHEN g <= 0 THEN abs(g) + 1.0 ELSE 0.0 END)", 6)} AS log_square_feet,
  {rnd_sql("ln(s_nationkey + CASE WHEN g <= 0 THEN abs(g) + 1.0 ELSE 0.0 END)", 6)} AS log_site_id
FROM supplier, m""")
def log_transform(spark, sf_dir):
    b = roles.buildings(spark, sf_dir)
    out = fx.log_transform(b, ["square_feet", "site_id"])
    return out.select("building_id", rnd("log_square_feet", 6).alias("log_square_feet"),
                      rnd("log_site_id", 6).alias("log_site_id"))


@query("minmax_scale", sql=with_roles(f"""
SELECT {', '.join(RKEYS)}, train_val_split,
  {rnd_sql("(meter_reading - mn_r) / CASE WHEN mx_r = mn_r THEN 1.0 ELSE mx_r - mn_r END", 6)} AS meter_reading_scaled,
  {rnd_sql("(l_quantity - mn_q) / CASE WHEN mx_q = mn_q THEN 1.0 ELSE mx_q - mn_q END", 6)} AS l_quantity_scaled
FROM r, (SELECT min(meter_reading) AS mn_r, max(meter_reading) AS mx_r, min(l_quantity) AS mn_q, max(l_quantity) AS mx_q
         FROM r WHERE train_val_split = 0) s""",
    r=f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS building_id, l_extendedprice AS meter_reading, l_quantity, "
      f"{exprs.split_flag_sql(RKEYS, 3)} AS train_val_split FROM (SELECT *, l_suppkey AS building_id FROM lineitem)"))
def minmax_scale(spark, sf_dir):
    r = roles.readings(spark, sf_dir, extra=("l_quantity",)).withColumn("train_val_split", exprs.split_flag(RKEYS, 3))
    cols = ["meter_reading", "l_quantity"]
    fitted = fx.minmax_fit(r.where(F.col("train_val_split") == 0), cols)
    out = fx.minmax_apply(r, fitted, cols, suffix="_scaled")
    return out.select(*RKEYS, "train_val_split", *[rnd(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in cols])


_H5 = "CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in LKEYS) + ", '5')), 1, 8)) AS BIGINT)"


@query("sample_n", sql=f"SELECT * FROM lineitem ORDER BY {_H5}, {', '.join(LKEYS)} LIMIT 1000")
def sample_n(spark, sf_dir):
    return fx.sample_n(roles.table(spark, sf_dir, "lineitem"), 1000, LKEYS, seed=5)


@query("fraction_sample", sql=f"SELECT * FROM lineitem WHERE {exprs.in_share_sql(LKEYS, 5, 0.001)}")
def fraction_sample(spark, sf_dir):
    return fx.fraction_sample(roles.table(spark, sf_dir, "lineitem"), 0.001, LKEYS, seed=5)


@query("split_counts", sql=with_roles(f"""
SELECT meter, train_val_split, count(*) AS n, {rnd_sql('avg(ln(1 + meter_reading))', 6)} AS mean_target
FROM (SELECT *, {exprs.split_flag_sql(RKEYS, 3)} AS train_val_split FROM r) GROUP BY 1, 2""", r=roles.readings_sql()))
def split_counts(spark, sf_dir):
    r = roles.readings(spark, sf_dir).withColumn("train_val_split", exprs.split_flag(RKEYS, 3))
    out = fx.split_counts(r, ["meter"], "train_val_split", "meter_reading", log_y=True)
    return out.withColumn("mean_target", rnd("mean_target", 6))


# --------------------------------------------------------------------------- the whole feature table, weather included
_SITES = sorted(roles.EVENT_TYPE_TO_SITE.values())
_LIGHT = ["SMALL", "PROMO"]
_ENG_NUM = ["square_feet", "floor_count", "air_temperature", "wind_speed"]
_ENG_LOGS = ["log_square_feet", "log_floor_count", "log_air_temperature"]  # log_wind_speed is on the removed list
_ENG_REST = ["day_of_week", "is_workday", "is_holiday", "time_of_day", "is_business_hr", "season", "use_categ",
             *[f"site_id_{s}" for s in _SITES]]


def event_features(spark, sf_dir):
    """(rows, feature names) of the readings that have weather."""
    return forecast.engineer_with_weather(
        roles.event_readings(spark, sf_dir), roles.part_buildings(spark, sf_dir), roles.weather(spark, sf_dir),
        roles.site_offsets(spark, sf_dir), ["event_id"], _SITES, HOLIDAYS_2024_JAN, _LIGHT)


@query("engineered_features", sql=with_roles(
    "SELECT event_id, building_id, meter_reading, train_val_split, "
    + ", ".join(rnd_sql(f"({c} - mn_{c}) / CASE WHEN mx_{c} = mn_{c} THEN 1.0::DOUBLE ELSE mx_{c} - mn_{c} END", 6) + f" AS {c}"
                for c in _ENG_LOGS) + ", " + ", ".join(_ENG_REST) + " FROM fz, mm",
    e=roles.event_readings_sql(), p=roles.part_buildings_sql(), **CLEAN_WEATHER_SQL,
    **two_stage_sql("e", "meter_reading", "site_id", ", ".join(map(str, _SITES)), "building_id", "label_1", "label_2"),
    x=f"SELECT s2.event_id, building_id, site_id, s2.ts, meter_reading, primary_use, square_feet, floor_count, air_temperature, wind_speed, "
      f"{exprs.split_flag_sql(['event_id'], 3)} AS train_val_split "
      "FROM s2 LEFT JOIN p USING (building_id) LEFT JOIN wx USING (site_id, ts)",
    gm="SELECT least(" + ", ".join(f"min(CAST({c} AS DOUBLE))" for c in _ENG_NUM) + ") AS m FROM x",
    seen="SELECT DISTINCT primary_use AS u FROM x WHERE train_val_split = 0 AND primary_use IS NOT NULL",
    lg="SELECT event_id, building_id, meter_reading, train_val_split, "
       + ", ".join(f"ln({c[4:]} + CASE WHEN m <= 0 THEN abs(m) + 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}" for c in _ENG_LOGS)
       + f", {cal.calendar_features_sql('ts', HOLIDAYS_2024_JAN)}, "
       "CASE WHEN primary_use IN ('SMALL', 'PROMO') THEN 0 WHEN u IS NOT NULL THEN 1 END AS use_categ, "
       + ", ".join(f"CASE WHEN site_id = {s} THEN 1 ELSE 0 END AS site_id_{s}" for s in _SITES)
       + " FROM x LEFT JOIN seen ON primary_use = u, gm",
    fz="SELECT event_id, building_id, meter_reading, train_val_split, "
       + ", ".join(f"CASE WHEN train_val_split = 1 THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in [*_ENG_LOGS, *_ENG_REST]) + " FROM lg",
    mm="SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _ENG_LOGS) + " FROM fz WHERE train_val_split = 0"))
def engineered_features(spark, sf_dir):
    out, _ = event_features(spark, sf_dir)
    return out.select(*[rnd(c, 6).alias(c) if c in _ENG_LOGS else F.col(c) for c in out.columns])
