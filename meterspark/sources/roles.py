"""Role views: the driver's tables standing in for meter data.

Each role is defined twice, once as a Spark DataFrame and once as a SQL
common-table expression for the DuckDB oracle, from the same rule.  The
rules are those of FIXTURES.md part C; nothing here is sampled or capped,
every role reads its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_sql

# Meter codes of the return flag, site codes of the event types.
RETURNFLAG_TO_METER = {"A": 0, "N": 1, "R": 2}
EVENT_TYPE_TO_SITE = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
# The site whose second weather column is entirely missing.
ALL_NULL_DEW_SITE = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case_map(col, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr


def _sql_case(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


# --------------------------------------------------------------------------- readings
def readings(spark: SparkSession, sf_dir: str, zeros: bool = False, nulls: bool = False,
             extra: tuple[str, ...] = ()) -> DataFrame:
    """lineitem as hourly meter readings.

    Key: (l_orderkey, l_linenumber, l_partkey, building_id).  ``extra``
    lineitem columns ride along as additional numeric predictors.
    """
    li = table(spark, sf_dir, "lineitem")
    reading = F.col("l_extendedprice")
    if zeros:
        reading = F.when((F.col("l_suppkey") + F.month("l_shipdate")) % 4 == 0, F.lit(0.0)).otherwise(reading)
    if nulls:
        reading = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0, F.lit(None).cast("double")).otherwise(reading)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_suppkey").alias("building_id"),
        _case_map(F.col("l_returnflag"), RETURNFLAG_TO_METER).cast("int").alias("meter"),
        F.col("l_shipdate").alias("ts"),
        reading.alias("meter_reading"),
        *extra,
    )


def readings_sql(zeros: bool = False, nulls: bool = False) -> str:
    reading = "l_extendedprice"
    if zeros:
        reading = f"CASE WHEN (l_suppkey + month(l_shipdate)) % 4 = 0 THEN 0.0::DOUBLE ELSE {reading} END"
    if nulls:
        reading = f"CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE {reading} END"
    return (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS building_id, "
        f"CAST({_sql_case('l_returnflag', RETURNFLAG_TO_METER)} AS INTEGER) AS meter, "
        f"l_shipdate AS ts, CAST({reading} AS DOUBLE) AS meter_reading FROM lineitem"
    )


# --------------------------------------------------------------------------- buildings
def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as building metadata (site = nation)."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("building_id"),
        F.col("s_nationkey").alias("site_id"),
        F.col("s_acctbal").alias("square_feet"),
    )


def buildings_sql() -> str:
    return "SELECT s_suppkey AS building_id, s_nationkey AS site_id, s_acctbal AS square_feet FROM supplier"


def part_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as building metadata with a primary use and a sparse floor count."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("building_id"),
        F.col("p_type").alias("primary_use"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("int").alias("floor_count"),
        F.col("p_retailprice").alias("square_feet"),
    )


def part_buildings_sql() -> str:
    return (
        "SELECT p_partkey AS building_id, p_type AS primary_use, "
        "CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS INTEGER) AS floor_count, "
        "p_retailprice AS square_feet FROM part"
    )


# --------------------------------------------------------------------------- weather
def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events aggregated per (site, hour) as weather observations (GMT)."""
    ev = table(spark, sf_dir, "events")
    hourly = ev.groupBy(
        F.col("event_type"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
    ).agg(
        F.avg("value").alias("a"), F.min("value").alias("m"), F.max("value").alias("x"),
    )
    gap = F.hour("ts") % 6 == 0
    null = F.lit(None).cast("double")
    return hourly.select(
        _case_map(F.col("event_type"), EVENT_TYPE_TO_SITE).cast("int").alias("site_id"),
        "ts",
        F.when(gap, null).otherwise(rnd("a", 6)).alias("air_temperature"),
        F.when(gap | (F.col("event_type") == ALL_NULL_DEW_SITE), null).otherwise(F.col("m")).alias("dew_temperature"),
        F.when(gap, null).otherwise(F.col("x")).alias("wind_speed"),
    )


def weather_sql() -> str:
    return (
        "SELECT CAST(" + _sql_case("event_type", EVENT_TYPE_TO_SITE) + " AS INTEGER) AS site_id, ts, "
        f"CASE WHEN hour(ts) % 6 = 0 THEN NULL ELSE {rnd_sql('a', 6)} END AS air_temperature, "
        f"CASE WHEN hour(ts) % 6 = 0 OR event_type = '{ALL_NULL_DEW_SITE}' THEN NULL ELSE m END AS dew_temperature, "
        "CASE WHEN hour(ts) % 6 = 0 THEN NULL ELSE x END AS wind_speed "
        "FROM (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS a, min(value) AS m, max(value) AS x "
        "FROM events GROUP BY 1, 2)"
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as hourly readings of a site, for the weather join."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("building_id"),
        _case_map(F.col("event_type"), EVENT_TYPE_TO_SITE).cast("int").alias("site_id"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("meter_reading"),
    )


def event_readings_sql() -> str:
    return (
        "SELECT event_id, user_id AS building_id, CAST(" + _sql_case("event_type", EVENT_TYPE_TO_SITE)
        + " AS INTEGER) AS site_id, date_trunc('hour', ts) AS ts, value AS meter_reading FROM events"
    )


# --------------------------------------------------------------------------- offsets
def site_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key as site with a GMT offset in hours."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("site_id"),
        ((F.col("n_nationkey") % 12) - 8).cast("int").alias("offset_h"),
    )


def site_offsets_sql() -> str:
    return "SELECT n_nationkey AS site_id, CAST((n_nationkey % 12) - 8 AS INTEGER) AS offset_h FROM nation"


# --------------------------------------------------------------------------- predictions
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem prices as (truth, prediction) pairs; some predictions are negative."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.col("l_extendedprice").alias("y"),
        (F.col("l_extendedprice") * (F.lit(0.9) + F.col("l_discount")) - F.lit(2000.0)).alias("p"),
    )


def predictions_sql() -> str:
    return (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice AS y, "
        "l_extendedprice * (0.9::DOUBLE + l_discount) - 2000.0::DOUBLE AS p FROM lineitem"
    )


def with_roles(sql: str, **ctes: str) -> str:
    """Prefix ``sql`` with named role CTEs."""
    if not ctes:
        return sql
    body = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    return f"WITH {body}\n{sql}"
