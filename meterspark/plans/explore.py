"""E3: the exploration report as a set of independent Spark plans.

Each entry is a lazy DataFrame over whole tables; a caller writes or shows
the ones it needs (nothing is collected here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import plotdata as pdata
from ..operators import profile as pf
from ..operators import timeseries as tsx
from ..sources import roles


def exploration_report(spark: SparkSession, sf_dir: str, bounds=(10, 20, 50, 100), top_n: int = 2) -> dict[str, DataFrame]:
    """Zero shares and extremes per meter, most variable buildings, missing tables, category profile,
    naive mode accuracy, per-site weather gaps, target histogram, interval counts and date coverage."""
    readings = roles.readings(spark, sf_dir, zeros=True)
    parts = roles.part_buildings(spark, sf_dir).withColumn("train_val_split", exprs.split_flag(["building_id"], 3))
    weather = roles.weather(spark, sf_dir)
    sites = sorted(roles.EVENT_TYPE_TO_SITE.values())
    return {
        "zero_share_by_meter": pf.zero_share_rollup(readings, "meter", "meter_reading"),
        "meter_extremes": pf.extremes_by_group(readings, "meter", "meter_reading", "building_id"),
        "top_variation": pf.top_variation(readings, "building_id", "meter_reading", top_n),
        "missing_readings": pf.missing_table(roles.readings(spark, sf_dir, nulls=True)),
        "missing_weather": pf.missing_table(weather),
        "floor_count_by_use": pf.assess_by_category(parts, "primary_use", "floor_count"),
        "missing_floor_count_by_use": pf.missing_by_category(parts, "primary_use", "floor_count"),
        "naive_mode_accuracy": pf.naive_mode_accuracy(parts, "primary_use", "floor_count"),
        "weather_gaps_by_site": pf.missing_table(
            tsx.pivot_series(weather, "ts", "site_id", "air_temperature", sites, "site_"),
            [f"site_{s}" for s in sites], share_of_nulls=True),
        "reading_histogram": pdata.histogram(readings, "meter_reading", 20),
        "reading_intervals": pf.count_intervals(readings.withColumn("k", F.col("meter_reading") / 1000.0), "k", list(bounds)),
        "date_coverage": pf.date_coverage_diff(readings, "ts", weather, "ts"),
    }
