"""Structured Streaming use of the stateless operators.

The reference is batch only; nothing stateful is owed.  The row-level
operators (unit conversion, calendar features, one-hot codes, null-safe
filters) are plain column expressions, so the same functions apply to a
streaming DataFrame unchanged.  ``hourly_weather_stream`` shows the one
aggregation a meter feed needs online: hourly observations per site from an
event stream, with a watermark so state is dropped once an hour is final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import exprs
from ..operators import encode as enc
from ..operators import filters as flt


def reading_features(stream: DataFrame, holidays=cal.HOLIDAYS_2016) -> DataFrame:
    """Unit fix, calendar parts and features, meter/season one-hot, zero-electricity filter."""
    s = stream.withColumn("meter_reading", exprs.unit_convert("meter_reading", "meter"))
    s = s.select("*", *[c.alias(n) for n, c in cal.calendar_parts("ts").items()])
    s = s.select("*", *[c.alias(n) for n, c in cal.calendar_features("ts", holidays).items()])
    s = enc.one_hot(s, {"meter": [0, 1, 2, 3], "season": [1, 2, 3, 4]})
    return s.where(flt.zero_reading_keep())


def hourly_weather_stream(events: DataFrame, site_codes: dict, delay: str = "2 hours") -> DataFrame:
    """Per (site, hour): mean, min and max of ``value``; emitted when the watermark passes the hour."""
    site = exprs.map_values("event_type", site_codes).cast("int")
    # Watermarks need a zoned event time: read the wall clock in the session zone.
    timed = events.withColumn("_event_time", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("_event_time", delay)
            .groupBy(site.alias("site_id"), F.window("_event_time", "1 hour").alias("w"))
            .agg(F.avg("value").alias("air_temperature"), F.min("value").alias("dew_temperature"),
                 F.max("value").alias("wind_speed"))
            .select("site_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), "air_temperature", "dew_temperature",
                    "wind_speed"))
