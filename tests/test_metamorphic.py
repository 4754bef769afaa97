"""Metamorphic checks: results do not depend on partitioning; filters are idempotent."""

from pyspark.sql import functions as F

from conftest import SF001, rows
from meterspark.functions import calendar as cal
from meterspark.operators import filters as flt
from meterspark.operators import outliers as ol
from meterspark.operators import profile as pf
from meterspark.operators import timeseries as tsx
from meterspark.operators import zerodays as zd
from meterspark.sources import roles


def test_partitioning_does_not_change_results(spark):
    r = roles.readings(spark, SF001, zeros=True).withColumn("season", cal.season("ts")) \
        .withColumn("day", F.to_date("ts"))
    rules = spark.createDataFrame([(2, 1, 3), (1, 3, 3)], "meter int, season int, n_consec int")
    w = roles.weather(spark, SF001)
    ev = roles.table(spark, SF001, "events")
    for parts in (1, 5, 13):
        rr, ww, ee = r.repartition(parts), w.repartition(parts), ev.repartition(parts)
        got = (
            rows(pf.value_share(rr, "building_id"), "label", "volume", "rank"),
            zd.remove_consecutive_zero_days(rr, "building_id", "day", "meter_reading", ["meter", "season"], rules).count(),
            rows(tsx.interpolate_linear(ww, ["site_id"], "ts", ["air_temperature"]), "site_id", "ts", "air_temperature"),
            rows(ol.detect_outliers(ee, "value", "lab", "MAD", by="event_type", by_vals=["click", "view"]), "event_id", "lab"),
        )
        if parts == 1:
            first = got
        else:
            assert got == first, parts


def test_filters_idempotent(spark):
    r = roles.readings(spark, SF001, zeros=True).join(roles.buildings(spark, SF001), "building_id") \
        .withColumn("month", F.month("ts"))
    keep = flt.irregular_span_keep() & flt.zero_reading_keep()
    once = r.where(keep)
    assert once.where(keep).count() == once.count() < r.count()
    labelled = ol.keep_normal(ol.detect_outliers(roles.table(spark, SF001, "events"), "value", "lab", "MAD",
                                                 by="event_type", by_vals=["click"]), "lab")
    assert ol.keep_normal(labelled, "lab").count() == labelled.count()
