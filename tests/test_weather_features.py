"""The feature table with weather: removal in two stages, fills on test rows, sites without an offset."""

import datetime as dt

from pyspark.sql import functions as F

from meterspark.operators import encode as enc
from meterspark.operators import outliers as ol
from meterspark.plans import forecast


def test_zeros_are_filled_on_the_chosen_rows_only(spark):
    df = spark.createDataFrame([(0, None, None), (1, None, None), (1, float("nan"), 3), (0, float("nan"), 4)], "part int, x double, k int")
    got = [tuple(r) for r in enc.fill_zero(df, ["x", "k"], F.col("part") == 1).collect()]
    assert got[0] == (0, None, None) and got[1:3] == [(1, 0.0, 0), (1, 0.0, 3)]
    assert got[3][1] != got[3][1] and got[3][2] == 4


def test_second_stage_judges_the_most_variable_entities_only(spark):
    rows = [(0, "a", 10.0 + k % 3) for k in range(60)] + [(0, "a", 90.0)] + [(0, "b", 10.0 + k % 2) for k in range(60)] + [(0, "b", 13.0)]
    df = spark.createDataFrame(rows, "site int, who string, y double")
    out = ol.two_stage(df, "y", "site", [0], "who", 1, "one", "two").collect()
    # 90 goes in the first stage; of the rest only the more variable entity ("a") is labelled again
    assert sorted({r["y"] for r in out if r["who"] == "a"}) == [10.0, 11.0, 12.0]
    assert {r["two"] for r in out if r["who"] == "b"} == {None} and {r["two"] for r in out if r["who"] == "a"} == {"Normal_who-a"}


def test_weather_of_unknown_sites_is_reported(spark):
    t = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([(0, t, 1.0), (1, t, 2.0), (1, t, 2.0), (2, t, 3.0), (None, t, 4.0)], "site_id int, ts timestamp_ntz, a double")
    offsets = spark.createDataFrame([(0, 1), (2, None)], "site_id int, offset_h int")
    got = {(r["site_id"], r["n_rows"]) for r in forecast.weather_without_offset(w, offsets).collect()}
    assert got == {(1, 2), (2, 1), (None, 1)}


def test_rows_of_one_use_are_not_sent_to_one_task(spark):
    df = spark.createDataFrame([(i, ["light", "other", "new", None][i % 4], i % 2) for i in range(40)], "k int, primary_use string, part int")
    out = enc.use_category(df, df.where("part = 1"), light=["light"])
    assert {(r["primary_use"], r["use_categ"]) for r in out.collect()} == {("light", 0), ("other", 1), ("new", None), (None, None)}
    assert len(out.collect()) == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
