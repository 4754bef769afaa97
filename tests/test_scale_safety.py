"""Fixes that only show at scale or with NULL keys: sampling shares, rounding, wide integers, NULL groups."""

import datetime as dt
import math
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from meterspark import session
from meterspark.functions import exprs
from meterspark.functions.numeric import rnd
from meterspark.operators import features as fx
from meterspark.operators import plotdata, profile, timeseries
from meterspark.operators import groupstats as gs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(400_000).withColumnRenamed("id", "k").cache()


@pytest.mark.parametrize("fraction", [0.0002, 0.0014, 0.35])
def test_small_fractions_are_kept(many, fraction):
    got = fx.fraction_sample(many, fraction, ["k"]).count()
    want = 400_000 * fraction
    assert abs(got - want) < 6 * math.sqrt(want) + 1


def test_share_threshold_reaches_tiny_fractions():
    # the cut-off itself scales with the fraction: one part in 1e9 is not rounded to nothing
    assert exprs.in_share_sql(["k"], 1, 1e-9).endswith(f"< {math.ceil(1e-9 * 2**52)})") and math.ceil(1e-9 * 2**52) > 4_000_000


def test_per_feature_rule_is_not_empty(many):
    n = fx.fraction_sample(many, 1.0, ["k"], per_feature_rule=True, n_features=15).count()
    assert 90 < n < 220


def test_large_sample_equals_top_n(many):
    a = fx.sample_n(many, 5_000, ["k"]).collect()
    b = fx.sample_n(many, 5_000, ["k"], top_n_rows=10).collect()
    assert sorted(a) == sorted(b) and len(b) == 5_000
    assert fx.sample_n(many, 10**6, ["k"], top_n_rows=10).count() == 400_000


def test_rounding_of_large_values(spark):
    row = spark.createDataFrame([(1e13, 9.3e15, -1e300, 2.345)], "a double, b double, c double, d double").select(
        rnd("a", 6), rnd("b", 2), rnd("c", 2), rnd("d", 2)).first()
    assert tuple(row)[:3] == (1e13, 9.3e15, -1e300) and abs(row[3] - 2.35) < 0.011


def test_values_beyond_32_bits(spark):
    df = spark.createDataFrame([("a", 3.0e9), ("a", 3.0e9), ("b", 1.0)], "g string, y double")
    r = {x["g"]: x for x in profile.assess_by_category(df, "g", "y").collect()}
    assert r["a"]["mode"] == 3_000_000_000 and r["a"]["max"] == 3_000_000_000


def test_null_groups_have_their_statistics(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 7.0), (None, 7.0), ("a", 1.0)], "g string, y double")
    s = {x["g"]: x for x in profile.stats_by_value(df, "g", "y").collect()}
    assert s[None]["median"] == 7.0 and s[None]["count"] == 3
    assert {x["g"]: x["mode"] for x in profile.assess_by_category(df, "g", "y").collect()}[None] == 7
    assert {x["g"]: x["m"] for x in profile.median_by_keys(df, ["g"], "y", "m").collect()} == {None: 7.0, "a": 1.0}


def test_interpolation_keeps_rows_with_null_keys(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1.0), ("a", t + dt.timedelta(hours=1), None), ("a", t + dt.timedelta(hours=2), 3.0), ("a", None, 4.0),
            (None, t, None), (None, t + dt.timedelta(hours=1), 2.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")
    out = timeseries.interpolate_linear(df, ["s"], "ts", ["v"], fill_edges=True)
    assert out.count() == 6
    assert {(r["s"], r["ts"]): r["v"] for r in out.collect()}[("a", t + dt.timedelta(hours=1))] == 2.0
    assert out.where("s IS NULL AND v = 2.0").count() == 2


def test_fill_frames_only_grow(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "s string, ts timestamp_ntz, v double")
    plan = timeseries.back_forward_fill(df, ["s"], "ts", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    rows_after = [x for x in plan.split("specifiedwindowframe") if "currentrow$(), unboundedfollowing$()" in x[:80]]
    assert not rows_after


@pytest.mark.parametrize("cells", [20, 100])
def test_narrowed_ranges_equal_the_small_group_path(spark, cells):
    df = spark.range(3_000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1009).cast("double").alias("y"))
    a = gs.quantiles(df, ["g"], "y", [0.25, 0.5, 0.9], cells=cells).collect()
    b = gs.quantiles(df, ["g"], "y", [0.25, 0.5, 0.9]).collect()
    assert sorted(a) == sorted(b)


def test_bounded_groups_keep_rows_in_place(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gs.quantiles(df, ["g"], "y", [0.25, 0.5], cells=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scatter_keeps_all_points(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert plotdata.scatter_points(df, "x", "y", ["id"]).count() == 500


def test_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_entry_imports_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "meterspark"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = ("import __spark_entry__ as e; q = e.queries(); assert 'outlier_clean_stats' in q and 'pipeline' not in q; "
            "assert not [n for n in q if n.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr[-2000:]
