"""Sinks and sources, model persistence, streaming use, and the driver contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from meterspark.operators import ml
from meterspark.sources import io, roles
from meterspark.streaming import features as sfx


def _scratch():
    return tempfile.mkdtemp(prefix="meterspark-test-", dir="/tmp")


def test_csv_round_trip_with_bad_timestamps(spark):
    d = _scratch()
    df = spark.createDataFrame([(1, "2016-01-01 05:00:00", 1.5), (2, "not a date", None)], "row_id long, ts string, v double")
    io.write_csv(df, f"{d}/out")
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("ts", T.StringType()),
                           T.StructField("v", T.DoubleType())])
    back = io.read_table(spark, f"{d}/out", fmt="csv", schema=schema, timestamp_cols=["ts"])
    got = {r["row_id"]: (r["ts"], r["v"]) for r in back.collect()}
    assert got[2] == (None, None) and got[1][0].hour == 5


def test_hash_sample_stable_under_repartition(spark):
    li = roles.table(spark, SF001, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = io.hash_sample(li, keys, 0.2).select(*keys).collect()
    b = io.hash_sample(li.repartition(7), keys, 0.2).select(*keys).collect()
    assert sorted(a) == sorted(b) and 0 < len(a) < li.count()


def test_downcast_plan(spark):
    df = spark.createDataFrame([(1, 200, 1.5), (-5, 40000, 2.5)], "a long, b long, c double")
    plan = {r["column_name"]: r["target_type"] for r in io.downcast_plan(df).collect()}
    assert plan == {"a": "tinyint", "b": "int", "c": "float"}
    cast = io.apply_downcast(df, io.downcast_plan(df))
    assert dict(cast.dtypes) == {"a": "tinyint", "b": "int", "c": "float"}


def test_model_save_load_same_predictions(spark):
    d = _scratch()
    df = spark.range(0, 200).select(F.col("id").cast("double").alias("x"),
                                    (F.col("id") % 7).cast("double").alias("z")) \
        .withColumn("y", F.col("x") * 2.0 + F.col("z") + 1.0)
    model = ml.fit(df, ["x", "z"], "y", "gbt", dict(maxDepth=3, maxIter=5))
    ml.save(ml.fit(df, ["x"], "y", "lr"), f"{d}/model")
    loaded = ml.load(ml.save(model, f"{d}/model"))  # replaces the first
    a = sorted(r["prediction"] for r in model.transform(df).collect())
    b = sorted(r["prediction"] for r in loaded.transform(df).collect())
    assert a == b


def test_model_beats_median_baseline(spark):
    df = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("x")) \
        .withColumn("y", F.col("x") * 10.0 + 5.0) \
        .withColumn("train_val_split", F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    base = ml.baseline_rmsle(df, "y").first()["rmsle"]
    model = ml.fit(df.where("train_val_split = 0"), ["x"], "y", "gbt", dict(maxDepth=4, maxIter=10, lossType="squared"))
    pred = ml.predict(model, df.where("train_val_split = 1"), ["y"])
    assert ml.rmsle(pred, "y", "prediction").first()["rmsle"] < base / 2


def test_streaming_features_and_hourly_weather(spark):
    import shutil
    # A file stream source watches a directory: stage the small table in a scratch one.
    src = os.path.join(_scratch(), "events")
    os.makedirs(src)
    shutil.copy(f"{SF001}/events.parquet", os.path.join(src, "part-0.parquet"))
    schema = spark.read.parquet(src).schema
    events = spark.readStream.schema(schema).parquet(src)
    q = sfx.hourly_weather_stream(events, roles.EVENT_TYPE_TO_SITE).writeStream.outputMode("append") \
        .format("memory").queryName("hourly_weather_t") \
        .option("checkpointLocation", os.path.join(_scratch(), "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM hourly_weather_t")
    batch = roles.weather(spark, SF001)
    # Append mode emits hours closed by the watermark: a subset of the batch cells, same sites.
    assert 0 < streamed.count() <= batch.count()
    readings = spark.createDataFrame([(0, 0.0, __import__("datetime").datetime(2016, 1, 1, 10)),
                                      (2, 5.0, __import__("datetime").datetime(2016, 7, 4, 10))],
                                     "meter int, meter_reading double, ts timestamp_ntz")
    out = sfx.reading_features(readings)
    assert out.count() == 1 and out.first()["season_3"] == 1


def test_driver_contract(spark):
    import __spark_entry__ as se
    out = se.entry(spark)
    assert out.count() == 5 and "mad" in out.columns
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


def test_forecast_end_to_end_writes_complete_submission(spark):
    from meterspark.plans import forecast
    out = os.path.join(_scratch(), "submission")
    report = forecast.run(spark, SF001, out, params=dict(maxDepth=3, maxIter=3)).first()
    assert report["missing"] == 0 and report["abs_diff"] == 0 and report["expected"] > 0
    sub = spark.read.option("header", True).csv(out)
    assert sub.columns == ["row_id", "meter_reading"]
    assert sub.where("CAST(meter_reading AS DOUBLE) < 0").count() == 0


def test_exploration_report_builds(spark):
    from meterspark.plans.explore import exploration_report
    rep = exploration_report(spark, SF001)
    counts = {k: v.count() for k, v in rep.items()}
    assert all(n > 0 for n in counts.values()), counts
    assert counts["top_variation"] == 2 and counts["zero_share_by_meter"] == 4


def test_streaming_reading_features_equal_batch(spark):
    src = os.path.join(_scratch(), "readings")
    batch_in = roles.readings(spark, SF001, zeros=True)
    batch_in.write.parquet(src)
    stream_in = spark.readStream.schema(batch_in.schema).parquet(src)
    q = sfx.reading_features(stream_in).writeStream.outputMode("append").format("memory") \
        .queryName("reading_features_t").option("checkpointLocation", os.path.join(_scratch(), "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM reading_features_t")
    expected = sfx.reading_features(batch_in)
    assert streamed.count() == expected.count() > 0
    assert streamed.exceptAll(expected).count() == 0


def test_every_raw_test_row_is_scored(spark, tmp_path):
    from meterspark.plans import forecast

    raw = forecast.raw_readings(spark, SF001).where("train_val_split = 1")
    frame = forecast.engineered(spark, SF001)
    assert frame.where("train_val_split = 1").count() == raw.count() > 0
    assert frame.where("train_val_split = 1").where("meter_reading = 0").count() == raw.where("meter_reading = 0").count() > 0
    assert frame.where("train_val_split = 0").count() < forecast.raw_readings(spark, SF001).where("train_val_split = 0").count()
    report = forecast.run(spark, SF001, str(tmp_path / "out"), params=dict(maxDepth=2, maxIter=2)).first()
    assert report["missing"] == 0 and report["expected"] == report["predicted"] == raw.count()


def test_registered_boosting_has_the_reference_settings(spark, monkeypatch):
    import __spark_entry__ as entry
    from meterspark.plans import q_models

    seen = []

    def fit(train, features, label, kind="gbt", params=None):
        est = ml._estimator(kind, label, params)
        seen.append((est.getMaxDepth(), est.getMaxIter()))
        raise InterruptedError

    monkeypatch.setattr(ml, "fit", fit)
    row = {**{k: 1 for k in q_models.forecast.KEYS}, **{c: 1.0 for c in q_models.forecast.feature_columns()},
           "meter": 0, "meter_reading": 1.0, "train_val_split": 0, "_log_label": 0.5}
    monkeypatch.setattr(q_models, "_frame", lambda s, d: s.createDataFrame([tuple(row.values())], list(row)))
    monkeypatch.setattr(q_models.forecast, "row_id", lambda: F.lit(1))
    names = ["gbt_fit", "gbt_stage_loss", "per_group_fit", "per_group_rmsle", "submission"]
    for name in names:
        with pytest.raises(InterruptedError):
            entry.queries()[name](spark, "")
    assert seen == [(10, 100)] * len(names)

    def fit_l1(train, features, label, settings=q_models.boosting.Settings(), *_):
        seen.append((settings.depth, settings.rounds, settings.alpha, settings.column_share, settings.rate))
        raise InterruptedError

    monkeypatch.setattr(q_models.boosting, "fit", fit_l1)
    for name in ("gbt_squared_fit", "per_group_boosted", "learning_curve_boosted"):
        with pytest.raises(InterruptedError):
            entry.queries()[name](spark, "")
    assert seen[len(names):] == [(10, 100, 10.0, 0.3, 0.1)] * 3


def test_per_group_models_cover_null_groups_and_groups_without_training_rows(spark):
    rows = [(i, g, float(i % 7), float(i % 7) * (2 if g else 3), int(i % 3 == 0)) for i in range(120) for g in (0, 1, None)]
    rows += [(1000 + i, 5, 1.0, 4.0, 1) for i in range(4)]  # rows to score only
    df = spark.createDataFrame(rows, "id int, g int, x double, y double, train_val_split int")
    out = ml.per_group_fit(df, "g", ["x"], "y", ["id"], "gbt", dict(maxIter=3, maxDepth=2, lossType="squared"))
    assert out.columns == ["id", "g", "y", "prediction"]
    got = {(r["id"], r["g"]): r["prediction"] for r in out.collect()}
    assert set(got) == {(i, g) for i, g, _, _, s in rows if s == 1} and all(p >= 0 for p in got.values())
    with pytest.raises(ValueError, match="more than 2"):
        ml.per_group_fit(df, "g", ["x"], "y", ["id"], max_groups=2)
