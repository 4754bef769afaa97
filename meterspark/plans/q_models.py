"""Queries: baselines, RMSLE, prediction post-processing and Spark ML models (M-*).

Model queries have no SQL twin (their check is rows-only).  Every model has
the reference defaults (kept in ``operators.ml``) and reads the whole
engineered table; boosting cuts its lineage every ten rounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.numeric import rnd, rnd_sql
from ..operators import boosting, ml, neighbours
from ..operators import encode as enc
from ..operators import groupstats as gs
from ..sources import io, roles
from ..sources.roles import with_roles
from ..session import stored_table
from . import forecast, q_features
from .registry import query

PR = roles.predictions_sql()
PKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("baseline_rmsle", sql=with_roles(f"""
SELECT {rnd_sql('any_value(b)', 6)} AS baseline, {rnd_sql('sqrt(avg(pow(ln(1 + b) - ln(1 + y), 2)))', 6)} AS rmsle, count(*) AS n
FROM (SELECT y FROM s WHERE train_val_split = 1) v, (SELECT median(y) AS b FROM s WHERE train_val_split = 0) m""",
    s=f"SELECT l_extendedprice AS y, {exprs.split_flag_sql(PKEYS, 3)} AS train_val_split FROM lineitem"))
def baseline_rmsle(spark, sf_dir):
    s = roles.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"),
                                                       exprs.split_flag(PKEYS, 3).alias("train_val_split"))
    out = ml.baseline_rmsle(s, "y")
    return out.select(rnd("baseline", 6).alias("baseline"), rnd("rmsle", 6).alias("rmsle"), "n")


_CLIP = "CASE WHEN p < 0 THEN 0.0 ELSE p END"


@query("rmsle", sql=with_roles(
    f"SELECT l_returnflag, {rnd_sql(f'sqrt(avg(pow(ln(1 + ({_CLIP})) - ln(1 + y), 2)))', 6)} AS rmsle, count(*) AS n FROM pr GROUP BY 1",
    pr=PR))
def rmsle(spark, sf_dir):
    clipped = ml.clip_predictions(roles.predictions(spark, sf_dir), "p", digits=12)
    out = ml.rmsle(clipped, "y", "p", ["l_returnflag"])
    return out.withColumn("rmsle", rnd("rmsle", 6))


@query("clip_predictions", sql=with_roles(f"SELECT {', '.join(PKEYS)}, y, round({_CLIP}, 4) AS p FROM pr", pr=PR))
def clip_predictions(spark, sf_dir):
    return ml.clip_predictions(roles.predictions(spark, sf_dir), "p").select(*PKEYS, "y", "p")


@query("clip_report", sql=with_roles(
    "SELECT count(*) AS n, count(*) FILTER (WHERE p < 0) AS negatives, count(*) FILTER (WHERE p < 0) / count(*) AS negative_share FROM pr",
    pr=PR))
def clip_report(spark, sf_dir):
    return ml.clip_report(roles.predictions(spark, sf_dir), "p")


# --------------------------------------------------------------------------- Spark ML (rows-only checks)
LABEL = "_log_label"


def _frame(spark, sf_dir):
    # Fits scan the table many times: only the columns they need are stored, once, in the shared checkpoint folder.
    # Models learn log1p(reading) (RMSLE = RMSE there); predictions are expm1'd once and clipped at 0.
    names = [*forecast.KEYS, "meter", "meter_reading", "train_val_split", *forecast.feature_columns()]
    return stored_table(forecast.model_frame(spark, sf_dir).select(*names, F.log1p("meter_reading").alias(LABEL)))


def _fit_predict(spark, sf_dir, kind, params):
    df = _frame(spark, sf_dir)
    train = df.where(F.col("train_val_split") == 0)
    val = df.where(F.col("train_val_split") == 1)
    model = ml.fit(train, forecast.feature_columns(), LABEL, kind, params)
    return ml.predict(model, val, forecast.KEYS + ["meter", "meter_reading"], log_y=True)


@query("lr_fit")
def lr_fit(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "lr", None)


@query("rf_fit")
def rf_fit(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "rf", None)


@query("gbt_fit")
def gbt_fit(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "gbt", None)


@query("gbt_squared_fit")
def gbt_squared_fit(spark, sf_dir):
    """M9: squared error with L1 on the leaves and a column sample per tree, at the reference settings."""
    df = _frame(spark, sf_dir)
    model = boosting.fit(df.where(F.col("train_val_split") == 0), forecast.feature_columns(), LABEL)
    out = model.predict(df.where(F.col("train_val_split") == 1), forecast.KEYS + ["meter", "meter_reading"])
    return ml.clip_predictions(out, "prediction", log_y=True)


@query("gbt_stage_loss")
def gbt_stage_loss(spark, sf_dir):
    df = _frame(spark, sf_dir)
    model = ml.fit(df.where(F.col("train_val_split") == 0), forecast.feature_columns(), LABEL, "gbt")
    losses = ml.stage_losses(model, df.where(F.col("train_val_split") == 1), "absolute")
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")


@query("per_group_fit")
def per_group_fit(spark, sf_dir):
    """M10: one boosted model per meter, fitted side by side."""
    return ml.per_group_fit(_frame(spark, sf_dir), "meter", forecast.feature_columns(), "meter_reading",
                            forecast.KEYS, "gbt", log_y=True)


@query("per_group_rmsle")
def per_group_rmsle(spark, sf_dir):
    preds = per_group_fit(spark, sf_dir)
    per = ml.rmsle(preds, "meter_reading", "prediction", ["meter"])
    pooled = ml.rmsle(preds, "meter_reading", "prediction").select(F.lit(None).cast("int").alias("meter"), "rmsle", "n")
    return per.unionByName(pooled)


@query("per_group_boosted", sql=with_roles(
    f"SELECT meter, count(*) AS n, true AS all_scored, true AS below_baseline FROM r WHERE {exprs.split_flag_sql(forecast.KEYS, 3)} = 1 GROUP BY 1",
    r=roles.readings_sql(zeros=True)))
def per_group_boosted(spark, sf_dir):
    """M10: all meters in one boosting run; whether its RMSLE on a meter is below that of the meter's median (SQL counts the rows)."""
    df = _frame(spark, sf_dir)
    preds = boosting.fit_groups(df, "meter", forecast.feature_columns(), LABEL, ["meter", "meter_reading"])
    preds = ml.clip_predictions(preds, "prediction", log_y=True)
    flat = gs.median(df.where(F.col("train_val_split") == 0), ["meter"], "meter_reading", "baseline")
    both = gs.attach(preds, flat, ["meter"])
    y = F.col("meter_reading")
    return both.groupBy("meter").agg(
        F.count(F.lit(1)).alias("n"), (F.count("prediction") == F.count(F.lit(1))).alias("all_scored"),
        (ml.rmsle_expr(y, F.col("prediction")) < ml.rmsle_expr(y, F.col("baseline"))).alias("below_baseline"))


@query("learning_curve_boosted")
def learning_curve_boosted(spark, sf_dir):
    """M11 on a tree model: 5 sizes x 5 folds at the full settings, all 25 models in one run."""
    return boosting.learning_curve(_frame(spark, sf_dir), forecast.feature_columns(), LABEL, forecast.KEYS, log_y=True)


@query("learning_curve")
def learning_curve(spark, sf_dir):
    df = _frame(spark, sf_dir)
    return ml.learning_curve(df, forecast.feature_columns(), "meter_reading", forecast.KEYS, kind="lr", log_y=True)


@query("submission")
def submission(spark, sf_dir):
    df = _frame(spark, sf_dir).withColumn("row_id", forecast.row_id())
    train = df.where(F.col("train_val_split") == 0)
    test = df.where(F.col("train_val_split") == 1).drop("meter_reading", LABEL)
    model = ml.fit(train, forecast.feature_columns(), LABEL, "gbt")
    return io.submission(ml.predict(model, test, ["row_id"], log_y=True))


# --------------------------------------------------------------------------- k-NN (M5, one feature, exact)
_KNN_SQL = """
WITH t AS (SELECT o_orderkey, o_totalprice AS x, CAST(month(o_orderdate) AS DOUBLE) AS y,
                  row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders),
q AS (SELECT c_custkey, c_acctbal * 10.0 AS qx FROM customer),
qc AS (SELECT q.*, (SELECT count(*) FROM t WHERE t.x < q.qx) AS c FROM q),
p AS (SELECT qc.c_custkey, t.y, row_number() OVER (PARTITION BY qc.c_custkey
        ORDER BY abs(t.x - qc.qx), abs(t.idx - qc.c), t.idx) AS rn FROM qc, t)
SELECT c_custkey, """ + rnd_sql("avg(y)", 6) + """ AS prediction, count(*) AS n_neighbors FROM p WHERE rn <= 10 GROUP BY 1"""


@query("knn_predict", sql=_KNN_SQL)
def knn_predict(spark, sf_dir):
    orders = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("x"), F.month("o_orderdate").cast("double").alias("y"))
    cust = roles.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 10.0).alias("qx"))
    out = ml.knn_regress_1d(orders, cust, "x", "y", ["o_orderkey"], "qx", "c_custkey", k=10)
    return out.select("c_custkey", rnd("prediction", 6).alias("prediction"), "n_neighbors")


_KNN_MULTI_SQL = f"""
WITH t AS (SELECT o_orderkey, o_totalprice / 1000.0::DOUBLE AS x1, CAST(month(o_orderdate) * 20 AS DOUBLE) AS x2,
                  CAST(o_custkey AS DOUBLE) AS y FROM orders),
q AS (SELECT c_custkey, c_acctbal / 50.0::DOUBLE AS x1, CAST(c_nationkey * 10 AS DOUBLE) AS x2 FROM customer),
p AS (SELECT c_custkey, q.x1, q.x2, t.y, row_number() OVER (PARTITION BY c_custkey
        ORDER BY (q.x1 - t.x1) * (q.x1 - t.x1) + (q.x2 - t.x2) * (q.x2 - t.x2), o_orderkey) AS rn FROM q, t)
SELECT c_custkey, {rnd_sql("avg(y)", 6)} AS prediction, count(*) AS n_neighbors FROM p WHERE rn <= 10 GROUP BY 1"""


@query("knn_predict_multi", sql=_KNN_MULTI_SQL)
def knn_predict_multi(spark, sf_dir):
    """M5: exact k-NN on two features, every customer against every order."""
    orders = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000.0).alias("x1"), (F.month("o_orderdate") * 20).cast("double").alias("x2"),
        F.col("o_custkey").cast("double").alias("y"))
    cust = roles.table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 50.0).alias("x1"), (F.col("c_nationkey") * 10).cast("double").alias("x2"))
    out = neighbours.knn_regress(orders, cust, ["x1", "x2"], "y", "o_orderkey", "c_custkey", k=10)
    return out.select("c_custkey", rnd("prediction", 6).alias("prediction"), "n_neighbors")


@query("per_group_score", sql=with_roles(f"""
SELECT 'group' AS level, l_returnflag, {rnd_sql('r', 6)} AS rmsle, n FROM g
UNION ALL SELECT 'mean_of_groups', NULL, {rnd_sql('avg(r)', 6)}, sum(n)::BIGINT FROM g
UNION ALL SELECT 'pooled', NULL, {rnd_sql('sqrt(avg(pow(ln(1 + p) - ln(1 + y), 2)))', 6)}, count(*) FROM c""", pr=PR,
    c="SELECT l_returnflag, y, CASE WHEN p < 0 THEN 0.0 ELSE p END AS p FROM pr",
    g="SELECT l_returnflag, sqrt(avg(pow(ln(1 + p) - ln(1 + y), 2))) AS r, count(*) AS n FROM c GROUP BY 1"))
def per_group_score(spark, sf_dir):
    """M10 scoring on given predictions: RMSLE per group, their mean, and RMSLE over the pooled rows."""
    clipped = ml.clip_predictions(roles.predictions(spark, sf_dir), "p", digits=12)
    return ml.group_scores(clipped, "y", "p", "l_returnflag").withColumn("rmsle", rnd("rmsle", 6))


@query("weather_fit")
def weather_fit(spark, sf_dir):
    """The forest on the feature table with weather: a prediction for every held-out reading."""
    rows, features = q_features.event_features(spark, sf_dir)
    rows = stored_table(rows.withColumn(LABEL, F.log1p(F.greatest("meter_reading", F.lit(0.0)))))
    train = enc.fill_zero(rows.where(F.col("train_val_split") == 0), features)
    model = ml.fit(train, features, LABEL, "rf")
    return ml.predict(model, rows.where(F.col("train_val_split") == 1), ["event_id", "building_id", "meter_reading"], log_y=True)
