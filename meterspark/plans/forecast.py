"""End-to-end forecasting plan (E1/E2): clean, engineer, split, fit, score.

Every step is a Spark plan; statistics of a short literal value list (outlier
bounds by meter) are computed while planning, and models are fit in jobs.  The
feature table is cut from its lineage once (reliable checkpoint in the
cluster's shared checkpoint folder) before the several fits reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import exprs
from ..operators import encode as enc
from ..operators import features as fx
from ..operators import filters as flt
from ..operators import ml
from ..operators import outliers as ol
from ..operators import timeseries as tsx
from ..operators import zerodays as zd
from ..session import drop_stored, stored_at, stored_table
from ..sources import roles

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "building_id"]
NUMERIC = ["square_feet", "l_quantity", "l_discount"]
METERS = [0, 1, 2, 3]
SEASONS = [1, 2, 3, 4]
# Winter steam and hot water, summer chilled water; runs of 3+ zero days go.
SEASONAL_RULES = [{"meter": 2, "season": 1, "n_consec": 3},
                  {"meter": 3, "season": 1, "n_consec": 3},
                  {"meter": 1, "season": 3, "n_consec": 3}]


def _target_rules(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Row removal that looks at the target (outliers by meter, odd spans, zero readings, seasonal zero runs)."""
    r = ol.keep_normal(ol.detect_outliers(train, "meter_reading", "outliers_target_meter", "MAD",
                                          by="meter", by_vals=METERS), "outliers_target_meter").drop("outliers_target_meter")
    r = r.where(flt.irregular_span_keep(month_col="month") & flt.zero_reading_keep())
    r = r.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rules = zd.rules_frame(spark, SEASONAL_RULES).select(
        F.col("meter").cast("int"), F.col("season").cast("int"), F.col("n_consec").cast("int"))
    return zd.remove_consecutive_zero_days(r, "building_id", "day", "meter_reading", ["meter", "season"], rules).drop("day")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings with the split flag of their keys."""
    r = roles.readings(spark, sf_dir, zeros=True, extra=("l_quantity", "l_discount"))
    return r.withColumn("train_val_split", exprs.split_flag(KEYS, 3))


def engineered(spark: SparkSession, sf_dir: str, holidays=cal.HOLIDAYS_2016) -> DataFrame:
    """Readings -> split flag -> unit fix -> building join -> calendar -> row removal -> log features -> one-hot.

    Rows are removed for their target on the train side only; every test row
    stays, whatever its reading and whether or not its building is known.  The joined rows and what is left of them are
    written once each: outlier bounds, logs and scaling take several passes.
    """
    r = raw_readings(spark, sf_dir).withColumn("meter_reading", exprs.unit_convert("meter_reading", "meter"))
    r, path = stored_at(r.join(roles.buildings(spark, sf_dir).withColumn("_known", F.lit(True)), "building_id", "left"))
    r = r.select("*", *[c.alias(n) for n, c in cal.calendar_parts("ts").items()])
    r = r.select("*", *[c.alias(n) for n, c in cal.calendar_features("ts", holidays).items()])
    train = _target_rules(spark, r.where((F.col("train_val_split") == 0) & F.col("_known")))
    both = stored_table(train.unionByName(r.where(F.col("train_val_split") == 1)).drop("_known"))
    drop_stored(spark, path)
    return enc.one_hot(fx.log_transform(both, NUMERIC), {"meter": METERS, "season": SEASONS})


# --------------------------------------------------------------------------- with weather
def weather_without_offset(weather: DataFrame, offsets: DataFrame) -> DataFrame:
    """site_id, n_rows: the weather rows that have no local time and that ``clean_weather`` leaves out."""
    return weather.join(offsets.where("offset_h IS NOT NULL").select("site_id"), "site_id", "left_anti") \
        .groupBy("site_id").agg(F.count(F.lit(1)).alias("n_rows"))


def clean_weather(weather: DataFrame, offsets: DataFrame) -> DataFrame:
    """Local time -> interpolate (+ edge fill) -> drop columns still NULL -> grid + interpolate (T1, T2, P9, T4)."""
    local = tsx.local_time_shift(weather, offsets)
    local = local.where(F.col("ts").isNotNull())
    cols = [c for c in local.columns if c not in ("site_id", "ts")]
    # The filled table feeds both the NULL-column check and the grid: write it once.
    filled = stored_table(tsx.interpolate_linear(local, ["site_id"], "ts", cols, fill_edges=True))
    (kept,) = enc.drop_null_columns([filled])
    keep_cols = [c for c in kept.columns if c not in ("site_id", "ts")]
    return tsx.fill_time_interpolate(kept, ["site_id"], keep_cols)


def engineer_with_weather(readings: DataFrame, buildings: DataFrame, weather: DataFrame, offsets: DataFrame,
                          key: list[str], sites: list[int], holidays=cal.HOLIDAYS_2016, light=enc.WEEKEND_LIGHT_USES,
                          top: int = 2) -> tuple[DataFrame, list[str]]:
    """(rows, feature names): readings with building, weather and calendar features, split, filled and scaled.

    Outliers per site and then per most variable building (D-e) -> buildings (J1) -> local-time weather (J3) ->
    logs (X1) -> calendar (T6) -> use group of the train rows (P13) -> one-hot sites (P12) -> feature list (P14) ->
    zero fill on the test rows (P16) -> logs scaled by the train rows (X2).  ``readings`` need ``key``, building_id,
    site_id, ts and meter_reading; ``buildings`` building_id, primary_use and numeric columns.  Readings without a
    building or a weather hour keep NULL there on the train side.  The joined rows are written once.
    """
    clean = ol.two_stage(readings, "meter_reading", "site_id", sites, "building_id", top,
                         "outliers_target_site", "outliers_target_building").drop("outliers_target_site", "outliers_target_building")
    joined = clean.join(buildings, "building_id", "left").join(clean_weather(weather, offsets), ["site_id", "ts"], "left")
    rows = stored_table(joined.withColumn("train_val_split", exprs.split_flag(key, 3)))
    first = ["square_feet"]  # the feature list begins with its log
    skip = {*key, *first, "building_id", "site_id", "train_val_split", "meter_reading"}
    numeric = first + [f.name for f in rows.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    out = fx.log_transform(rows, numeric)
    out = out.select("*", *[c.alias(n) for n, c in cal.calendar_features("ts", holidays).items()])
    out = enc.use_category(out, rows.where(F.col("train_val_split") == 0), light=light)
    out = enc.one_hot(out, {"site_id": sites})
    features = fx.select_features(out.columns)
    out = enc.fill_zero(out, features, F.col("train_val_split") == 1)
    logs = [c for c in features if c.startswith("log_")]
    out = fx.minmax_apply(out, fx.minmax_fit(out.where(F.col("train_val_split") == 0), logs), logs)
    return out.select(*key, "building_id", "meter_reading", "train_val_split", *features), features


# --------------------------------------------------------------------------- model table without weather
def feature_columns() -> list[str]:
    return ([f"log_{c}" for c in NUMERIC] + [f"meter_{m}" for m in METERS] + [f"season_{s}" for s in SEASONS]
            + ["day_of_week", "time_of_day"] + fx.FLAG_FEATURES)


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered table with scaled log features (scaler fit on train rows only)."""
    df = engineered(spark, sf_dir)
    logs = [f"log_{c}" for c in NUMERIC]
    fitted = fx.minmax_fit(df.where(F.col("train_val_split") == 0), logs)
    return fx.minmax_apply(df, fitted, logs)


def row_id() -> F.Column:
    """The reading's own keys as text (no hash, so ids cannot collide)."""
    return F.concat_ws("-", *[F.col(k).cast("string") for k in KEYS])


def run(spark: SparkSession, sf_dir: str, out_dir: str, kind: str = "gbt", params: dict | None = None,
        log_y: bool = True, reduce_to: int | None = None) -> DataFrame:
    """E1 end to end: engineer, fit on train rows, score held-out rows, write the submission CSV.

    Returns the completeness report (expected vs written predictions).
    ``reduce_to`` caps the training rows (about that many, hash-sampled).  The
    feature table is checkpointed once (shared checkpoint folder) because the
    fit scans it repeatedly; ``out_dir`` should be shared storage on a cluster.
    """
    from ..session import cut_lineage
    from ..sources import io

    df = cut_lineage(model_frame(spark, sf_dir).withColumn("row_id", row_id()))
    label = "meter_reading"
    train = df.where(F.col("train_val_split") == 0)
    if reduce_to:
        # Training-row ceiling: a stable hash sample of about reduce_to rows (one count, no top-n buffer).
        n = train.count()
        if n > reduce_to:
            train = fx.fraction_sample(train, reduce_to / n, KEYS, seed=5)
    if log_y:
        train = train.withColumn("_label", F.log1p(F.col(label)))
        label = "_label"
    test = df.where(F.col("train_val_split") == 1).drop("meter_reading")
    model = ml.fit(train, feature_columns(), label, kind, params)
    sub = io.submission(ml.predict(model, test, ["row_id"], log_y))
    io.write_csv(sub, out_dir)
    written = spark.read.schema("row_id string, meter_reading double").option("header", True).csv(out_dir)
    expected = raw_readings(spark, sf_dir).where(F.col("train_val_split") == 1).select(row_id().alias("row_id"))
    return io.missing_predictions(expected, written)
