"""Unit fixtures (5-20 rows) for the semantics listed in the survey's edge-case section."""

import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import rows
from meterspark.functions import calendar as cal
from meterspark.functions import exprs
from meterspark.operators import encode as enc
from meterspark.operators import features as fx
from meterspark.operators import filters as flt
from meterspark.operators import ml
from meterspark.operators import outliers as ol
from meterspark.operators import profile as pf
from meterspark.operators import timeseries as tsx
from meterspark.operators import zerodays as zd

T = dt.datetime


# ---------------------------------------------------------------- intervals
def test_count_intervals_worked_example(spark):
    data = [4, 4, 1, 18, 2, 15, 6, 14, 2, 16, 2, 17, 12, 3, 12, 4, 15, 5, 17]
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    got = dict(rows(pf.count_intervals(df, "x", [10, 20])))
    assert got == {10: 10, 20: 9}


def test_count_intervals_edges(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (25.0,), (None,), (float("nan"),)], "x double")
    got = dict((k, v) for k, v in rows(pf.count_intervals(df, "x", [20, 10])))
    # bound-equal values fall in that bucket; above the last -> NULL key; NaN -> first bucket
    assert got == {10: 2, 20: 1, None: 1}


# ---------------------------------------------------------------- series
def test_interpolation_positional_and_edges(spark):
    data = [("a", T(2020, 1, 1, h), v) for h, v in enumerate([None, 1.0, None, None, 4.0, None, None])]
    data += [("b", T(2020, 1, 1, 0), None), ("b", T(2020, 1, 1, 1), None)]          # all-null series
    data += [("c", T(2020, 1, 1, 0), 7.0)]                                            # one row
    data += [("d", T(2020, 1, 1, 0), 0.0), ("d", T(2020, 1, 1, 5), None), ("d", T(2020, 1, 3, 0), 10.0)]  # uneven spacing
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v double")
    got = {(k, t): v for k, t, v in rows(tsx.interpolate_linear(df, ["k"], "ts", ["v"]), "k", "ts", "v")}
    a = [got[("a", T(2020, 1, 1, h))] for h in range(7)]
    assert a[0] is None and a[1:] == [1.0, 2.0, 3.0, 4.0, 4.0, 4.0]
    assert got[("b", T(2020, 1, 1, 0))] is None
    assert got[("c", T(2020, 1, 1, 0))] == 7.0
    assert got[("d", T(2020, 1, 1, 5))] == 5.0        # by position, not by elapsed time
    filled = {(k, t): v for k, t, v in rows(tsx.interpolate_linear(df, ["k"], "ts", ["v"], fill_edges=True), "k", "ts", "v")}
    assert filled[("a", T(2020, 1, 1, 0))] == 1.0


def test_interpolation_across_chunks_equals_single_chunk(spark):
    data = [("s", T(2020, 1, 1) + dt.timedelta(days=d), (float(d) if d % 9 == 0 else None)) for d in range(100)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v double")
    monthly = rows(tsx.interpolate_linear(df, ["k"], "ts", ["v"]), "ts", "v")
    one = rows(tsx.interpolate_linear(df, ["k"], "ts", ["v"], chunk=F.lit(0)), "ts", "v")
    daily = rows(tsx.interpolate_linear(df, ["k"], "ts", ["v"], chunk=F.date_trunc("day", "ts")), "ts", "v")
    assert monthly == one == daily
    assert dict(monthly)[T(2020, 1, 5)] == 4.0


def test_back_forward_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("a", 3, None), ("a", 4, 5.0), ("a", 5, None)],
                               "k string, t int, v double")
    got = [v for _, v in rows(tsx.back_forward_fill(df, ["k"], "t", ["v"], chunk=F.lit(0)), "t", "v")]
    assert got == [3.0, 3.0, 5.0, 5.0, 5.0]


# ---------------------------------------------------------------- grid
def test_grid_fill_and_shift(spark):
    df = spark.createDataFrame([(0, T(2020, 1, 1, 0), 1.0), (0, T(2020, 1, 1, 3), 4.0), (1, T(2020, 1, 1, 1), 2.0),
                                (1, T(2020, 1, 1, 1, 30), 9.0)], "site_id int, ts timestamp_ntz, v double")
    g = tsx.fill_time_grid(df, ["site_id"])
    got = rows(g, "site_id", "ts", "v")
    assert len(got) == 8                                   # 2 sites x 4 hours, off-grid row gone
    assert (1, T(2020, 1, 1, 1, 30), 9.0) not in got
    offs = spark.createDataFrame([(0, -5)], "site_id int, offset_h int")
    shifted = dict(((s, v), t) for s, t, v in rows(tsx.local_time_shift(df, offs), "site_id", "ts", "v"))
    assert shifted[(0, 1.0)] == T(2019, 12, 31, 19)
    assert shifted[(1, 2.0)] is None                       # unknown site


# ---------------------------------------------------------------- zero runs
def _zero_fixture(spark):
    d = dt.date
    data = []

    def add(b, meter, season, day, reading, n=1):
        for _ in range(n):
            data.append((b, meter, season, day, reading))
    # building 1, meter 2, winter: runs of 2, 3 zero days (3 removed), a missing day inside a 4-run
    for day in [d(2016, 1, 1), d(2016, 1, 2)]:
        add(1, 2, 1, day, 0.0)
    add(1, 2, 1, d(2016, 1, 3), 5.0)
    for day in [d(2016, 1, 4), d(2016, 1, 5), d(2016, 1, 6)]:
        add(1, 2, 1, day, 0.0, n=2)                        # several rows per day
    add(1, 2, 1, d(2016, 1, 7), 1.0)
    for day in [d(2016, 1, 8), d(2016, 1, 10), d(2016, 2, 28), d(2016, 12, 1)]:  # gap day, Feb -> Dec bridge
        add(1, 2, 1, day, 0.0)
    add(1, 0, 1, d(2016, 1, 4), 0.0)                       # other meter untouched
    add(1, 2, 3, d(2016, 7, 4), 0.0)                       # other season untouched
    return spark.createDataFrame(data, "b int, meter int, season int, day date, r double")


def test_remove_consecutive_zero_days(spark):
    df = _zero_fixture(spark)
    rules = spark.createDataFrame([(2, 1, 3)], "meter int, season int, n_consec int")
    out = zd.remove_consecutive_zero_days(df, "b", "day", "r", ["meter", "season"], rules)
    kept = rows(out, "meter", "season", "day")
    days = [k[2] for k in kept if k[0] == 2 and k[1] == 1]
    assert dt.date(2016, 1, 1) in days and dt.date(2016, 1, 2) in days          # run of 2 stays
    assert dt.date(2016, 1, 5) not in days                                      # run of 3 goes
    assert dt.date(2016, 12, 1) not in days and dt.date(2016, 1, 10) not in days  # bridged run of 4 goes
    assert (0, 1, dt.date(2016, 1, 4)) in kept and (2, 3, dt.date(2016, 7, 4)) in kept
    assert out.count() == df.count() - 6 - 4


# ---------------------------------------------------------------- outliers
def test_outliers_zero_spread_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 5.0)] + [("b", 1.0)] * 8 + [("b", 100.0),
                                ("c", None), ("c", 2.0), ("d", 3.0)], "k string, y double")
    mad = {(k, y): lab for k, y, lab in rows(ol.detect_outliers(df, "y", "lab", "MAD", by="k", by_vals=["a", "b", "c"]), "k", "y", "lab")}
    assert mad[("a", 5.0)] == "Normal_k-a"                 # 0/0 -> normal
    assert mad[("c", None)] == "Normal_k-c"                # missing -> normal in MAD mode
    assert mad[("d", 3.0)] is None                         # category not listed
    q = {(k, y): lab for k, y, lab in rows(ol.detect_outliers(df, "y", "lab", "Quartile", by="k", by_vals=["a", "c"]), "k", "y", "lab")}
    assert q[("c", None)] == "Outlier_k-c"                 # missing -> outlier in quartile mode
    assert q[("a", 5.0)] == "Outlier_k-a"                  # iqr 0, strict bounds
    kept = ol.keep_normal(ol.detect_outliers(df, "y", "lab", "MAD", by="k", by_vals=["b"]), "lab")
    assert kept.count() == df.count() - 1                  # 100.0 is the only outlier in b; NULL labels kept


def test_outlier_relabel_keeps_old(spark):
    df = spark.createDataFrame([("a", 1.0, "Outlier_x"), ("a", 1.0, None)], "k string, y double, lab string")
    got = sorted(r["lab"] for r in ol.detect_outliers(df, "y", "lab", "MAD", by="k", by_vals=["a"]).collect())
    assert got == ["Normal_k-a", "Outlier_x"]


def test_stats_by_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", None)], "k string, y double")
    got = {r["k"]: r for r in pf.stats_by_value(df, "k", "y").collect()}
    assert got["a"]["count"] == 3 and got["a"]["median"] == 2.0 and got["a"]["mad"] == round(1.4826, 2)
    assert got["b"]["count"] == 2 and got["b"]["std"] == 0.0   # single value: std NULL -> 0


# ---------------------------------------------------------------- labels
def test_value_share_and_sparse_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["a"] * 5 + ["b"] * 3 + ["c"] * 1 + ["d"] * 1 + [None] * 4], "c string")
    got = rows(pf.value_share(df, "c"), "label", "volume", "percent", "cumulative_perc", "rank")
    assert got[0] == ("a", 5, 0.5, 0.5, 1)
    assert [g[0] for g in sorted(got, key=lambda g: g[4])] == ["a", "b", "c", "d"]   # ties by label
    assert math.isclose(sorted(got, key=lambda g: g[4])[-1][3], 1.0)
    sparse = [r["label"] for r in enc.sparse_labels(df, "c", 0.1).collect()]
    assert sorted(sparse) == ["c", "d"]                                               # share exactly on threshold
    comb = rows(enc.combine_sparse_labels(df, "c", enc.sparse_labels(df, "c", 0.1)), "c")
    assert ("NonTraditionalUsage",) in comb and (None,) in comb


def test_remove_sparse_labels_protects_rows(spark):
    df = spark.createDataFrame([(x, 0) for x in ["a"] * 8 + ["b"]] + [("c", 1)], "c string, split int")
    out = enc.remove_sparse_labels(df, "c", 0.85, ignore_col="split", ignore_val=1)
    assert sorted(r["c"] for r in out.collect()) == ["a"] * 8 + ["c"]


def test_label_encode_and_mode(spark):
    df = spark.createDataFrame([("x",), ("b",), ("x",), (None,), ("m",)], "c string")
    enc_df, dim = enc.label_encode(df, "c", "code")
    assert sorted(rows(dim, "label", "code")) == [("b", 0), ("m", 1), ("x", 2)]
    ties = spark.createDataFrame([("g", 3.0), ("g", 1.0), ("g", 3.0), ("g", 1.0), ("g", None)], "k string, v double")
    assert pf.group_mode(ties, ["k"], "v").first()["mode"] == 1.0


# ---------------------------------------------------------------- calendar
def test_calendar_features(spark):
    stamps = [T(2016, 3, 7, h) for h in (0, 6, 7, 8, 9, 12, 13, 18, 19, 23)] + [T(2016, 3, 5, 10), T(2016, 3, 6, 10),
                                                                                  T(2016, 12, 26, 10), T(2016, 7, 4, 10)]
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
    got = {r["ts"]: r for r in df.select("ts", *[c.alias(n) for n, c in cal.calendar_features("ts").items()]).collect()}
    tod = [got[T(2016, 3, 7, h)]["time_of_day"] for h in (0, 6, 7, 8, 9, 12, 13, 18, 19, 23)]
    assert tod == [4, 4, 1, 1, 1, 1, 2, 2, 3, 3]
    bus = [got[T(2016, 3, 7, h)]["is_business_hr"] for h in (0, 6, 7, 8, 9, 12, 13, 18, 19, 23)]
    assert bus == [0, 0, 0, 0, 1, 1, 1, 1, 0, 0]
    assert got[T(2016, 3, 5, 10)]["day_of_week"] == 5 and got[T(2016, 3, 5, 10)]["is_workday"] == 0
    assert got[T(2016, 3, 6, 10)]["is_business_hr"] == 0
    assert got[T(2016, 12, 26, 10)]["is_holiday"] == 1 and got[T(2016, 12, 26, 10)]["is_business_hr"] == 0
    assert got[T(2016, 12, 26, 10)]["season"] == 1 and got[T(2016, 7, 4, 10)]["season"] == 3
    months = spark.range(1, 13).select(F.make_timestamp_ntz(F.lit(2016), "id", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"))
    seasons = [r[0] for r in months.select(cal.season("ts")).collect()]
    assert seasons == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]


# ---------------------------------------------------------------- log / scaling
def test_log_transform_shift(spark):
    df = spark.createDataFrame([(-2.0, 5.0), (0.0, 1.0), (None, 3.0)], "a double, b double")
    got = rows(fx.log_transform(df, ["a", "b"]), "a", "log_a", "log_b")
    assert any(a == -2.0 and math.isclose(la, 0.0) for a, la, _ in got)
    assert any(a == 0.0 and math.isclose(lb, math.log(4.0)) for a, _, lb in got)
    pos = spark.createDataFrame([(1.0,), (math.e,)], "a double")
    assert sorted(round(r[0], 9) for r in fx.log_transform(pos, ["a"]).select("log_a").collect()) == [0.0, 1.0]


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (3.0, 2.0, 0), (5.0, 2.0, 1)], "x double, c double, split int")
    fitted = fx.minmax_fit(df.where("split = 0"), ["x", "c"])
    got = rows(fx.minmax_apply(df, fitted, ["x", "c"]), "x", "c")
    assert got == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]


# ---------------------------------------------------------------- predictions
def test_clip_and_rmsle(spark):
    df = spark.createDataFrame([(1.0, -3.0), (2.0, 2.0), (0.0, 0.5)], "y double, p double")
    clipped = ml.clip_predictions(df, "p")
    assert sorted(r["p"] for r in clipped.collect()) == [0.0, 0.5, 2.0]
    r = ml.rmsle(clipped, "y", "p").first()["rmsle"]
    want = math.sqrt(((math.log1p(0) - math.log1p(1)) ** 2 + 0 + (math.log1p(0.5)) ** 2) / 3)
    assert math.isclose(r, want)
    rep = ml.clip_report(df, "p").first()
    assert rep["negatives"] == 1 and math.isclose(rep["negative_share"], 1 / 3)
    logged = ml.clip_predictions(spark.createDataFrame([(math.log1p(4.0),)], "p double"), "p", log_y=True)
    assert logged.first()["p"] == 4.0


# ---------------------------------------------------------------- pairs
def test_corr_pairwise_complete_and_pvalue(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, 1.0), (3.0, None, 1.0), (4.0, 8.2, 1.0), (5.0, 9.9, 1.0)],
                               "a double, b double, c double")
    m = {(r["var1"], r["var2"]): r for r in pf.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")]["n"] == 4 and m[("a", "b")]["corr"] > 0.99
    assert m[("a", "c")]["corr"] is None or math.isnan(m[("a", "c")]["corr"])   # constant column


# ---------------------------------------------------------------- encodings and filters
def test_maps_split_and_format(spark):
    df = spark.createDataFrame([(0,), (3,), (9,)], "m int")
    named = rows(enc.map_labels(df, "m", exprs.METER_NAMES, out="name"), "m", "name")
    assert named == [(0, "electricity"), (3, "hotwater"), (9, None)]
    f = spark.createDataFrame([(999.0,), (1000.0,), (-1234567.0,), (2.5e15,)], "x double")
    assert rows(f.select(exprs.human_format("x").alias("s")), "s") == [("-1.23M",), ("1.00K",), ("2.50P",), ("999.00",)]
    assert enc.needs_encoding(df, "m", encode_to_int=False) and not enc.needs_encoding(df, "m", encode_to_int=True)


def test_null_safe_filters(spark):
    df = spark.createDataFrame([(0, 0.0, 3, 0), (0, 0.0, 7, 0), (None, 0.0, 3, 1), (0, None, 3, 0)],
                               "site_id int, meter_reading double, month int, meter int")
    kept = df.where(flt.irregular_span_keep())
    assert kept.count() == 3
    rep = {r["step"]: r["removed"] for r in flt.removal_report(df, [("span", flt.irregular_span_keep()),
                                                                     ("zero", flt.zero_reading_keep())]).collect()}
    assert rep == {"span": 1, "zero": 1}


def test_select_features():
    cols = ["ts", "log_square_feet", "log_wind_speed", "log_air_temperature", "is_workday"]
    assert fx.select_features(cols) == ["log_square_feet", "log_air_temperature", "is_workday", "is_holiday", "is_business_hr"]


def test_fixed_mappers(spark):
    offs = {r["site_id"]: r["offset_h"] for r in enc.site_offsets_frame(spark).collect()}
    assert len(offs) == 16 and offs[0] == -5 and offs[4] == -8 and offs[12] == 0
    df = spark.createDataFrame([("Office",), ("Education",), ("Office",)], "primary_use string")
    m = dict(rows(enc.primary_use_map(df), "code", "label"))
    assert m == {0: "Education", 1: "Office", 99: "NonTraditionalUsage"}


def test_use_category_seen_and_unseen(spark):
    df = spark.createDataFrame([("Retail",), ("Office",), ("Parking",), (None,)], "primary_use string")
    train = spark.createDataFrame([("Office",)], "primary_use string")
    got = dict(rows(enc.use_category(df, train), "primary_use", "use_categ"))
    assert got == {"Retail": 0, "Office": 1, "Parking": None, None: None}


def test_pivot_duplicates_do_not_multiply(spark):
    df = spark.createDataFrame([(T(2020, 1, 1, 0), 1, 2.0), (T(2020, 1, 1, 0), 1, 5.0), (T(2020, 1, 1, 0), 2, 3.0),
                                (T(2020, 1, 1, 1), 2, None)], "ts timestamp_ntz, site_id int, v double")
    p = tsx.pivot_series(df, "ts", "site_id", "v", [1, 2, 3], "site_")
    got = {r["ts"]: (r["site_1"], r["site_2"], r["site_3"]) for r in p.collect()}
    assert got == {T(2020, 1, 1, 0): (5.0, 3.0, None), T(2020, 1, 1, 1): (None, None, None)}
    miss = {r["column_name"]: r["volume"] for r in pf.missing_table(p, ["site_1", "site_2", "site_3"]).collect()}
    assert miss == {"site_1": 1, "site_2": 1, "site_3": 2}


def test_date_coverage_and_missing_predictions(spark):
    from meterspark.sources import io
    a = spark.createDataFrame([(T(2020, 1, 1, 5),), (T(2020, 1, 2, 0),), (T(2020, 1, 2, 7),)], "t timestamp_ntz")
    b = spark.createDataFrame([(T(2020, 1, 2, 1),), (T(2020, 1, 3, 0),)], "t timestamp_ntz")
    r = pf.date_coverage_diff(a, "t", b, "t").first()
    assert (r["n_dates_1"], r["n_dates_2"], r["missing_in_2"], r["missing_in_1"], r["equal"]) == (2, 2, 1, 1, False)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    preds = spark.createDataFrame([(1, 0.5), (3, 1.0), (4, 2.0)], "row_id long, prediction double")
    m = io.missing_predictions(ids, preds).first()
    assert (m["expected"], m["predicted"], m["missing"], m["abs_diff"]) == (3, 3, 1, 0)


def test_table_lengths(spark):
    t = {"a": spark.range(3), "b": spark.range(5).selectExpr("id", "id * 2 AS x")}
    assert rows(pf.table_lengths(t), "table_name", "n_rows", "n_cols") == [("a", 3, 1), ("b", 5, 2)]


def test_change_encoding_and_null_columns(spark):
    df = spark.createDataFrame([(0, 1.0, None), (2, None, None)], "meter int, a double, b double")
    named = enc.change_encoding(df, {"meter": exprs.METER_NAMES}, ["meter", "site_id"], encode_to_int=False)
    assert rows(named, "meter") == [("electricity",), ("steam",)]
    back = enc.change_encoding(named, {"meter": exprs.METER_NAMES}, ["meter"], encode_to_int=True)
    assert rows(back, "meter") == [(0,), (2,)]
    assert enc.change_encoding(df, {"meter": exprs.METER_NAMES}, ["meter"], encode_to_int=True).columns == df.columns
    (kept, other) = enc.drop_null_columns([df, df.withColumnRenamed("a", "a2")])
    assert kept.columns == ["meter"] and other.columns == ["meter", "a2"]
    rep = {r["column_name"]: r["dropped"] for r in enc.sparse_feature_report(df, thresh=0.5).collect()}
    assert rep == {"meter": False, "a": False, "b": True}      # a is exactly on the threshold: kept
    three = spark.createDataFrame([(None,), (1.0,), (2.0,)], "c double")
    share = enc.sparse_feature_report(three, thresh=0.333, compat_rounding=True).first()
    assert share["null_share"] == 0.333 and share["dropped"] is False   # rounded to 0.1 % first


def test_table_map_and_default_offsets(spark):
    dim = spark.createDataFrame([(0, "electricity"), (1, "chilledwater")], "key int, value string")
    df = spark.createDataFrame([(0,), (1,), (5,)], "m int")
    assert rows(enc.map_labels_table(df, "m", dim, out="name"), "m", "name") == [(0, "electricity"), (1, "chilledwater"), (5, None)]
    names = spark.createDataFrame([("chilledwater",), ("x",)], "n string")
    assert rows(enc.map_labels_table(names, "n", dim, reverse=True, out="code"), "n", "code") == [("chilledwater", 1), ("x", None)]
    w = spark.createDataFrame([(4, T(2016, 1, 1, 10)), (99, T(2016, 1, 1, 10))], "site_id int, ts timestamp_ntz")
    got = dict(rows(tsx.local_time_shift(w), "site_id", "ts"))
    assert got == {4: T(2016, 1, 1, 2), 99: None}


def test_stats_by_value_mad_null_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None)], "k string, y double")
    assert pf.stats_by_value(df, "k", "y").first()["mad"] == round(1.4826, 2)
    assert pf.stats_by_value(df, "k", "y", mad_propagates_nulls=True).first()["mad"] == 0.0


def test_drop_sparse_features(spark):
    a = spark.createDataFrame([(1, None, None, "x"), (2, None, 1.0, None), (3, 1.0, 2.0, "y")], "id int, a double, b double, c string")
    other = spark.createDataFrame([(9, 5.0)], "id int, a double")
    first, second = enc.drop_sparse_features([a, other], 0.5)
    assert first.columns == ["id", "b", "c"] and second.columns == ["id"]
    assert enc.drop_sparse_features([a], 0.3)[0].columns == ["id"]
    assert enc.drop_sparse_features([other], 0.3, reference=a)[0].columns == ["id"]
    assert enc.drop_sparse_features([a.limit(0)], 0.3)[0].columns == a.columns
