"""Cross-checks against independent pandas / plain-Python versions of the rules on seeded random frames."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterspark.operators import outliers as ol
from meterspark.operators import timeseries as tsx
from meterspark.operators import zerodays as zd


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    frames = []
    for k in range(6):
        n = int(rng.integers(1, 60))
        ts = pd.Timestamp("2016-01-01") + pd.to_timedelta(np.sort(rng.choice(24 * 90, n, replace=False)), unit="h")
        v = rng.normal(size=n).round(3)
        v[rng.random(n) < (0.9 if k == 5 else 0.35)] = np.nan
        frames.append(pd.DataFrame({"k": k, "ts": ts, "v": v}))
    pdf = pd.concat(frames, ignore_index=True)
    want = pdf.sort_values(["k", "ts"]).copy()
    want["v"] = want.groupby("k")["v"].transform(lambda s: s.interpolate(method="linear").bfill())
    df = spark.createDataFrame(pdf.astype({"ts": "datetime64[us]"})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = tsx.interpolate_linear(df, ["k"], "ts", ["v"], fill_edges=True).toPandas().sort_values(["k", "ts"])
    a = want["v"].to_numpy()
    b = got["v"].to_numpy(dtype=float)
    assert np.allclose(np.nan_to_num(a, nan=1e9), np.nan_to_num(b, nan=1e9), atol=1e-9)


def _zero_runs_loop(pdf, n_consec):
    """The rule written as a loop: per entity, observed days in order, zero runs of length >= n removed."""
    removed = set()
    for b, g in pdf.groupby("b"):
        sums = g.groupby("day")["r"].sum(min_count=0).fillna(0.0).sort_index()
        days, vals = list(sums.index), list(sums.to_numpy())
        i = 0
        while i < len(days):
            j = i
            while j < len(days) and (vals[j] == 0) == (vals[i] == 0):
                j += 1
            if vals[i] == 0 and j - i >= n_consec:
                removed.update((b, d) for d in days[i:j])
            i = j
    keep = [(b, d) not in removed for b, d in zip(pdf["b"], pdf["day"])]
    return pdf[keep]


def test_zero_runs_match_loop(spark):
    rng = np.random.default_rng(11)
    rows = []
    for b in range(8):
        days = np.sort(rng.choice(200, 80, replace=False))
        for d in days:
            for _ in range(int(rng.integers(1, 3))):
                rows.append((b, dt.date(2016, 1, 1) + dt.timedelta(days=int(d)), 0.0 if rng.random() < 0.55 else 1.0))
    pdf = pd.DataFrame(rows, columns=["b", "day", "r"])
    pdf["g"] = 1
    df = spark.createDataFrame(pdf, "b long, day date, r double, g long")
    rules = spark.createDataFrame([(1, 3)], "g long, n_consec int")
    got = zd.remove_consecutive_zero_days(df, "b", "day", "r", ["g"], rules).count()
    assert got == len(_zero_runs_loop(pdf, 3))


def test_mad_labels_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 500), "y": rng.lognormal(2, 1, 500).round(2)})
    want = {}
    for k, g in pdf.groupby("k"):
        med, mad = g["y"].median(), (g["y"] - g["y"].mean()).abs().mean()
        for i, y in g["y"].items():
            want[i] = "Outlier" if 3 < abs(0.6745 * (y - med) / mad) else "Normal"
    df = spark.createDataFrame(pdf.reset_index())
    got = {r["index"]: r["lab"].split("_")[0] for r in ol.detect_outliers(df, "y", "lab", "MAD", by="k", by_vals=["a", "b"]).collect()}
    assert got == want and "Outlier" in got.values()


def test_knn_1d_matches_brute_force(spark):
    from meterspark.operators import ml
    rng = np.random.default_rng(17)
    tr = pd.DataFrame({"tid": range(300), "g": rng.integers(0, 3, 300), "x": rng.integers(0, 40, 300).astype(float),
                       "y": rng.normal(size=300).round(3)})
    qs = pd.DataFrame({"qid": range(80), "g": rng.integers(0, 3, 80), "qx": rng.uniform(-5, 45, 80).round(1)})
    qs.loc[:9, "qx"] = 10.0                                            # many queries on one spot, exact ties
    got = ml.knn_regress_1d(spark.createDataFrame(tr), spark.createDataFrame(qs), "x", "y", ["tid"], "qx", "qid",
                            k=5, by=["g"]).toPandas().set_index("qid")["prediction"]
    for _, q in qs.iterrows():
        t = tr[tr.g == q.g].sort_values(["x", "tid"]).reset_index(drop=True)
        c = int((t.x < q.qx).sum())
        t["d"], t["di"], t["i"] = (t.x - q.qx).abs(), (t.index - c).__abs__(), t.index
        want = t.sort_values(["d", "di", "i"]).head(5)["y"].mean()
        assert abs(got[q.qid] - want) < 1e-12, q.qid
