"""Exact quantiles: narrowed ranges against numpy, including groups larger than the counters of a range."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterspark.operators import groupstats as gs


def _pandas_quantiles(pdf, probs):
    out = {}
    for k, g in pdf.groupby("k"):
        v = g["v"].dropna().to_numpy()
        out[k] = [float(np.quantile(v, p)) for p in probs] if len(v) else None
    return out


@pytest.mark.parametrize("cells", [16, 1000, 1 << 16])
def test_narrowed_quantiles_match_numpy(spark, cells):
    rng = np.random.default_rng(7)
    n = 6000
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "b", "c"], size=n, p=[0.7, 0.25, 0.05]),
        # heavy ties and a long tail
        "v": np.where(rng.random(n) < 0.3, 0.0, np.round(rng.lognormal(3, 1.5, n), 1)),
    })
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in gs.quantiles(df, ["k"], "v", probs, cells=cells).collect()}
    want = _pandas_quantiles(pdf, probs)
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=0, atol=1e-9), (k, got[k], want[k])


def test_global_median_and_single_row(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, 2.0)], "id int, v double")
    assert gs.median(df, [], "v", "m").first()["m"] == 2.0
    one = spark.createDataFrame([("x", 3.5)], "k string, v double")
    assert gs.median(one, ["k"], "v", "m").first()["m"] == 3.5


def test_all_null_group_absent(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in gs.median(df, ["k"], "v", "m").collect()}
    assert got == {"b": 1.0}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 3.0)], "k string, v double")
    assert gs.median(df, ["k"], "v", "m").first()["m"] == 2.0


def test_repartition_invariant(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("k"), (F.col("id") * 1.5 % 101).alias("v"))
    a = sorted(gs.median(df, ["k"], "v", "m", cells=100).collect())
    b = sorted(gs.median(df.repartition(13), ["k"], "v", "m", cells=100).collect())
    assert a == b


def test_prefix_sums_exact_for_any_partition_count(spark):
    """Regression: the range-partitioned rows feed two branches and must agree (was wrong at 8 partitions)."""
    from meterspark.operators import ordered
    a = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).cast("double").alias("x"), F.lit(1).alias("t"))
    b = spark.range(0, 700).select((F.col("id") * 13.7).alias("x"), F.lit(0).alias("t"))
    u = a.unionByName(b)
    for parts in (3, 4, 8, 16):
        got = ordered.running_total(u, [F.col("x").asc(), F.col("t").asc()], F.col("t"), "c", partitions=parts).toPandas()
        got = got.sort_values(["x", "t"])
        assert (got["c"].to_numpy() == np.cumsum(got["t"].to_numpy())).all(), parts


HARD = {
    "infinite": [float("inf"), float("-inf"), 1.0, 2.0, 3.0] * 9,
    "denormal": [5e-324 * k for k in range(40)],
    "spread": [2.0**k for k in range(-20, 20)] + [-(2.0**k) for k in range(-20, 20, 5)],
    "widest": [1.7e308, -1.7e308, 0.0, -0.0] * 8 + [1.0],
    "one value": [7.25] * 50,
    "neighbours": [1.0] * 30 + [1.0 + 2**-52 * k for k in range(30)],
    None: [4.0, 1.0, 2.0],
}


def test_ranges_narrow_whatever_the_values(spark):
    df = spark.createDataFrame([(k, v) for k, values in HARD.items() for v in values], "k string, v double").repartition(3)
    probs = [0.3, 0.5, 1.0]
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in gs.quantiles(df, ["k"], "v", probs, cells=24).collect()}
    assert set(got) == set(HARD)
    for k, values in HARD.items():
        ranked = sorted(values)
        for p, q in zip(probs, got[k]):
            at = int(np.floor(p * (len(values) - 1)))
            low, high = ranked[at], ranked[min(at + 1, len(values) - 1)]
            assert low <= q <= high or np.isnan(q) and np.isinf([low, high]).any(), (k, p)


def test_rows_of_large_groups_are_not_shuffled(spark):
    """At a tiny broadcast threshold only counters meet: no sort-merge join and no exchange below the counting."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 10_007).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        out = gs.quantiles(df, ["k"], "v", [0.25, 0.5], cells=500)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["k"]: (r["q0"], r["q1"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    for exchange in plan.split("Exchange hashpartitioning")[1:]:
        below = exchange.split("\n")[1]
        assert "HashAggregate" in below or "Window" in below or "Project" in below
    pdf = df.toPandas()
    assert got == {k: (float(np.quantile(g, 0.25)), float(np.quantile(g, 0.5))) for k, g in pdf.groupby("k")["v"]}


def test_more_large_groups_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(gs.materialize_small, "__defaults__", (2,))
    df = spark.range(2_000).select((F.col("id") % 5).alias("k"), ((F.col("id") * 31) % 997).cast("double").alias("v"))
    got = {r["k"]: r["m"] for r in gs.median(df, ["k"], "v", "m", cells=50).collect()}
    assert got == {k: float(np.median(g)) for k, g in df.toPandas().groupby("k")["v"]}
