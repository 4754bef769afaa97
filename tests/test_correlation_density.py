"""Co-moment correlations, native p-values and series densities against numpy and closed forms."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterspark.operators import correlation as co
from meterspark.operators import plotdata


def _p(spark, pairs):
    df = spark.createDataFrame([(i, float(r), int(n)) for i, (r, n) in enumerate(pairs)], "i int, r double, n long")
    return [x["p"] for x in df.select("i", co.p_value(F.col("r"), F.col("n")).alias("p")).orderBy("i").collect()]


def test_p_values_match_closed_forms(spark):
    rs = [0.0, 1e-9, 1e-3, 0.2, -0.5, 0.9, 0.999, 1 - 1e-9]
    for dof, closed in ((1, lambda r: 1 - 2 / math.pi * math.asin(r)), (2, lambda r: 1 - r), (4, lambda r: 1 - r * (1 + (1 - r * r) / 2))):
        got = _p(spark, [(r, dof + 2) for r in rs])
        assert got == pytest.approx([closed(abs(r)) for r in rs], abs=1e-12)
    zs = [0.0, 0.3, 1.96, 5.0, 20.0]
    n = 10**12
    got = _p(spark, [(z / math.sqrt(n - 2 + z * z), n) for z in zs])
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], abs=1e-10, rel=1e-6)
    assert _p(spark, [(0.5, 20)]) == pytest.approx([0.024777], abs=1e-5)
    assert _p(spark, [(1.0, 9), (-1.0, 9), (0.5, 2), (float("nan"), 9)]) == [0.0, 0.0, None, None]


@pytest.mark.parametrize("parts", [1, 5])
def test_correlations_with_offsets_and_missing_values(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    x[:, 1] = 1e9 + x[:, 0] + 0.5 * x[:, 1]
    x[:, 2] = 7.25
    rows = [[float(v) if rng.random() > 0.1 else (None, math.nan, math.inf)[int(rng.integers(3))] for v in r] for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts)
    got = {(r["var1"], r["var2"]): r for r in co.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    clean = np.array([[v if v is not None and math.isfinite(v) else math.nan for v in r] for r in rows])
    for i, p in enumerate("abcd"):
        for j, q in enumerate("abcd"):
            both = ~np.isnan(clean[:, i]) & ~np.isnan(clean[:, j])
            assert got[p, q]["n"] == both.sum() and (got[p, q]["i"], got[p, q]["j"]) == (i, j)
            if "c" in (p, q):
                assert got[p, q]["corr"] is None
            else:
                assert got[p, q]["corr"] == pytest.approx(np.corrcoef(clean[both, i], clean[both, j])[0, 1], abs=1e-8)
    one = {(r["var1"], r["var2"]): r["corr"] for r in co.corr_matrix(df, ["a", "b", "c", "d"], only_with="b").collect()}
    assert one == {k: pytest.approx(v["corr"]) if v["corr"] is not None else None for k, v in got.items() if "b" in k}


def test_no_rows_and_no_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, b double")
    for rows, diagonal in ((df, [2, 1]), (df.limit(0), [0, 0])):
        got = {(r["var1"], r["var2"]): r for r in co.corr_significance(rows, ["a", "b"]).collect()}
        assert [got["a", "a"]["n"], got["b", "b"]["n"]] == diagonal and got["a", "b"]["n"] == 0
        assert got["a", "b"]["corr"] is None and got["a", "b"]["p_value"] is None and not got["a", "b"]["significant"]
        assert {r["share_significant"] for r in got.values()} == {0.0}


def test_many_columns_plan_fast_and_read_once(spark):
    cols = [f"c{i}" for i in range(200)]
    df = spark.range(300).select(*[(F.rand(i) + F.col("id") * (i % 3)).alias(c) for i, c in enumerate(cols)])
    start = time.time()
    out = co.corr_significance(df, cols)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 6 and len(plan) < 200_000
    assert out.count() == 200 * 200


def _density(v, grid, cut):
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - cut * h, v.max() + cut * h, grid)
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi)), h


def test_density_equals_the_direct_sum(spark):
    rng = np.random.default_rng(8)
    data = {"normal": rng.normal(5, 2, 700), "spread": np.exp(rng.normal(0, 2.5, 400)), "ties": rng.integers(0, 3, 300).astype(float),
            None: rng.uniform(-1e6, 1e6, 50), "pair": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("flat", 1.0)] * 3 + [("one", 1.0), ("normal", None), ("normal", math.nan)]
    out = plotdata.density_by_category(spark.createDataFrame(rows, "k string, v double").repartition(4), "k", "v", 60)
    got = {}
    for r in out.orderBy("k", "g").collect():
        got.setdefault(r["k"], []).append((r["x"], r["density"]))
    assert set(got) == set(data)
    for k, v in data.items():
        x, want, h = _density(v, 60, 3.0)
        assert np.allclose([a for a, _ in got[k]], x)
        assert np.abs(np.array([b for _, b in got[k]]) - want).max() * h < 1e-9


def test_density_of_an_empty_table_and_no_shuffled_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0)], "k string, v double")
    assert plotdata.density_by_category(df.limit(0), "k", "v").count() == 0
    plan = plotdata.density_by_category(df, "k", "v", 20)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("_v" not in line for line in moved) and "SortMergeJoin [_v" not in plan
