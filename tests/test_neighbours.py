"""k-NN on several features against all distances."""

import numpy as np
import pytest

from meterspark.operators import neighbours as nb


def _want(train, queries, k):
    out = {}
    good = sorted((t for t in train if t[1] is not None and all(v is not None and np.isfinite(v) for v in t[2:])), key=lambda t: t[0])
    x = np.array([t[2:] for t in good], float)
    for q in queries:
        if any(v is None or not np.isfinite(v) for v in q[1:]):
            continue
        d = np.zeros(len(x))
        for i, v in enumerate(q[1:]):
            d += (x[:, i] - v) ** 2
        near = np.argsort(d, kind="stable")[:k]
        out[q[0], *q[1:]] = (np.mean([good[i][1] for i in near]), len(near))
    return out


@pytest.mark.parametrize("k,part_rows", [(1, 50_000), (10, 100)])
def test_equal_to_all_distances(spark, k, part_rows):
    rng = np.random.default_rng(2)
    train = [(i, float(rng.normal()), *map(float, rng.normal(size=3).round(1))) for i in range(900)]
    train += [(1000 + i, float(i), 0.0, 0.0, 0.0) for i in range(450)]  # a third of the rows is one point
    train += [(2000, None, 0.0, 0.0, 0.0), (2001, 5.0, None, 0.0, 0.0), (2002, 5.0, float("nan"), 0.0, 0.0), (2003, 9.0, 1e8, -1e8, 0.0)]
    queries = [(f"q{i}", *map(float, rng.normal(size=3).round(1))) for i in range(60)]
    queries += [("zero", 0.0, 0.0, 0.0), ("far", 1e9, 0.0, 0.0), ("twice", 0.1, 0.2, 0.3), ("twice", 0.1, 0.2, 0.3), ("twice", 3.0, 0.0, 0.0),
                ("none", None, 0.0, 0.0), (None, 0.5, 0.5, 0.5)]
    t = spark.createDataFrame(train, "id long, y double, a double, b double, c double").repartition(4)
    q = spark.createDataFrame(queries, "q string, a double, b double, c double")
    got = nb.knn_regress(t, q, ["a", "b", "c"], "y", "id", "q", k, part_rows).collect()
    want = _want(train, queries, k)
    assert len(got) == len(want)
    for r in got:
        assert (r["prediction"], r["n_neighbors"]) == pytest.approx(want[r["q"], r["a"], r["b"], r["c"]])


def test_fewer_rows_than_k_and_empty_tables(spark):
    t = spark.createDataFrame([(1, 2.0, 0.0, 0.0), (2, 4.0, 1.0, 1.0)], "id long, y double, a double, b double")
    q = spark.createDataFrame([(7, 0.0, 0.0)], "q long, a double, b double")
    assert [tuple(r) for r in nb.knn_regress(t, q, ["a", "b"], "y", "id", "q", 5).collect()] == [(7, 0.0, 0.0, 3.0, 2)]
    assert nb.knn_regress(t.limit(0), q, ["a", "b"], "y", "id", "q").count() == 0
    assert nb.knn_regress(t, q.limit(0), ["a", "b"], "y", "id", "q").count() == 0
