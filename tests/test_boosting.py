"""Second-order boosting: hand-computed trees, a plain numpy twin, many models in one run."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterspark.operators import boosting as bo
from meterspark.operators import ml

ONE = bo.Settings(rounds=1, depth=1, rate=1.0, alpha=0.0, column_share=1.0, base=0.0)


def _frame(spark, n=400, parts=3):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, n), rng.normal(size=n).round(2)
    y = np.where(a > 5, 3.0, 0.5) + 0.4 * b + rng.normal(scale=0.1, size=n)
    rows = [(i, int(a[i]) if i % 11 else None, float(b[i]), float(y[i]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a int, b double, y double, g int").repartition(parts), rows


def _plain(x, y, s, missing=0):
    """One tree after the other, one node after the other, from the definition."""
    margin = np.full(len(y), s.base)

    def worth(g, h):
        return max(abs(g) - s.alpha, 0) ** 2 / (h + s.lam)

    def grow(at, level, cols, out, g):
        out[at] = s.leaf(g[at].sum(), len(at))
        best = (bo.MIN_GAIN, None)
        if level < s.depth:
            for miss in (False, True):
                for c in cols:
                    for cut in range(1, s.bins + 1):
                        left = np.where(x[at, c] == missing, miss, x[at, c] <= cut)
                        l, r = at[left], at[~left]
                        if min(len(l), len(r)) < max(1, s.min_child):
                            continue
                        gain = 0.5 * (worth(g[l].sum(), len(l)) + worth(g[r].sum(), len(r)) - worth(g[at].sum(), len(at)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (l, r))
        if best[1]:
            for side in best[1]:
                grow(side, level + 1, cols, out, g)

    for round_ in range(s.rounds):
        g, out = margin - y, np.zeros(len(y))
        grow(np.arange(len(y)), 0, s.columns(x.shape[1], round_), out, g)
        margin = margin + out
    return margin


def test_one_tree_with_l1_and_l2_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3 + [(2.0, 8.0)] * 2, "x double, y double")
    # G left = -6, right = -16; alpha 1, lam 1: leaves (6 - 1) / 4 and (16 - 1) / 3.
    out = bo.fit(df, ["x"], "y", dataclasses.replace(ONE, alpha=1.0)).predict(df, ["x"]).distinct().collect()
    assert {r["x"]: r["prediction"] for r in out} == pytest.approx({1.0: 1.25, 2.0: 5.0})
    # alpha above every gradient sum: nothing is learnt.
    out = bo.fit(df, ["x"], "y", dataclasses.replace(ONE, alpha=30.0, base=0.5)).predict(df, ["x"]).distinct().collect()
    assert {r["prediction"] for r in out} == {0.5}


def test_missing_values_go_to_the_better_side(spark):
    rows = [(1.0, 1.0), (2.0, 9.0), (None, 9.0), (float("nan"), 9.0), (1.0, 1.0), (2.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    s = dataclasses.replace(ONE, lam=0.0)
    out = bo.fit(df, ["x"], "y", s).predict(df, ["x", "y"]).collect()
    assert all(r["prediction"] == pytest.approx(r["y"]) for r in out)


@pytest.mark.parametrize("alpha,share,small", [(0.0, 1.0, 1 << 16), (4.0, 0.5, 1 << 16), (1.0, 1.0, 60), (1.0, 1.0, 0)])
def test_equal_to_the_plain_version(spark, alpha, share, small):
    df, rows = _frame(spark)
    s = bo.Settings(rounds=12 if small > 60 else 3, depth=4, rate=0.3, alpha=alpha, column_share=share, bins=16, min_child=3)
    model = bo.fit(df, ["a", "b"], "y", s, small=small)  # more rounds than bo.REFRESH: margins are stored once on the way
    got = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
    x = np.column_stack([[0 if r[1 + c] is None else np.searchsorted(e, r[1 + c], "left") + 1 for r in rows]
                         for c, e in enumerate(model.edges)])
    y = np.array([r[3] for r in rows])
    want = _plain(x, y, s)
    assert np.allclose([got[i] for i in range(len(rows))], want)
    assert model.losses(df, "y")[-1] == pytest.approx(((want - y) ** 2).mean())
    assert model.losses(df.limit(0), "y") in ([], [None] * s.rounds)


def test_groups_in_one_run_equal_separate_fits(spark):
    df, _ = _frame(spark)
    df = df.withColumn("g", F.when(F.col("g") < 2, F.col("g"))).withColumn("s", (F.col("id") % 5 == 0).cast("int"))
    df = df.unionByName(spark.createDataFrame([(9001, 1, 0.0, 1.0, 7, 1)], "id int, a int, b double, y double, g int, s int"))
    s = bo.Settings(rounds=4, depth=3, alpha=1.0, column_share=0.5)
    got = {r["id"]: r["prediction"] for r in bo.fit_groups(df, "g", ["a", "b"], "y", ["id"], s, "s").collect()}
    assert got.pop(9001) == s.base  # no training rows
    edges = bo.bin_edges(df.where("s = 0"), ["a", "b"], s.bins)
    for g in (0, 1, None):
        mine = df.where(F.col("g").eqNullSafe(F.lit(g).cast("int")))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bo, "bin_edges", lambda *_: edges)
            alone = bo.fit(mine.where("s = 0"), ["a", "b"], "y", s)
        for r in alone.predict(mine.where("s = 1 AND id < 9000"), ["id"]).collect():
            assert got.pop(r["id"]) == pytest.approx(r["prediction"])
    assert got == {}


def test_learning_curve_equals_separate_fits(spark):
    df, _ = _frame(spark)
    s = bo.Settings(rounds=3, depth=3, alpha=0.0, column_share=1.0, rate=0.5)
    curve = {r["train_size"]: r for r in bo.learning_curve(df, ["a", "b"], "y", ["id"], (0.4, 1.0), 2, s).collect()}
    assert set(curve) == {0.4, 1.0}
    from meterspark.functions import exprs
    edges, scores = bo.bin_edges(df, ["a", "b"], s.bins), []
    for k in (0, 1):
        fold = exprs.hash_bucket(["id"], 11, 2)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bo, "bin_edges", lambda *_: edges)
            model = bo.fit(df.where((fold != k) & exprs.in_share(["id"], 12, 0.4)), ["a", "b"], "y", s)
        p = model.predict(df.where(fold == k), ["y"])
        scores.append(ml.rmsle(ml.clip_predictions(p, "prediction", digits=12), "y", "prediction").first()["rmsle"])
    assert curve[0.4]["test_mean"] == pytest.approx(np.mean(scores), abs=1e-9)
    assert curve[0.4]["test_std"] == pytest.approx(np.std(scores), abs=1e-9)
    assert curve[1.0]["train_mean"] < 0.5


def test_empty_tables_null_labels_and_limits(spark):
    df, _ = _frame(spark, 20)
    empty = bo.fit(df.limit(0), ["a", "b"], "y", bo.Settings(rounds=2, depth=2))
    assert {r["prediction"] for r in empty.predict(df, ["id"]).collect()} == {0.5}
    nulls = df.withColumn("y", F.lit(None).cast("double"))
    assert {r["prediction"] for r in bo.fit(nulls, ["a"], "y", bo.Settings(rounds=1)).predict(df, ["id"]).collect()} == {0.5}
    with pytest.raises(ValueError, match="models"):
        bo.fit(df, ["a"], "y", models=63)
    assert bo.fit_groups(df.limit(0).withColumn("train_val_split", F.lit(0)), "g", ["a"], "y", ["id"]).count() == 0


@pytest.mark.parametrize("cut", [dict(column_share=1.0, alpha=1.0), dict(column_share=0.5, alpha=0.0)])
def test_rounds_by_cells_equal_rounds_by_levels(spark, cut, monkeypatch):
    df, rows = _frame(spark)
    mask = F.when(F.col("g") == 0, 1).when(F.col("g") == 1, 6).otherwise(5)
    s = bo.Settings(rounds=12, depth=4, rate=0.3, bins=16, min_child=3, **cut)
    asked, plain = [], bo._cube
    monkeypatch.setattr(bo, "_cube", lambda *a: asked.append(1) or plain(*a, chunk=5))
    # one job per round; merged by chunk first, since the table counts as having very many parts
    one = bo.fit(df, ["a", "b"], "y", s, mask, 3)
    assert len(asked) == s.rounds
    many = bo.fit(df, ["a", "b"], "y", s, mask, 3, small=60, cube=False)
    assert len(asked) == s.rounds
    who = F.col("id") % 3
    got, want = ({r["id"]: r["prediction"] for r in m.predict(df, ["id"], who).collect()} for m in (one, many))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("small", [1 << 17, 20])
def test_absolute_error_equals_spark_ml(spark, small, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    _, rows = _frame(spark, 900)
    df = spark.createDataFrame([(r[0], float(r[1] or 3), r[2], r[3]) for r in rows],
                               "id int, a double, b double, y double").repartition(3)
    params = dict(maxDepth=5, maxIter=13, minInstancesPerNode=6, stepSize=0.1, seed=6)
    at = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)
    spark_model = GBTRegressor(featuresCol="features", labelCol="y", lossType="absolute", **params).fit(at)
    want = {r["id"]: r["prediction"] for r in spark_model.transform(at).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bo.fit_absolute, "__defaults__", (small,))
        model = ml.fit(df, ["a", "b"], "y", "gbt", params)
    got = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
    assert got == pytest.approx(want)
    assert ml.stage_losses(model, df) == pytest.approx(spark_model.evaluateEachIteration(at, "absolute"))
    again = ml.load(ml.save(model, str(tmp_path / "m")))
    assert {r["id"]: r["prediction"] for r in again.transform(df).collect()} == got
    assert model.rounds()[0][1][0].value.any() and len(model.trees) == 13
    for c in ("y", "a"):  # as Spark ML
        with pytest.raises(ValueError, match="without a label or a feature"):
            ml.fit(df.withColumn(c, F.when(F.col("id") > 3, F.col(c))), ["a", "b"], "y", "gbt", params)
    odd = spark.createDataFrame([(1, None, 0.5), (2, float("nan"), -0.5)], "id int, a double, b double")
    at = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(odd)
    assert [r["prediction"] for r in model.predict(odd, ["id"]).collect()] == pytest.approx(
        [r["prediction"] for r in spark_model.transform(at).collect()])


def test_equal_rows_are_one_cell_and_spread(spark):
    df = spark.range(30_000).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).repartition(4)
    cells, _ = bo._cells(df, ["x"], "y", [np.array([0.5])])
    got = cells.selectExpr("hex(bins) AS b", "length(ys) / 8 AS n").collect()
    assert sum(r["n"] for r in got) == 30_000 and {r["b"] for r in got} == {"01", "02"}
    assert len(got) < 20 and max(r["n"] for r in got) <= 10_000


def test_linear_learning_curve_takes_two_passes_and_equals_separate_fits(spark, monkeypatch):
    df, _ = _frame(spark)
    # two columns that add up to one: collinear with the intercept, as one-hot columns are
    df = df.select("id", "b", F.lit(0.3).alias("k"), (F.col("g") == 0).cast("int").alias("c"), (F.col("g") != 0).cast("int").alias("d"), F.expm1(F.abs("y")).alias("y"))
    sizes, seen, plain = (0.4, 1.0), [], ml.fit
    want = {r["train_size"]: r for r in ml.learning_curve(df, ["b", "k", "c", "d"], "y", ["id"], sizes, 3, "lr", dict(maxIter=100), log_y=True).collect()}
    monkeypatch.setattr(ml, "fit", lambda train, *a: seen.append(train.count()) or plain(train, *a))
    got = {r["train_size"]: r for r in ml.learning_curve(df, ["b", "k", "c", "d"], "y", ["id"], sizes, 3, "lr", log_y=True).collect()}
    assert set(got) == set(want) and seen == [4] * 6  # rows per fit: the independent columns (b, c) and two, not the training rows
    for z in sizes:
        assert tuple(got[z]) == pytest.approx(tuple(want[z]), abs=1e-6)


def test_a_pass_goes_over_cells_of_equal_bins_and_not_over_rows(spark, monkeypatch):
    df, rows = _frame(spark)
    many = df.withColumn("y", F.col("y") * 2).unionByName(df).unionByName(df)  # three rows of equal bins each
    s = bo.Settings(rounds=3, depth=4, rate=0.3, alpha=1.0, column_share=1.0, bins=8)
    counts, plain = [], bo._round
    monkeypatch.setattr(bo, "_round", lambda table, units, count, *a: counts.append(count) or plain(table, units, count, *a))
    model = bo.fit(many, ["a", "b"], "y", s, F.when(F.col("y") > 1, 3).otherwise(1), 2)
    x = np.column_stack([[0 if r[1 + c] is None else np.searchsorted(e, r[1 + c], "left") + 1 for r in rows] for c, e in enumerate(model.edges)])
    assert len(counts) == 3 and all(0 < n <= len(np.unique(x, axis=0)) for c in counts for n in c.values())  # 1,200 rows before
    got = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
    y = np.array([r[3] for r in rows])
    want = _plain(np.concatenate([x] * 3), np.concatenate([2 * y, y, y]), s)
    assert np.allclose([got[i] for i in range(len(rows))], want[:len(rows)])
    sizes, cols = model.sizes(), np.arange(2)
    grid = np.column_stack(np.unravel_index(np.arange(sizes.prod()), sizes)).astype(np.uint8)
    for t in model.trees[-1]:
        assert t.cells(cols, sizes).tolist() == t.predict(grid).tolist()


def test_the_feature_table_is_read_from_what_was_written(spark, tmp_path):
    from datetime import datetime

    from meterspark.plans import forecast

    rows = [(i, 1, i % 7, i % 5, "ANR"[i % 3], datetime(2016, 1 + i % 12, 1 + i % 28, i % 24), 100.0 + i, float(i % 9), i % 4 / 10) for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, "
                          "l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i, 10.0 * i) for i in range(4)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    df = forecast.engineered(spark, str(tmp_path))
    assert "md5" not in df._jdf.queryExecution().toString()  # the split of every raw row, made anew in each pass before
    held_out = forecast.raw_readings(spark, str(tmp_path)).where("train_val_split = 1").count()
    assert 0 < df.where("train_val_split = 1").count() == held_out < df.count()
