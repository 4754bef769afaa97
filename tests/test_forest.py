"""The forest on cells of equal bins: Spark ML's trees without draws, its accuracy with them, work that follows the cells."""

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from meterspark.operators import boosting, forest, ml

NAMES = ["a", "b", "c"]


def _table(spark, n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.randrange(9), r.randrange(12), r.randrange(2)
        rows.append((i, float(a), float(b), c, 3.0 * a - b * c + 2.0 * math.sin(a * b) + r.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y double")


def _predictions(model, df):
    return dict(ml.predict(model, df, ["id"]).collect())


def test_trees_on_all_rows_are_those_of_spark_ml(spark):
    df = _table(spark, 900).repartition(3)
    params = dict(numTrees=2, maxDepth=6, bootstrap=False)
    spark_ml = _predictions(ml.fit(df, NAMES, "y", "rf", params), df)
    for small in (1, 40, 1 << 17):  # histograms down to the leaves, both ways, one task a tree
        mine = _predictions(forest.fit(df, NAMES, "y", trees=2, depth=6, bootstrap=False, small=small), df)
        assert mine == pytest.approx(spark_ml, abs=1e-3)


def test_a_large_table_gets_the_forest_on_cells(spark, monkeypatch):
    df = _table(spark, 900).repartition(3)
    params = dict(numTrees=20, maxDepth=6)
    spark_ml = ml.fit(df, NAMES, "y", "rf", params)
    assert isinstance(spark_ml, PipelineModel)
    monkeypatch.setattr(ml, "FOREST_ROWS", 899)
    model = ml.fit(df, NAMES, "y", "rf", params)
    assert isinstance(model, boosting.Booster) and len(model.trees) == 20
    fresh = _table(spark, 400, seed=8)

    def error(m):
        return ml.predict(m, fresh, ["id", "y"]).agg(F.avg(F.pow(F.greatest("y", F.lit(0.0)) - F.col("prediction"), 2))).first()[0]

    assert error(model) == pytest.approx(error(spark_ml), rel=0.1)
    # every tree has its own draw of the rows, and a second fit makes the same draws
    roots = [t.value[0] for (t,) in model.trees]
    assert len(set(roots)) == 20
    assert [t.value[0] for (t,) in ml.fit(df, NAMES, "y", "rf", params).trees] == roots


def test_a_row_is_drawn_about_once_and_cells_do_not_grow_with_equal_rows(spark):
    df = _table(spark, 900)
    edges = boosting.split_points(df, NAMES, 32, 900)
    once, _ = forest.blocks(df, NAMES, "y", edges)
    many, _ = forest.blocks(df.crossJoin(spark.range(20)).drop("id"), NAMES, "y", edges)
    n = many.rdd.getNumPartitions() + many.count()  # a cell may be cut where a block or a partition ends
    assert many.agg(F.sum("cells")).first()[0] <= once.select("bins").rdd.map(lambda r: len(r[0]) // 3).sum() + n
    batch = many.toArrow().to_batches()
    ids = [i for b in batch for i in b.column(0).to_pylist()]
    assert len(set(ids)) == len(ids)
    drawn = sum(d.sum() for _, _, d in forest._drawn(iter(batch), 3, 10, 6, True))
    assert drawn == pytest.approx(10 * 900 * 20, rel=0.02)
    assert sum(d.sum() for _, _, d in forest._drawn(iter(batch), 3, 2, 6, False)) == 2 * 900 * 20


def test_missing_labels_and_features_are_an_error_and_missing_values_score_as_high(spark):
    df = _table(spark, 300)
    for bad in (df.withColumn("y", F.when(F.col("id") > 0, F.col("y"))), df.withColumn("b", F.when(F.col("id") > 0, F.col("b")))):
        with pytest.raises(ValueError, match="without a label or a feature"):
            forest.fit(bad, NAMES, "y", trees=2, depth=2)
    model = forest.fit(df, NAMES, "y", trees=3, depth=4)
    high, none = (_predictions(model, df.withColumn("a", F.lit(v).cast("double"))) for v in (99.0, None))
    assert high == none
