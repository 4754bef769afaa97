"""Model fitting and evaluation with Spark ML (M-*).

Fits are MLlib estimators on DataFrames, or ``boosting`` (distributed tree
building, no collect of training rows beyond a stated few).  Scores are aggregates.  A per-category model
loop runs one distributed fit per category value, several side by side; the
number of categories is checked against a stated bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_table
from . import boosting, forest
from . import groupstats as gs

# Reference model settings (used as defaults).
RF_PARAMS = dict(numTrees=50, maxDepth=10, seed=6, featureSubsetStrategy="all")
GBT_ABS_PARAMS = dict(lossType="absolute", maxDepth=10, maxIter=100, minInstancesPerNode=6, stepSize=0.1, seed=6)
GBT_SQ_PARAMS = dict(lossType="squared", maxDepth=10, maxIter=100, stepSize=0.1, featureSubsetStrategy="0.3", seed=6)


def rmsle_expr(y, p):
    return F.sqrt(F.avg(F.pow(F.log1p(p) - F.log1p(y), 2)))


def rmsle(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared log error (per group if ``by``)."""
    return df.groupBy(*by).agg(rmsle_expr(F.col(y), F.col(p)).alias("rmsle"), F.count(F.lit(1)).alias("n"))


def clip_predictions(df: DataFrame, p: str, log_y: bool = False, digits: int = 4, out: str | None = None) -> DataFrame:
    """expm1 when the model was trained on log1p(y); negatives -> 0; rounded."""
    v = F.expm1(F.col(p)) if log_y else F.col(p)
    v = F.when(v < 0, F.lit(0.0)).otherwise(v)
    return df.withColumn(out or p, F.round(v, digits))


def clip_report(df: DataFrame, p: str, log_y: bool = False) -> DataFrame:
    """One pass: rows, negative predictions and their share."""
    v = F.expm1(F.col(p)) if log_y else F.col(p)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v < 0).alias("negatives")) \
        .withColumn("negative_share", F.try_divide(F.col("negatives"), F.col("n")))


def baseline_rmsle(df: DataFrame, y: str, split_col: str = "train_val_split") -> DataFrame:
    """Median of the training target as constant prediction, RMSLE on validation rows."""
    med = gs.median(df.where(F.col(split_col) == 0), [], y, "baseline")
    val = gs.attach(df.where(F.col(split_col) == 1), med, [])
    return val.agg(F.first("baseline").alias("baseline"), rmsle_expr(F.col(y), F.col("baseline")).alias("rmsle"),
                   F.count(F.lit(1)).alias("n"))


def _estimator(kind: str, label: str, params: dict | None):
    common = dict(featuresCol="features", labelCol=label, predictionCol="prediction")
    if kind == "lr":
        return LinearRegression(regParam=0.0, **common, **(params or {}))
    if kind == "rf":
        return RandomForestRegressor(**common, **{**RF_PARAMS, **(params or {})})
    if kind == "gbt":
        return GBTRegressor(**common, **{**GBT_ABS_PARAMS, **(params or {})})
    if kind == "gbt_squared":
        return GBTRegressor(**common, **{**GBT_SQ_PARAMS, **(params or {})})
    raise ValueError(f"unknown model kind {kind!r}")


#: Parameters of ``GBTRegressor`` that boosting on the absolute error by cells has too.
CELL_PARAMS = {"lossType", "maxDepth", "maxIter", "minInstancesPerNode", "stepSize", "seed", "maxBins"}
#: Parameters of ``RandomForestRegressor`` that the forest by cells has too, and rows up to which Spark ML's own is fitted.
FOREST_PARAMS = {"numTrees", "maxDepth", "minInstancesPerNode", "seed", "maxBins", "bootstrap", "featureSubsetStrategy"}
FOREST_ROWS = 100_000


def fit(train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt",
        params: dict | None = None) -> PipelineModel | boosting.Booster:
    """Assemble features and fit one estimator as a Pipeline (same transform for train, val, test).

    Boosting on the absolute error is fitted by ``boosting.fit_absolute``: Spark ML's trees, grown on cells of equal bins.
    So is a forest (``forest.fit``) with all features in every node and more than ``FOREST_ROWS`` rows.
    """
    if kind == "gbt" and {**GBT_ABS_PARAMS, **(params or {})}["lossType"] == "absolute" and CELL_PARAMS >= set(params or {}):
        est = _estimator(kind, label, params)
        settings = boosting.Settings(
            rounds=est.getMaxIter(), depth=est.getMaxDepth(), rate=est.getStepSize(), alpha=0.0, lam=0.0, column_share=1.0,
            min_child=est.getMinInstancesPerNode(), base=0.0, bins=est.getMaxBins(), loss="absolute")
        return boosting.fit_absolute(train, features, label, settings)
    if kind == "rf" and FOREST_PARAMS >= set(params or {}):
        est = _estimator(kind, label, params)
        if est.getFeatureSubsetStrategy() == "all" and train.limit(FOREST_ROWS + 1).count() > FOREST_ROWS:
            return forest.fit(train, features, label, est.getNumTrees(), est.getMaxDepth(), est.getMaxBins(), est.getMinInstancesPerNode(),
                              est.getSeed(), est.getBootstrap())
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, _estimator(kind, label, params)]).fit(train)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], log_y: bool = False) -> DataFrame:
    """Score rows; predictions are clipped at 0 (and expm1'd once when trained on log1p)."""
    out = model.predict(df, keep) if isinstance(model, boosting.Booster) else model.transform(df).select(*keep, "prediction")
    return clip_predictions(out, "prediction", log_y)


def save(model: PipelineModel | boosting.Booster, path: str) -> str:
    """Write a fitted pipeline (features and estimator) to ``path``, replacing what is there."""
    if isinstance(model, boosting.Booster):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel | boosting.Booster:
    """The pipeline that ``save`` wrote; it scores like the one that was saved."""
    return boosting.Booster.load(path) or PipelineModel.load(path)


def stage_losses(model: PipelineModel, df: DataFrame, loss: str = "absolute") -> list[float]:
    """Validation loss after each boosting round (GBT models only)."""
    if isinstance(model, boosting.Booster):
        return model.losses(df, model.label)
    assembled = model.stages[0].transform(df)
    return list(model.stages[-1].evaluateEachIteration(assembled, loss))


def per_group_fit(df: DataFrame, group_col: str, features: Sequence[str], label: str, keep: Sequence[str],
                  kind: str = "gbt", params: dict | None = None, split_col: str = "train_val_split",
                  log_y: bool = False, max_groups: int = 64, at_once: int = 4) -> DataFrame:
    """One model per value of ``group_col`` (NULL is a group); returns validation predictions of all groups.

    Each fit is a distributed Spark ML job on the group's training rows, read
    from one stored table of keys, features and label; ``at_once`` fits run side
    by side, so the many small stages of boosting fill the cluster.  More than
    ``max_groups`` groups are an error, never a silent cut.  A group without
    training rows predicts the median training label of all groups.
    """
    from concurrent.futures import ThreadPoolExecutor

    fit_label = "_label"
    names = list(dict.fromkeys([*keep, group_col, label, split_col, *features]))
    data = stored_table(df.select(*names, (F.log1p(F.col(label)) if log_y else F.col(label).cast("double")).alias(fit_label)))
    sizes = data.groupBy(group_col).agg(F.count_if(F.col(split_col) == 0).alias("n")).limit(max_groups + 1).collect()
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} values of {group_col}: raise max_groups or group them first")
    train, val = data.where(F.col(split_col) == 0), data.where(F.col(split_col) == 1)

    def one(r) -> DataFrame:
        mine = F.col(group_col).eqNullSafe(F.lit(r[0]).cast(data.schema[group_col].dataType))
        if not r["n"]:
            flat = gs.attach(val.where(mine), gs.median(train, [], fit_label, "prediction"), [])
            return clip_predictions(flat.select(*keep, *extra, "prediction"), "prediction", log_y)
        return predict(fit(train.where(mine), features, fit_label, kind, params), val.where(mine), [*keep, *extra], log_y)

    extra = [c for c in (group_col, label) if c not in keep]
    if not sizes:
        return val.select(*keep, *extra, F.lit(None).cast("double").alias("prediction"))
    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, sorted(sizes, key=lambda r: (r[0] is not None, r[0]))))


def _pseudo_rows(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows (1, x, y) and their common weight that have the given sums of products, as many as columns."""
    k = len(gram)
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T  # root' root = gram
    weight = gram[0, 0] / k
    v = root[:, 0] - np.sqrt(weight)  # the reflection that makes the first column constant
    if v @ v > 0:
        root = root - np.outer(v, v @ root) * (2 / (v @ v))
    return root / np.sqrt(weight), float(weight)


def _independent(gram: np.ndarray) -> list[int]:
    """Columns of x that neither a constant nor the columns before them make up; a fit on them predicts like one on all."""
    mean = gram[0, 1:-1] / gram[0, 0]
    square = np.diag(gram)[1:-1] / gram[0, 0]
    rest = gram[1:-1, 1:-1] / gram[0, 0] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(rest), 0.0))
    live = spread > 1e-7 * np.sqrt(square)
    rest = rest / np.outer(np.where(live, spread, 1.0), np.where(live, spread, 1.0))
    out = []
    for j in np.flatnonzero(live):
        if rest[j, j] > 1e-9:
            out.append(int(j))
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
    return out


def _linear_curve(data: DataFrame, features: Sequence[str], label: str, sizes: Sequence[float], folds: int, log_y: bool) -> list[tuple]:
    """(size, fold, train RMSLE, test RMSLE) of least squares in two passes over the rows.

    A linear fit needs sums of products only.  One pass adds them per (fold, slice of the nested sizes); those of a training
    set are sums of these, and Spark ML fits each model on a few weighted rows that have the same sums.  The second pass
    scores every row by all models.
    """
    spark, n = data.sparkSession, len(features)
    cuts = sorted({int(round(z * 1000)) for z in sizes})
    rows = data.select(F.col("_fold").cast("int"), F.col("_u").cast("int"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                       F.col("_lc_label").cast("double").alias("y"), F.col(label).cast("double").alias("target"))

    def matrix(b: pa.RecordBatch, upto: int) -> np.ndarray:
        return np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns[2:upto])])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((folds, len(cuts) + 1, n + 2, n + 2))
        for b in batches:
            z = matrix(b, n + 3)
            part = b.column(0).to_numpy() * (len(cuts) + 1) + np.searchsorted(cuts, b.column(1).to_numpy(), "right")
            for p in np.unique(part):
                mine = z[part == p]
                held.reshape(-1, n + 2, n + 2)[p] += mine.T @ mine
        f, s = np.divmod(np.arange(folds * (len(cuts) + 1)), len(cuts) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(s), pa.array([g.tobytes() for g in held.reshape(-1, n + 2, n + 2)], pa.binary())],
                                         ["fold", "slice", "g"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in t.column("g"))
        return pa.table({"fold": t.column("fold")[:1], "slice": t.column("slice")[:1], "g": pa.array([total.tobytes()], pa.binary())})

    kind = "fold long, slice long, g binary"
    found = rows.mapInArrow(grams, kind).groupBy("fold", "slice").applyInArrow(added, kind).collect()
    gram = {(r["fold"], r["slice"]): np.frombuffer(bytes(r["g"]), np.float64).reshape(n + 2, n + 2) for r in found}
    models = [(float(z), k) for z in sizes for k in range(folds)]
    weights = np.zeros((n + 1, len(models)))
    for m, (z, k) in enumerate(models):
        total = sum((g for (f, s), g in gram.items() if f != k and s <= cuts.index(int(round(z * 1000)))), np.zeros((n + 2, n + 2)))
        if not total[0, 0] or not np.isfinite(total).all():
            raise ValueError(f"no training rows, or some without a label or a feature (size {z}, fold {k})")
        own = _independent(total)
        weights[0, m] = total[0, -1] / total[0, 0]
        if own:
            at = [0, *(j + 1 for j in own), n + 1]
            few, weight = _pseudo_rows(total[np.ix_(at, at)])
            names = [features[j] for j in own]
            train = spark.createDataFrame([(*map(float, r[1:]), weight) for r in few], [*names, "_lc_label", "_lc_weight"])
            fitted = fit(train, names, "_lc_label", "lr", dict(weightCol="_lc_weight")).stages[-1]
            weights[0, m] = fitted.intercept
            weights[np.array(own) + 1, m] = fitted.coefficients.toArray()
    size_of, fold_of = (np.array([m[i] for m in models]) for i in (0, 1))
    limit = np.array([int(round(z * 1000)) for z in size_of])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(models), 2))
        for b in batches:
            p = matrix(b, n + 2) @ weights
            p = np.maximum(np.expm1(p) if log_y else p, 0.0)
            p = np.floor(p * 1e4 + 0.5) / 1e4  # as clip_predictions
            d = (np.log1p(p) - np.log1p(b.column(n + 3).to_numpy(zero_copy_only=False))[:, None]) ** 2
            own = b.column(0).to_numpy()[:, None] == fold_of
            for side, mask in enumerate((~own & (b.column(1).to_numpy()[:, None] < limit), own)):
                total[side, :, 0] += np.where(mask, d, 0.0).sum(axis=0)
                total[side, :, 1] += mask.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), *(pa.array(total[i, :, j]) for i in (0, 1) for j in (0, 1))],
                                         ["m", "a", "an", "b", "bn"])

    sums = rows.mapInArrow(scored, "m long, a double, an double, b double, bn double").groupBy("m").agg(
        F.sqrt(F.try_divide(F.sum("a"), F.sum("an"))).alias("train"), F.sqrt(F.try_divide(F.sum("b"), F.sum("bn"))).alias("test")).collect()
    return [(*models[r["m"]], r["train"], r["test"]) for r in sums]


def learning_curve(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
                   sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5,
                   kind: str = "gbt", params: dict | None = None, seed: int = 11,
                   log_y: bool = False) -> DataFrame:
    """Train/test RMSLE per (train size, fold) with hash-assigned folds; mean and std (ddof 0) per size.

    With ``log_y`` the models learn log1p(label); scores are on the original scale.  Linear models at the default
    settings take two passes in all, others one fit and two scorings per (size, fold).
    """
    from ..functions import exprs

    spark = df.sparkSession
    fit_label = "_lc_label"
    data = df.withColumn("_fold", exprs.hash_bucket(keys, seed, folds)) \
             .withColumn("_u", exprs.hash_bucket(keys, seed + 1, 1000)) \
             .withColumn(fit_label, F.log1p(F.col(label)) if log_y else F.col(label).cast("double"))
    linear = kind == "lr" and not params
    rows = _linear_curve(data, features, label, sizes, folds, log_y) if linear else []
    for size in [] if linear else sizes:
        for k in range(folds):
            train = data.where((F.col("_fold") != k) & (F.col("_u") < F.lit(int(round(size * 1000)))))
            test = data.where(F.col("_fold") == k)
            model = fit(train, features, fit_label, kind, params)
            tr = predict(model, train, [label], log_y).agg(rmsle_expr(F.col(label), F.col("prediction"))).first()[0]
            te = predict(model, test, [label], log_y).agg(rmsle_expr(F.col(label), F.col("prediction"))).first()[0]
            rows.append((float(size), k, float(tr), float(te)))
    scores = spark.createDataFrame(rows, "train_size double, fold int, train_rmsle double, test_rmsle double")
    return scores.groupBy("train_size").agg(
        F.avg("train_rmsle").alias("train_mean"), F.stddev_pop("train_rmsle").alias("train_std"),
        F.avg("test_rmsle").alias("test_mean"), F.stddev_pop("test_rmsle").alias("test_std"))


def knn_regress_1d(train: DataFrame, queries: DataFrame, x: str, y: str, train_key: Sequence[str],
                   query_x: str, query_id: str, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Exact k-nearest-neighbour regression on one numeric feature (uniform mean of k targets).

    Neighbours are ranked by (|x_t - x_q|, distance in sorted order from the
    query's insertion point, train position).  With that order the k chosen
    rows of a query form a prefix on each side of its insertion point, so
    they lie among the 2k training rows around it: every query is joined to
    exactly those 2k candidates (an equi-join on a global train index built
    with a distributed prefix sum), never to all training rows.  ``by``
    restricts neighbours to the query's own group.
    """
    from . import ordered

    by = list(by)
    tk = list(train_key)
    t = train.where(F.col(x).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_t"), F.col(y).cast("double").alias("_y"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tk)], F.lit(None).alias("_qid"))
    q = queries.where(F.col(query_x).isNotNull()).select(
        *by, F.col(query_x).cast("double").alias("_x"), F.lit(0).alias("_t"), F.lit(None).cast("double").alias("_y"),
        *[F.lit(None).cast(train.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(tk)],
        F.col(query_id).alias("_qid"))
    both = t.unionByName(q.withColumn("_qid", F.col("_qid").cast(q.schema["_qid"].dataType)), allowMissingColumns=False)
    order = [F.col(c).asc() for c in by] + [F.col("_x").asc(), F.col("_t").asc()] + [F.col(f"_k{i}").asc() for i in range(len(tk))] \
        + [F.col("_qid").asc()]  # equal queries spread over range partitions
    ranked = ordered.running_total(both, order, F.col("_t"), "_cum")
    train_idx = ranked.where(F.col("_t") == 1).select(*by, (F.col("_cum") - 1).alias("_idx"), F.col("_x").alias("_tx"), "_y")
    bounds = train_idx.groupBy(*by).agg(F.min("_idx").alias("_g0"), F.max("_idx").alias("_g1"))
    qpos = ranked.where(F.col("_t") == 0).select(*by, "_qid", F.col("_x").alias("_qx"), F.col("_cum").alias("_c"))
    qpos = qpos.join(bounds, by, "inner") if by else gs.attach(qpos, bounds, [])
    lo = F.greatest(F.col("_c") - F.lit(k), F.col("_g0"))
    hi = F.least(F.col("_c") + F.lit(k - 1), F.col("_g1"))
    cand = qpos.select(*by, "_qid", "_qx", "_c", F.explode(F.sequence(lo, hi)).alias("_idx"))
    pairs = cand.join(train_idx, by + ["_idx"], "inner")
    w = Window.partitionBy("_qid").orderBy(F.abs(F.col("_tx") - F.col("_qx")), F.abs(F.col("_idx") - F.col("_c")), F.col("_idx"))
    top = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy(F.col("_qid").alias(query_id)).agg(F.avg("_y").alias("prediction"), F.count(F.lit(1)).alias("n_neighbors"))


def group_scores(df: DataFrame, y: str, p: str, group_col: str) -> DataFrame:
    """(level, group, rmsle, n): per group, the mean of the group RMSLEs, and RMSLE over all rows pooled."""
    per = rmsle(df, y, p, [group_col])
    mean = per.agg(F.avg("rmsle").alias("rmsle"), F.sum("n").alias("n"))
    pooled = rmsle(df, y, p)
    none = F.lit(None).cast(df.schema[group_col].dataType).alias(group_col)
    return per.select(F.lit("group").alias("level"), group_col, "rmsle", "n") \
        .unionByName(mean.select(F.lit("mean_of_groups").alias("level"), none, "rmsle", "n")) \
        .unionByName(pooled.select(F.lit("pooled").alias("level"), none, "rmsle", "n"))
