"""Learners, grids and tuning on ``pyspark.ml``.

The four regression families of the original (linear, decision tree,
random forest, gradient boosting), train/validation and k-fold tuning, best
parameters, and leaf tables.  Folds come from a column and the validation
split from a key hash, so they do not depend on the partitioning; grid points
that one fit can answer share it, and independent fits run side by side from
driver threads (``run_concurrently``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.functions import lookups as L
from paysift.functions.exprs import hash_percent
from paysift.operators import boosted as BO
from paysift.operators import moments as MO
from paysift.session import shared_path

SEED = 42


def _nominal_width(df: DataFrame, features: str) -> int:
    """Largest category count among nominal slots of the feature vector."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    widths = [len(a.get("vals", [])) or int(a.get("num_vals", 0))
              for a in meta.get("attrs", {}).get("nominal", [])]
    return max(widths, default=0)


def safe_max_bins(df: DataFrame, features: str, requested: int) -> int:
    """maxBins must cover the widest categorical feature, or fit raises."""
    return max(requested, _nominal_width(df, features))


def linear(label: str, features: str = "features", **params
           ) -> LinearRegression:
    return LinearRegression(labelCol=label, featuresCol=features, **params)


def tree(label: str, features: str = "features",
         max_bins: int = L.MAX_BINS, **params) -> DecisionTreeRegressor:
    params.setdefault("seed", SEED)
    return DecisionTreeRegressor(labelCol=label, featuresCol=features,
                                 maxBins=max_bins, **params)


def forest(label: str, features: str = "features",
           max_bins: int = L.MAX_BINS, **params) -> RandomForestRegressor:
    params.setdefault("seed", SEED)
    return RandomForestRegressor(labelCol=label, featuresCol=features,
                                 maxBins=max_bins, **params)


def boosting(label: str, features: str = "features",
             max_bins: int = L.MAX_BINS, **params) -> GBTRegressor:
    params.setdefault("seed", SEED)
    return GBTRegressor(labelCol=label, featuresCol=features,
                        maxBins=max_bins, **params)


FAMILIES = {"linear": linear, "tree": tree, "forest": forest,
            "boosting": boosting}


def estimator(family: str, label: str, train: DataFrame | None = None,
              features: str = "features", **params):
    """A learner of one family; tree families get a maxBins that covers the
    widest nominal feature of ``train``."""
    if family != "linear" and train is not None:
        params["max_bins"] = safe_max_bins(
            train, features, params.get("max_bins", L.MAX_BINS))
    return FAMILIES[family](label, features, **params)


def run_concurrently(tasks: Mapping[object, Callable[[], object]],
                     parallelism: int = 4,
                     spark: SparkSession | None = None
                     ) -> dict[object, object]:
    """Run independent fits from several driver threads, as CrossValidator
    does for grid points: Spark schedules their jobs side by side, so
    small-job overhead of one learner overlaps work of another.  Results do
    not depend on the order (every learner is seeded)."""
    if parallelism <= 1 or len(tasks) <= 1:
        return {k: f() for k, f in tasks.items()}
    spark = spark or SparkSession.getActiveSession()
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as ex:
        futures = {k: ex.submit(wrap(f)) for k, f in tasks.items()}
        return {k: fut.result() for k, fut in futures.items()}


def fit_many(estimators: Mapping[str, object], train: DataFrame,
             parallelism: int = 4) -> dict[str, object]:
    """Fit several estimators on the same frame concurrently."""
    return run_concurrently({k: (lambda e=e: e.fit(train))
                             for k, e in estimators.items()}, parallelism,
                            train.sparkSession)


def score(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions next to the kept columns (a lazy projection)."""
    return model.transform(df).select(*keep, "prediction")


def evaluator(label: str, metric: str = "rmse") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction",
                               metricName=metric)


@dataclass
class Tuned:
    """A tuned learner: the winner refitted on all rows, the grid's points
    (parameter names to values) and each one's RMSE."""
    bestModel: object
    points: list[dict]
    metrics: list[float]
    family: type = None

    @property
    def best(self) -> dict:
        return self.points[int(np.argmin(self.metrics))]


def grid_points(spec: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of a grid, the last parameter changing fastest."""
    return [dict(zip(spec, v)) for v in product(*spec.values())]


def _with(est, params: Mapping[str, object]):
    return est.copy({est.getParam(k): v for k, v in params.items()})


def _rmse(model, rows: DataFrame, label: str) -> float:
    return evaluator(label).evaluate(model.transform(rows))


def _depth_errors(model, rows: DataFrame, label: str,
                  depths: Sequence[int]) -> list[float]:
    """RMSE of a tree cut at each depth, from one pass over ``rows``.

    A shallower tree is the deep one cut off: splits depend on the rows of
    their node only.  Rows are summed per leaf of the deep tree (count, label
    and its square); a leaf's ancestor at a depth gives its prediction there.
    """
    leaves: list[list[float]] = []  # predictions from the root down

    def walk(node, path: list[float]) -> None:
        path = [*path, node.prediction()]
        if node.subtreeDepth() == 0:
            leaves.append(path)
        else:
            walk(node.leftChild(), path)
            walk(node.rightChild(), path)
    walk(model._java_obj.rootNode(), [])
    m = model.copy()
    m.setLeafCol("__leaf")
    y = F.col(label)
    sums = m.transform(rows).groupBy(F.col("__leaf").cast("int")).agg(
        F.count(y), F.sum(y), F.sum(y * y)).collect()  # a row a leaf
    total = sum(r[1] for r in sums)
    out = []
    for d in depths:
        sse = 0.0
        for leaf, n, s, ss in sums:
            p = leaves[leaf][min(d, len(leaves[leaf]) - 1)]
            sse += ss - 2 * p * s + n * p * p
        out.append(math.sqrt(max(0.0, sse) / total))
    return out


def _forest_paths(model, spark: SparkSession) -> list[list[list[float]]]:
    """Of each tree's leaves, the predictions from the root down; from the
    saved model, whose thousands of nodes one read brings."""
    path = shared_path(spark, "forest")
    model.save(path)
    trees: list[dict] = [{} for _ in range(model.getNumTrees)]
    for t, node, value, left, right in spark.read.parquet(f"{path}/data") \
            .select("treeID", "nodeData.id", "nodeData.prediction",
                    "nodeData.leftChild", "nodeData.rightChild").collect():
        trees[t][node] = value, left, right
    out = []
    for nodes in trees:
        leaves, todo = [], [(0, [])]
        while todo:
            node, above = todo.pop()
            value, left, right = nodes[node]
            if left < 0:
                leaves.append([*above, value])
            else:
                todo += [(right, [*above, value]), (left, [*above, value])]
        out.append(leaves)
    return out


def _forest_depth_errors(model, rows: DataFrame, label: str,
                         depths: Sequence[int]) -> list[float]:
    """RMSE of a forest cut at each depth, from one pass over ``rows``.

    A tree's nodes draw their slots level by level, so the upper levels of a
    deep forest are the shallow forest (where a level's statistics outgrow
    ``maxMemoryInMB`` the draws come in another order, and the cut is another
    forest of that depth).  A task sums the squared errors of its rows; a row's prediction at a depth is the mean over the trees of what its
    leaves' ancestors there predict.
    """
    paths = _forest_paths(model, rows.sparkSession)
    # by depth and tree: the prediction of each leaf
    cut = [[np.array([p[min(d, len(p) - 1)] for p in own])
            for own in paths] for d in depths]
    m = model.copy()
    m.setLeafCol("__leaf")
    leaves = m.transform(rows).select(
        F.col(label).cast("double").alias("y"),
        vector_to_array("__leaf").alias("leaf"))

    def sums(batches):
        n, sse = 0, np.zeros(len(cut))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            leaf = batch.column(1).flatten().to_numpy() \
                .reshape(len(y), len(paths)).astype(np.int64)
            for i, trees in enumerate(cut):
                off = sum(t[leaf[:, j]] for j, t in enumerate(trees)) \
                    / len(trees) - y
                sse[i] += off @ off
            n += len(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([sse.tolist()])], names=["n", "sse"])
    found = leaves.mapInArrow(sums, "n long, sse array<double>") \
        .collect()  # a row a task
    total = sum(r.n for r in found)
    return [math.sqrt(sum(r.sse[i] for r in found) / total)
            for i in range(len(depths))]


#: Rows of a training set that one task of a tuning fit takes at least.
ROWS_PER_TASK = 50_000


def packed(df: DataFrame) -> DataFrame:
    """``df`` in tasks of at least ``ROWS_PER_TASK`` rows: a tree fit moves
    statistics of every node from every task, however few its rows."""
    return df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK)))


def _groups(est, points: Sequence[Mapping]) -> tuple[str | None,
                                                     list[list[int]]]:
    """The parameter that points may share a fit in, and the points of each
    fit: depths of a tree or forest (the deepest holds the others) and
    iterations of boosting (the longest holds the shorter)."""
    shared = None
    if isinstance(est, (DecisionTreeRegressor, RandomForestRegressor)):
        shared = "maxDepth"
    elif isinstance(est, GBTRegressor):
        shared = "maxIter"
    if any(shared not in p for p in points):
        shared = None
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault(tuple((k, v) for k, v in p.items()
                                if k != shared), []).append(i)
    return shared, list(groups.values())


def _group_errors(est, points: Sequence[Mapping], shared: str | None,
                  train: DataFrame, held_out: DataFrame, label: str
                  ) -> list[float]:
    """RMSE on ``held_out`` of the points of one fit."""
    if shared is None:
        model = _with(est, points[0]).fit(train)
        return [_rmse(model, held_out, label)] * len(points)
    values = [p[shared] for p in points]
    if isinstance(est, RandomForestRegressor):
        # the same trees; a row keeps its nodes instead of walking down to
        # them in every tree at every level
        est = _with(est, {"cacheNodeIds": True})
    model = _with(est, {**points[0], shared: max(values)}).fit(train)
    if isinstance(est, RandomForestRegressor):
        return _forest_depth_errors(model, held_out, label, values)
    if shared == "maxDepth":
        return _depth_errors(model, held_out, label, values)
    losses = model.evaluateEachIteration(held_out, "squared")
    return [math.sqrt(losses[v - 1]) for v in values]


def in_flight(df: DataFrame, most: int = 32) -> int:
    """How many fits on ``df`` run side by side: enough for two tasks a
    core, so that what all of them hold in memory is bounded by the cores,
    not by the grid."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return max(2, min(most, -(-2 * slots // df.rdd.getNumPartitions())))


def _errors(est, points: Sequence[Mapping],
            splits: Sequence[tuple[DataFrame, DataFrame]], label: str,
            parallelism: int | None) -> np.ndarray:
    """RMSE of every point (row: split) fitted on a split's first part, on
    its second.  All splits' fits share one pool of driver threads; each has
    a scheduler pool of its own, so that where the session schedules fairly
    a long fit does not hold back the others.  A small training set is read
    by few tasks, and then more fits run at once.  Boosting runs share passes
    over the rows instead (``boosted.errors``)."""
    shared, groups = _groups(est, points)
    spark = splits[0][0].sparkSession
    splits = [(packed(t), packed(h)) for t, h in splits]
    if BO.supports(est, points):
        return BO.errors(est, points, splits, label, run_concurrently,
                         parallelism)

    def fit(s: int, members: list[int]) -> list[float]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool",
                                            f"fit-{s}-{members[0]}")
        return _group_errors(est, [points[i] for i in members], shared,
                             *splits[s], label)
    # long fits first, so that none is left over at the end
    order = sorted(groups, key=lambda m: -max(
        points[i].get("maxDepth", 0) * points[i].get("numTrees", 1)
        for i in m))
    tasks = {(s, m[0]): (lambda s=s, m=m: fit(s, m))
             for m in order for s in range(len(splits))}
    found = run_concurrently(tasks, parallelism or in_flight(splits[0][0]),
                             spark)
    out = np.zeros((len(splits), len(points)))
    for m in groups:
        for s in range(len(splits)):
            out[s, m] = found[s, m[0]]
    return out


def _from_moments(est, points: Sequence[Mapping], df: DataFrame) -> bool:
    """Whether the products of the slots answer all points: squared error
    by the normal equations, no weights, a width the driver can hold."""
    return (isinstance(est, LinearRegression)
            and est.getLoss() == "squaredError"
            and est.getSolver() in ("auto", "normal")
            and est.getStandardization() and not est.isSet("weightCol")
            and all(set(p) <= {"regParam", "elasticNetParam",
                               "fitIntercept"} for p in points)
            and 0 < vector_width(df, est.getFeaturesCol()) <= MO.MAX_WIDTH)


def vector_width(df: DataFrame, features: str) -> int:
    """Slots of a vector column, from its metadata (0: unknown)."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    return int(meta.get("num_attrs", 0)) or sum(
        len(a) for a in meta.get("attrs", {}).values())


def _moment_errors(est, points: Sequence[Mapping], parts: Mapping,
                   held_out: Sequence) -> np.ndarray:
    """RMSE of every point (row: part of ``held_out``) fitted on the other
    parts' moments."""
    out = np.zeros((len(held_out), len(points)))
    for row, f in enumerate(held_out):
        train = None
        for k, m in parts.items():
            if k != f:
                train = m if train is None else train + m
        for i, p in enumerate(points):
            def value(name: str):
                return p.get(name, est.getOrDefault(name))
            out[row, i] = MO.rmse(parts[f], *MO.elastic_net(
                train, value("regParam"), value("elasticNetParam"),
                value("fitIntercept")))
    return out


def tune_train_validation(est, spec: Mapping[str, Sequence],
                          train: DataFrame, label: str, key: str,
                          percent: int = round(100 * L.TVS_TRAIN_RATIO),
                          parallelism: int | None = None) -> Tuned:
    """Train/validation tuning; smaller RMSE wins.  The split is a hash of
    the key, so it does not depend on the partitioning.  A linear grid takes
    one pass over ``train`` for all points."""
    points = grid_points(spec)
    part = hash_percent(F.concat(F.lit("tvs"), F.col(key).cast("string"))) \
        < F.lit(percent)
    if _from_moments(est, points, train):
        vec = est.getFeaturesCol()
        sums = MO.moments_by(train.withColumn("__fit", part), vec, label,
                             "__fit", vector_width(train, vec))
        errors = _moment_errors(est, points, sums, [False])[0]
    else:
        errors = _errors(est, points, [(train.where(part),
                                        train.where(~part))], label,
                         parallelism)[0]
    best = _with(est, points[int(np.argmin(errors))]).fit(packed(train))
    return Tuned(best, points, errors.tolist(), type(est))


def tune_cross_validation(est, spec: Mapping[str, Sequence],
                          train: DataFrame, label: str, fold_col: str,
                          folds: int = L.NUM_FOLDS,
                          parallelism: int | None = None) -> Tuned:
    """k-fold tuning on the folds in ``fold_col``; the mean RMSE counts.

    A linear grid takes one pass over ``train`` for all points and folds.
    Otherwise the fits of all folds run side by side, ``parallelism`` at a
    time (default: ``in_flight``); a fold's parts are filters on the fold
    column, which a written model input answers by reading the other folds'
    files only.
    """
    points = grid_points(spec)
    if _from_moments(est, points, train):
        vec = est.getFeaturesCol()
        sums = MO.moments_by(train, vec, label, fold_col,
                             vector_width(train, vec))
        errors = _moment_errors(est, points, sums, range(folds))
    else:
        errors = _errors(est, points, [
            (train.where(F.col(fold_col) != f),
             train.where(F.col(fold_col) == f)) for f in range(folds)],
            label, parallelism)
    errors = errors.mean(axis=0).tolist()
    best = _with(est, points[int(np.argmin(errors))]).fit(packed(train))
    return Tuned(best, points, errors, type(est))


def tuning_table(spark, tuned: Tuned) -> DataFrame:
    """(point, params, rmse) per grid point."""
    rows = [(i, ", ".join(f"{k}={v}" for k, v in sorted(p.items())),
             float(e)) for i, (p, e) in enumerate(zip(tuned.points,
                                                      tuned.metrics))]
    return spark.createDataFrame(rows, "point int, params string, "
                                       "rmse double")


def best_point(spark, tuned: Tuned) -> DataFrame:
    """(param, value) of the winning point: the tuned parameters only."""
    return spark.createDataFrame(
        [(k, str(v)) for k, v in sorted(tuned.best.items())],
        "param string, value string")


def best_params(spark, tuned: Tuned) -> DataFrame:
    """(param, value) of the winning model's full parameter map."""
    pm = tuned.bestModel.extractParamMap()
    rows = sorted((p.name, str(v)) for p, v in pm.items())
    return spark.createDataFrame(rows, "param string, value string")


def leaf_table(model, df: DataFrame, tree_index: int = 0) -> DataFrame:
    """(leaf, n, prediction) of one tree: rows per leaf and the model's
    largest prediction there (exactly the leaf value for a single-tree
    model).

    Uses the model's ``leafCol`` output; ensembles give one leaf per tree,
    of which ``tree_index`` is taken.  One grouped aggregate.
    """
    m = model.copy()
    m.setLeafCol("__leaf")
    m.setPredictionCol("__pred")
    out = m.transform(df)
    leaf_t = out.schema["__leaf"].dataType
    if isinstance(leaf_t, T.DoubleType):
        leaf = F.col("__leaf")
    else:
        leaf = vector_to_array(F.col("__leaf"))[tree_index]
    return (out.groupBy(leaf.cast("int").alias("leaf"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max(F.col("__pred")).alias("prediction")))
