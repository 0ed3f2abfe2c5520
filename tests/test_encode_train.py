import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paysift.functions.exprs import mape, smape
from paysift.operators import encode as E
from paysift.operators import metrics as M
from paysift.operators import ranking as R
from paysift.operators import train as TR


def test_index_ties_alphabetical(spark):
    df = spark.createDataFrame([(x,) for x in "bacced"], "k string")
    out, model = E.index_columns(df, ["k"], ["k_idx"])
    assert model.labelsArray[0] == ["a", "b", "d", "e", "c"]
    idx = sorted({(r.k, r.k_idx) for r in out.collect()})
    assert [i for _, i in sorted(idx, key=lambda t: t[1])] == [0., 1., 2.,
                                                               3., 4.]


def test_one_hot_rows_sum_to_one_and_dense_equals_sparse(spark):
    df = spark.createDataFrame([(x,) for x in "aabc"], "k string")
    df, _ = E.index_columns(df, ["k"], ["k_idx"])
    df, _ = E.one_hot(df, ["k_idx"], ["k_vec"])
    df = E.densify(df, "k_vec", "k_dense")
    rows = df.select(vector_to_array("k_vec").alias("s"),
                     vector_to_array("k_dense").alias("d")).collect()
    assert all(sum(r.s) == 1.0 and r.s == r.d for r in rows)
    assert len(rows[0].s) == 3  # dropLast=False keeps every category


def test_assemble_and_slot_names(spark):
    df = spark.createDataFrame([("a", True, 2.0), ("b", False, 0.0)],
                               "k string, f boolean, x double")
    df, _ = E.index_columns(df, ["k"], ["k_idx"])
    df, _ = E.one_hot(df, ["k_idx"], ["k_vec"])
    df = E.assemble(df, ["k_vec", "f", "x"], "v")
    names = [n for _, n in E.slot_names(df, "v")]
    assert names == ["k_vec_a", "k_vec_b", "f", "x"]
    assert E.slot_offsets(df, ["k_vec", "f", "x"]) == {
        "k_vec": 0, "f": 2, "x": 3}
    ex = {(r.key, r.slot, r.val) for r in
          E.explode_vector(df.withColumnRenamed("k", "key"), "key", "v")
          .collect()}
    assert ex == {("a", 0, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 1.0)}


def test_hash_split_disjoint_and_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "rec_id")
    train, test = E.hash_split(df, "rec_id", 70)
    a = {r.rec_id for r in train.collect()}
    b = {r.rec_id for r in test.collect()}
    assert not a & b and len(a | b) == 1000
    assert 600 < len(a) < 800
    # independent of partitioning
    a2 = {r.rec_id for r in E.hash_split(df.repartition(7), "rec_id", 70)[0]
          .collect()}
    assert a == a2


def test_smape_mape_zero_denominators(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0),
                                (2.0, 2.0)], "a double, p double")
    got = {r.metric: (r.value, r.n_undefined) for r in
           M.regression_metrics(df, "a", "p").collect()}
    assert math.isclose(got["smape"][0], 200.0 / 3) and got["smape"][1] == 1
    assert math.isclose(got["mape"][0], 50.0) and got["mape"][1] == 2
    vals = [r.s for r in df.select(smape("a", "p").alias("s")).collect()
            if r.s is not None]
    assert all(0 <= v <= 100 for v in vals)
    assert df.select(mape("a", "p").alias("m")).first().m is None


def test_rmse_r2_match_evaluator(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (3.0, 3.5),
                                (4.0, 4.0)], "a double, prediction double")
    got = {r.metric: r.value for r in
           M.regression_metrics(df, "a").collect()}
    for metric in ("rmse", "r2", "mae"):
        ev = TR.evaluator("a", metric).evaluate(df)
        assert math.isclose(got[metric], ev, rel_tol=1e-12)


def test_leaderboard_one_pass(spark):
    a = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, "
                              "prediction double")
    b = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "y double, "
                              "prediction double")
    lb = {(r.model, r.metric): r.value for r in
          M.leaderboard({"good": a, "bad": b}, "y").collect()}
    assert lb[("good", "rmse")] == 0.0 and lb[("bad", "rmse")] == 1.0


@pytest.fixture
def folds(spark):
    rows = [(i, float(i % 7), 3.0 * (i % 7) + (i % 3), i % 5)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    return E.assemble(df, ["x"], "v")


def test_cv_with_fold_column_matches_manual(spark, folds):
    lr = TR.linear("y", "v", regParam=0.0)
    cv = TR.tune_cross_validation(lr, {"fitIntercept": [True]}, folds, "y",
                                  "fold", folds=5)
    pdf = folds.select("x", "y", "fold").toPandas()
    import numpy as np
    errs = []
    for f in range(5):
        tr, va = pdf[pdf.fold != f], pdf[pdf.fold == f]
        b1, b0 = np.polyfit(tr.x, tr.y, 1)
        errs.append(np.sqrt(np.mean((va.y - (b0 + b1 * va.x)) ** 2)))
    assert math.isclose(cv.metrics[0], float(np.mean(errs)),
                        rel_tol=1e-9)
    bp = {r.param: r.value for r in TR.best_params(spark, cv).collect()}
    assert bp["regParam"] == "0.0"


def test_stump_and_ensembles_agree(spark, folds):
    t = folds
    m1 = TR.tree("y", "v", max_bins=32, maxDepth=1).fit(t)
    m2 = TR.forest("y", "v", max_bins=32, maxDepth=1, numTrees=1,
                   bootstrap=False, featureSubsetStrategy="all").fit(t)
    m3 = TR.boosting("y", "v", max_bins=32, maxDepth=1, maxIter=1).fit(t)
    tabs = [sorted(tuple(r) for r in TR.leaf_table(m, t).collect())
            for m in (m1, m2, m3)]
    assert tabs[0] == tabs[1] == tabs[2]
    assert sum(r[1] for r in tabs[0]) == t.count()


def test_importance_sums_to_one_and_refit_is_equal(spark, folds):
    m = TR.forest("y", "v", numTrees=5, maxDepth=3).fit(folds)
    m2 = TR.forest("y", "v", numTrees=5, maxDepth=3).fit(folds)
    assert math.isclose(sum(m.featureImportances.toArray()), 1.0)
    assert m.featureImportances == m2.featureImportances
    top = R.feature_importance(m, folds, "v", k=3).collect()
    assert top[0].rank == 1 and top[0].name == "x"


def test_label_correlation_bounds_and_constant(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i + 1) for i in
                                range(10)], "a double, z double, y double")
    df = E.assemble(df, ["a", "z"], "v")
    got = {r.name: r.corr for r in
           R.label_correlation(df, "v", "y").collect()}
    assert math.isclose(got["a"], 1.0) and got["z"] is None
    full = E.assemble(df, ["a", "z", "y"], "w")
    row = {r.name: r.corr for r in R.correlation_row(full, "w", 2).collect()}
    # entries of a constant slot are undefined and come back as null
    assert math.isclose(row["a"], 1.0) and row["z"] is None
    assert set(row) == {"a", "z"}
    ranked = R.rank_by_abs(R.label_correlation(df, "v", "y"), k=None)
    assert [r.name for r in ranked.collect()] == ["a", "z"]


def test_full_grid_presets_sizes(spark):
    from paysift.plans import tuning as TU
    sizes = {fam: len(TR.grid_points(grid))
             for fam, grid in TU.FULL_GRIDS.items()}
    assert sizes == {"linear": 30, "tree": 24, "forest": 12, "boosting": 24}


def test_cast_all_except_keeps_metadata(spark):
    from paysift.operators import clean as C
    df = spark.createDataFrame([("a", "1.5", "x")], "k string, n string, "
                               "b string")
    df, _ = E.index_columns(df, ["k"], ["k_idx"])
    out = C.cast_all_double_except(df.drop("k"), ["k_idx", "b"])
    assert dict(out.dtypes) == {"n": "double", "b": "string",
                                "k_idx": "double"}
    assert "ml_attr" in out.schema["k_idx"].metadata


def test_ranking_compares_raw_values(spark):
    df = spark.createDataFrame(
        [(0, "a", 0.1234561), (1, "b", -0.1234564), (2, "c", None)],
        "idx int, name string, corr double")
    assert [r.name for r in R.rank_by_abs(df, k=None).collect()] == [
        "b", "a", "c"]


def test_slot_offsets_of_names_that_share_a_prefix(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)],
                               "k string, x double")
    df, _ = E.index_columns(df, ["k"], ["k_idx"])
    df, _ = E.one_hot(df, ["k_idx"], ["x_vec"])
    df = E.assemble(df, ["x_vec", "x"], "v")
    assert E.slot_offsets(df, ["x_vec", "x"]) == {"x_vec": 0, "x": 2}


def test_exploding_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame(
        [(1, Vectors.dense([0.0, 2.0, 3.0])),
         (2, Vectors.sparse(4, [1, 3], [5.0, 0.0])),
         (3, Vectors.sparse(2, [], []))], ["k", "v"])
    assert {tuple(r) for r in E.explode_vector(df, "k", "v").collect()} == {
        (1, 1, 2.0), (1, 2, 3.0), (2, 1, 5.0)}


def test_shared_fits_equal_single_fits(spark):
    """Depths cut from one deep tree and iterations read from one long
    boosting run have the errors of models fitted one by one."""
    rows = [(i, float(i % 13), float(i * 7 % 11), float((i % 13) ** 2
             + (i * 7 % 11) + i % 5), i % 3) for i in range(400)]
    df = E.assemble(spark.createDataFrame(
        rows, "id long, a double, b double, y double, fold int"),
        ["a", "b"], "v")
    for est, spec in (
            (TR.tree("y", "v"), {"maxDepth": [1, 3, 6], "maxBins": [37, 5]}),
            (TR.boosting("y", "v"), {"maxIter": [2, 5], "maxDepth": [2, 3],
                                     "stepSize": [0.3]})):
        tuned = TR.tune_cross_validation(est, spec, df, "y", "fold",
                                         folds=3)
        assert tuned.points == TR.grid_points(spec)
        for point, error in zip(tuned.points, tuned.metrics):
            errs = [TR.evaluator("y").evaluate(
                TR._with(est, point).fit(df.where(F.col("fold") != f))
                .transform(df.where(F.col("fold") == f))) for f in range(3)]
            assert math.isclose(error, sum(errs) / 3, rel_tol=1e-9)
        assert tuned.best == tuned.points[tuned.metrics.index(
            min(tuned.metrics))]
