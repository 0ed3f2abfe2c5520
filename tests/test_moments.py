"""Sums over slots and pairs: linear grids, correlations, ordered totals and
frequency indexes against Spark's own estimators and brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from conftest import SMALL
from paysift.functions import lookups as L
from paysift.operators import encode as E
from paysift.operators import moments as MO
from paysift.operators import profile as PR
from paysift.operators import ranking as R
from paysift.operators import train as TR
from paysift.operators.ordered import running
from paysift.plans import features as P
from paysift.plans import tuning as TU
from paysift.plans.analysis import model_frames


@pytest.fixture(scope="module")
def frames(spark):
    return model_frames(spark, SMALL)


def _objective(m, coef, b0, reg, mix):
    """What the elastic net minimises, on standardised slots and label."""
    sx = np.sqrt(np.diag(m.xx) / m.n - (m.x / m.n) ** 2)
    sy = math.sqrt(m.yy / m.n - (m.y / m.n) ** 2)
    b = coef * sx / sy
    return MO.rmse(m, coef, b0) ** 2 / (2 * sy * sy) + reg / sy * (
        mix * np.abs(b).sum() + (1 - mix) / 2 * (b * b).sum())


def test_linear_grid_equals_fits_one_by_one(spark, frames):
    """All 30 points of one pass against Spark's fits on two folds: the
    same RMSE without an absolute penalty; with one, Spark iterates and the
    exact solution must be at least as good."""
    train, _ = frames
    tuned = TU.tune_family(train, "linear", L.LINEAR_GRID)
    assert tuned.points == TR.grid_points(L.LINEAR_GRID)
    est = TU.estimator("linear", train)
    vec = est.getFeaturesCol()
    width = TR.vector_width(train, vec)
    sums = MO.moments_by(train, vec, P.LABEL, E.FOLD, width)
    errors = TR._moment_errors(est, tuned.points, sums, range(5))
    assert np.allclose(errors.mean(axis=0), tuned.metrics, rtol=1e-12)
    fit = sums[1] + sums[2] + sums[3] + sums[4]
    rows = train.where(F.col(E.FOLD) != 0).cache()
    held = train.where(F.col(E.FOLD) == 0).cache()
    for i in (0, 1, 2, 3, 11, 14, 23, 26, 27, 29):
        p = tuned.points[i]
        model = TR._with(est, {**p, "tol": 1e-13, "maxIter": 2000}).fit(rows)
        error = TR._rmse(model, held, P.LABEL)
        if p["elasticNetParam"] == 0:
            assert abs(error - errors[0, i]) < 5e-5
        else:
            assert math.isclose(error, errors[0, i], rel_tol=1e-6)
        own = MO.elastic_net(fit, p["regParam"], p["elasticNetParam"],
                             p["fitIntercept"])
        spark_own = model.coefficients.toArray(), model.intercept
        args = p["regParam"], p["elasticNetParam"]
        assert _objective(fit, *own, *args) <= \
            _objective(fit, *spark_own, *args) * (1 + 1e-12)


def test_linear_grid_reads_the_rows_once(spark, frames, monkeypatch):
    """One aggregate for all points and folds, one fit for the winner."""
    train, _ = frames
    calls = []
    fit, made = TR.LinearRegression.fit, MO.products
    monkeypatch.setattr(TR.LinearRegression, "fit", lambda *a, **k: (
        calls.append("fit"), fit(*a, **k))[1])
    monkeypatch.setattr(MO, "products", lambda *a, **k: (
        calls.append("pass"), made(*a, **k))[1])
    TU.tune_split(train, "linear", L.LINEAR_GRID)
    TU.tune_family(train, "linear", L.LINEAR_GRID)
    assert calls == ["pass", "fit"] * 2


def test_elastic_net_drops_slots_and_ignores_constants():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5))
    x[:, 3] = 7.0
    x[:, 4] = x[:, 0] + 0.01 * x[:, 4]  # nearly the same slot twice
    y = 3 * x[:, 0] + 0.5 * x[:, 1] + rng.standard_normal(300) + 100
    m = MO.Moments(300.0, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)
    for mix in (0.3, 1.0):
        coef, b0 = MO.elastic_net(m, 1.5, mix, True)
        assert coef[3] == 0.0 and (coef == 0).sum() >= 2
        base = _objective_plain(x, y, coef, b0, 1.5, mix)
        for _ in range(200):  # no small step is better
            step = rng.standard_normal(5) * 1e-4
            step[3] = 0
            assert base <= _objective_plain(x, y, coef + step, b0 + 1e-4 *
                                            rng.standard_normal(), 1.5, mix)


def _objective_plain(x, y, coef, b0, reg, mix):
    sx, sy = x.std(axis=0), y.std()
    b = coef * sx / sy
    return ((y - x @ coef - b0) ** 2).mean() / (2 * sy * sy) + reg / sy * (
        mix * np.abs(b).sum() + (1 - mix) / 2 * (b * b).sum())


def test_constant_label():
    x = np.arange(10.0)[:, None]
    y = np.full(10, 4.0)
    m = MO.Moments(10.0, x.sum(0), 40.0, x.T @ x, x.T @ y, y @ y)
    coef, b0 = MO.elastic_net(m, 0.5, 0.5, True)
    assert coef[0] == 0 and b0 == 4.0


def test_products_of_sparse_and_dense_vectors(spark):
    rows = [(0, Vectors.sparse(3, [0, 2], [1.0, 2.0]), 5.0),
            (0, Vectors.dense([0.0, 3.0, 4.0]), 1.0),
            (1, Vectors.sparse(3, [], []), 2.0)]
    df = spark.createDataFrame(rows, ["f", "v", "y"])
    got = MO.moments_by(df, "v", "y", "f", 3)
    x = np.array([[1.0, 0, 2], [0, 3, 4]])
    y = np.array([5.0, 1.0])
    assert (got[0].xx == x.T @ x).all() and (got[0].xy == x.T @ y).all()
    assert (got[0].n, got[0].y, got[0].yy) == (2, 6, 26)
    assert got[1].n == 1 and got[1].yy == 4 and not got[1].xx.any()
    with pytest.raises(ValueError):
        MO.moments_by(df, "v", "y", "f", MO.MAX_WIDTH + 1)


def test_correlation_row_of_wide_vectors(spark):
    """5,000 slots: one row equals that of the whole matrix."""
    rng = np.random.default_rng(4)
    p = 5000
    rows = []
    for i in range(60):
        at = np.sort(rng.choice(p - 1, 400, replace=False))
        rows.append((i, Vectors.sparse(
            p, [*at.tolist(), p - 1],
            [*(1e4 + rng.standard_normal(400)).tolist(),
             float(rng.standard_normal() + 50)])))
    df = spark.createDataFrame(rows, ["id", "v"])
    want = Correlation.corr(df, "v").first()[0].toArray()[p - 1]
    got = {r.slot: r.corr for r in
           MO.slot_correlations(df, "v", p - 1).collect()}
    assert math.isclose(got.pop(p - 1), 1.0)
    for slot, c in got.items():
        assert abs(c - want[slot]) < 1e-9
    assert all(math.isnan(want[i]) for i in range(p - 1) if i not in got)


def test_correlation_with_a_null_label(spark):
    rows = [(Vectors.dense([float(i), 1.0, 0.0]), None if i == 3 else
             2.0 * i) for i in range(8)]
    df = spark.createDataFrame(rows, ["v", "y"])
    got = {r.slot: r.corr for r in
           MO.slot_correlations(df, "v", F.col("y")).collect()}
    assert math.isclose(got[0], 1.0) and got[1] is None and 2 not in got
    empty = MO.slot_correlations(df.limit(0), "v", F.col("y"))
    assert empty.collect() == []


def test_running_totals(spark):
    rows = [("a", i % 7, 1) for i in range(500)] + [("b", 1, 2)] * 3
    got = running(spark.createDataFrame(rows, "g string, o int, w int"),
                  ["g"], ["o"], {"rank": F.lit(1), "sum": F.col("w")})
    a = sorted((r.o, r.rank) for r in got.filter("g = 'a'").collect())
    assert [r for _, r in a] == list(range(500))
    assert sorted(r.sum for r in got.filter("g = 'b'").collect()) == [0, 2, 4]
    none = spark.createDataFrame([], "g string, o int")
    assert running(none, ["g"], ["o"], {"n": F.lit(1)}).count() == 0


def test_frequency_index_of_two_million_values(spark):
    """Ranked on the cluster; nothing but the checked rows is collected."""
    n = 2_000_000
    counts = spark.range(n).select(
        F.lit("c").alias("column_name"),
        F.format_string("v%07d", "id").alias("value"),
        (F.col("id") % 3).alias("n"))
    index = E.frequency_index(counts)
    size = [len(range(r, n, 3)) for r in range(3)]
    # the k-th value with count r
    place = F.col("id") - F.col("r")
    want = counts.withColumns({
        "id": F.substring("value", 2, 7).cast("long"), "r": F.col("n")}) \
        .select("value", (F.when(F.col("r") == 0, 0).when(
            F.col("r") == 1, size[0]).otherwise(size[0] + size[1])
            + place / 3).cast("double").alias("want"))
    bad = index.join(want, "value").filter("idx <> want")
    assert bad.isEmpty() and index.count() == n


def test_index_by_table_equals_the_indexer(spark):
    rows = [(i, v, w) for i, (v, w) in enumerate(
        [("a", "x"), ("b", "x"), ("a", "y"), ("c", "z"), ("b", "z"),
         ("a", "z")])]
    df = spark.createDataFrame(rows, "k int, p string, q string")
    want, _ = E.index_columns(df, ["p", "q"], ["pi", "qi"])
    index = E.frequency_index(PR.value_counts(df, ["p", "q"], order=False))
    got = E.index_by_table(df, index, ["p", "q"], ["pi", "qi"])
    assert sorted(map(tuple, got.collect())) == \
        sorted(map(tuple, want.collect()))
    more = E.index_by_table(spark.createDataFrame(
        [(9, None, "new")], "k int, p string, q string"), index,
        ["p", "q"], ["pi", "qi"]).first()
    assert more.pi is None and more.qi is None


def test_sketches_merge_like_one(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 9).alias("day"), (F.col("id") % 70_001).alias("v"),
        F.when(F.col("id") % 2 == 0, "even").alias("w"))
    days = PR.distinct_sketches(df, ["v", "w"], ["day"])
    assert days.count() == 18
    got = {r.column_name: r.n_distinct
           for r in PR.union_sketches(days).collect()}
    whole = {r.column_name: r.n_distinct for r in PR.union_sketches(
        PR.distinct_sketches(df, ["v", "w"], [])).collect()}
    assert got == whole and got["w"] == 1
    assert abs(got["v"] / 70_001 - 1) < 3 * 1.04 / 64
