"""The tuning loops over whole grids: every family's points on sf0.001, the
shared fits and the pool of fits of all folds."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from paysift.operators import encode as E
from paysift.operators import train as TR
from paysift.plans import features as P
from paysift.plans import tuning as TU
from paysift.plans.analysis import model_frames


@pytest.fixture(scope="module")
def train(spark):
    return model_frames(spark, SMALL)[0]


@pytest.mark.parametrize("family", ["linear", "tree", "forest", "boosting"])
def test_whole_grid_runs(spark, train, family):
    """All points of the original grid, 5 folds, every error finite; the
    best parameters are those of the smallest one."""
    grid = TU.FULL_GRIDS[family]
    tuned = TU.tune_family(train, family, grid)
    assert len(tuned.metrics) == len(TR.grid_points(grid))
    assert all(math.isfinite(e) and e > 0 for e in tuned.metrics)
    best = {r.param: r.value for r in TR.best_params(spark, tuned).collect()}
    for k, v in tuned.best.items():
        assert best[k] == str(v)
    assert {r.param: r.value for r in TR.best_point(spark, tuned).collect()} \
        == {k: str(v) for k, v in tuned.best.items()}
    table = TR.tuning_table(spark, tuned).collect()
    assert [r.rmse for r in table] == tuned.metrics


@pytest.mark.parametrize("family,points", [
    ("tree", [0, 5, 23]), ("forest", [0, 7]), ("boosting", [1, 4])])
def test_grid_errors_equal_single_fits(spark, train, family, points):
    """Some points of each grid, fitted one by one on two folds."""
    grid = dict(TU.FULL_GRIDS[family])
    if "maxBins" in grid:
        grid["maxBins"] = [TR.safe_max_bins(train, "features", b)
                           for b in grid["maxBins"]]
    every = TR.grid_points(grid)
    est = TU.estimator(family, train)
    chosen = [every[i] for i in points]
    splits = [(train.where(F.col(E.FOLD) != f), train.where(
        F.col(E.FOLD) == f)) for f in (0, 3)]
    got = TR._errors(est, chosen, splits, P.LABEL, None)
    for row, (fit, held) in zip(got, splits):
        for error, p in zip(row, chosen):
            single = TR._rmse(TR._with(est, p).fit(TR.packed(fit)), held,
                              P.LABEL)
            assert math.isclose(error, single, rel_tol=1e-9)


def test_fits_in_flight_follow_cores_and_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(10).coalesce(1)
    assert TR.in_flight(one) == max(2, min(32, 2 * cores))
    assert TR.in_flight(spark.range(0, 1000, 1, 4 * cores)) == 2
    assert TR.in_flight(one, most=3) == 3


def test_forest_depths_share_a_fit(spark, train):
    """One deep forest of each size answers all depths, as its own cut."""
    est = TU.estimator("forest", train)
    points = TR.grid_points(TU.FULL_GRIDS["forest"])
    shared, groups = TR._groups(est, points)
    assert shared == "maxDepth"
    assert [[points[i]["numTrees"] for i in g] for g in groups] == \
        [[10] * 4, [20] * 4, [30] * 4]
    chosen = [{"numTrees": 3, "maxDepth": d} for d in (1, 3, 6)]
    fit, held = (train.where(c) for c in (F.col(E.FOLD) != 1,
                                          F.col(E.FOLD) == 1))
    got = TR._group_errors(est, chosen, "maxDepth", TR.packed(fit), held,
                           P.LABEL)
    for error, p in zip(got, chosen):
        single = TR._rmse(TR._with(est, p).fit(TR.packed(fit)), held,
                          P.LABEL)
        assert math.isclose(error, single, rel_tol=1e-9)


def test_a_failing_fit_is_reported(spark, train):
    est = TU.estimator("tree", train)
    with pytest.raises(Exception, match="maxBins"):
        TR.tune_cross_validation(est, {"maxBins": [2]}, train, P.LABEL,
                                 E.FOLD)


def test_forest_fits_of_a_grid_keep_node_ids(spark, train, monkeypatch):
    """Rows remember their nodes while a grid is tuned; the winner's own
    parameters stay as they were."""
    kept = []
    fit = TR.RandomForestRegressor.fit

    def watched(self, df, *args):
        kept.append(self.getCacheNodeIds())
        return fit(self, df, *args)
    monkeypatch.setattr(TR.RandomForestRegressor, "fit", watched)
    tuned = TR.tune_cross_validation(
        TU.estimator("forest", train),
        {"numTrees": [2], "maxDepth": [1, 2]},
        train.withColumn("__f", F.col(E.FOLD) % 2), P.LABEL, "__f", 2)
    assert kept == [True, True, False]
    assert not tuned.bestModel.getCacheNodeIds()
