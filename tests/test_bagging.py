"""Forests bagged by the record key."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from paysift.operators import bagging as BG
from paysift.operators import metrics as M
from paysift.operators import ranking as R
from paysift.plans import features as P
from paysift.plans.analysis import model_frames


@pytest.fixture(scope="module")
def frames(spark):
    return model_frames(spark, SMALL)


def test_weights_are_poisson_and_follow_the_key(spark):
    df = spark.range(40_000).withColumnRenamed("id", "k")
    one = df.select("k", BG.bag_weight("k", 0).alias("w"),
                    BG.bag_weight("k", 1).alias("v"))
    again = {r.k: r.w for r in one.repartition(7).collect()}
    assert again == {r.k: r.w for r in one.collect()}
    share = {r.w: r["count"] / 40_000 for r in
             one.groupBy("w").count().collect()}
    for k in range(4):
        assert abs(share[float(k)] - math.exp(-1) / math.factorial(k)) < 0.01
    assert abs(one.corr("w", "v")) < 0.02


def test_forest_does_not_depend_on_the_layout(spark, frames, monkeypatch):
    """4 and 16 partitions, rows in another order: the same forest."""
    train, test = frames
    monkeypatch.setattr(BG.TR, "ROWS_PER_TASK", 1)
    found = []
    for n, order in ((4, "rec_id"), (16, F.desc("rec_id"))):
        rows = train.repartition(n).sortWithinPartitions(order)
        m = BG.fit_bagged_forest(rows, P.LABEL, "features", P.KEY, 6,
                                 maxDepth=4)
        pred = {r[0]: r[1] for r in m.transform(test).select(
            P.KEY, "prediction").collect()}
        found.append((m.featureImportances.toArray(), pred))
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-9)
    assert found[0][1] == pytest.approx(found[1][1], rel=1e-9)


def test_forest_grows_and_is_the_mean_of_its_trees(spark, frames):
    train, test = frames
    five = BG.fit_bagged_forest(train, P.LABEL, "features", P.KEY, 5,
                                maxDepth=3)
    more = BG.fit_bagged_forest(train, P.LABEL, "features", P.KEY, [3, 4],
                                maxDepth=3)
    for a, b in zip(five.trees[3:], more.trees):
        assert a.toDebugString.split("\n")[1:] == \
            b.toDebugString.split("\n")[1:]
    assert len({t.toDebugString.split("\n", 1)[1]
                for t in five.trees}) == 5
    cols = []
    rows = test
    for i, t in enumerate(five.trees):
        rows = t.copy().setPredictionCol(f"p{i}").transform(rows)
        cols.append(F.col(f"p{i}"))
    want = {r[0]: r[1] for r in rows.select(
        P.KEY, (sum(cols[1:], cols[0]) / 5).alias("m")).collect()}
    got = {r[0]: r[1] for r in five.transform(test).select(
        P.KEY, "prediction").collect()}
    assert got == pytest.approx(want)
    assert math.isclose(sum(five.featureImportances.toArray()), 1.0)
    # it takes part in a leaderboard and in the importance table
    board = {r.metric: r.value for r in
             M.score_models({"bag": five}, test, P.LABEL).collect()}
    assert board["r2"] > 0.5
    top = R.feature_importance(five, train, "features", k=3).collect()
    assert [r.rank for r in top] == [1, 2, 3]
