"""The flagship analysis: clean -> categorize -> encode -> hash split ->
train the four families -> leaderboard.

Unlike the original, learned values (mode, mean, category indexes) come
from the training part only, so no test row leaks into the features; pass
``fit_on_train=False`` for the original behaviour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from paysift.operators import encode as E
from paysift.operators import metrics as M
from paysift.operators import train as TR
from paysift.plans import features as P
from paysift.plans import tuning as TU
from paysift.sources.tables import comp_view

FAMILIES = ("linear", "tree", "forest", "boosting")


def model_frames(spark: SparkSession, sf_dir: str, train_percent: int = 70,
                 fit_on_train: bool = True
                 ) -> tuple[DataFrame, DataFrame]:
    """(train, test) frames of (rec_id, vectors, total_comp).

    The narrow model input is written once to the shared folder: every
    fit and scoring then reads that copy (no re-scan, re-join or
    re-encoding), and a lost executor costs a re-read, not a recompute.
    """
    fit_filter = P.train_filter(train_percent) if fit_on_train else None
    comp = comp_view(spark, sf_dir)
    feats = P.feature_frame(comp, fit_filter=fit_filter)
    return E.materialized_split(P.model_input(feats), P.KEY, train_percent)


def run(spark: SparkSession, sf_dir: str,
        families: Sequence[str] = FAMILIES, **kw) -> DataFrame:
    """Leaderboard (model, metric, value, n_undefined) on the test part."""
    train, test = model_frames(spark, sf_dir, **kw)
    models = TR.fit_many({fam: TU.estimator(fam, train)
                          for fam in families}, train)
    return M.score_models(models, test, P.LABEL)
