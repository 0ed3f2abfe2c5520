"""The original analysis end to end, as one call returning named tables.

Profiles at each cleaning step, value counts, summaries, label histogram,
bucket cardinality, default vs tuned models (the original grids by
default, with 5 folds), best parameters, forest importances and
correlation ranks.  Every value is a DataFrame; nothing is printed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import lookups as L
from paysift.operators import clean as C
from paysift.operators import encode as E
from paysift.operators import profile as PR
from paysift.operators import ranking as R
from paysift.operators import train as TR
from paysift.plans import features as P
from paysift.plans import tuning as TU
from paysift.sources.tables import comp_view


def original_analysis(spark: SparkSession, sf_dir: str,
                      grids: Mapping[str, Mapping] = TU.FULL_GRIDS,
                      folds: int = L.NUM_FOLDS, fit_on_train: bool = False,
                      top_k: int = L.TOP_K) -> dict[str, DataFrame]:
    """Run the whole analysis; ``fit_on_train=False`` learns fills and
    indexes on all rows like the original, True on the training part."""
    comp = comp_view(spark, sf_dir)
    out: dict[str, DataFrame] = {
        "row_count": PR.row_count(comp),
        "schema": PR.schema_profile(comp),
        "nulls_raw": PR.null_profile(comp),
        "null_heatmap": PR.null_rate_by_bucket(comp, P.KEY, 20),
    }
    labeled = C.require(comp, P.LABEL)
    out["nulls_labeled"] = PR.null_profile(labeled)
    out["level_counts"] = PR.value_counts(labeled, "std_level")

    fit_filter = P.train_filter(70) if fit_on_train else None
    learned = P.learn(comp, fit_filter)
    cleaned, _ = P.clean(comp, fit_filter, learned)
    out["gender_counts"] = PR.value_counts(cleaned, "gender")
    out["skill_summary"] = PR.summary(cleaned, [P.SKILL_OUT])
    out["label_summary"] = PR.summary(cleaned, [P.LABEL])
    out["label_histogram"] = PR.histogram(cleaned, P.LABEL, bins=20)
    out["label_quartiles"] = PR.quantiles(cleaned, P.LABEL)
    out["nulls_clean"] = PR.null_profile(cleaned)
    out["title_tag_counts"] = PR.value_counts(cleaned, ["title", "tag"])

    cat = P.categorize(cleaned)
    out["bucket_cardinality"] = PR.distinct_counts(
        cat, ["cat_comp", "cat_title", "cat_location", "cat_tag"])
    feats = P.encode(cat, learned, handle_invalid="keep" if fit_on_train
                     else "error")
    out["feature_summary"] = PR.summary(
        feats, ["years_exp", "years_at", P.SKILL_OUT, P.LABEL,
                "cat_comp_idx", "cat_tag_idx"])
    out["slots"] = E.slot_table(feats, "features")

    train, test = E.materialized_split(P.model_input(feats), P.KEY)
    board, tuned = TU.compare(spark, train, test, grids, folds=folds)
    out["leaderboard"] = board
    best = None
    for fam, model in tuned.items():
        t = TR.best_params(spark, model).select(F.lit(fam).alias("model"),
                                                "param", "value")
        best = t if best is None else best.unionByName(t)
    out["best_params"] = best
    forest = TU.estimator("forest", train).fit(train)
    out["importance"] = R.feature_importance(forest, train, "features",
                                             k=top_k)
    corr = R.label_correlation(feats, "features", P.LABEL)
    out["correlation"] = corr
    out["correlation_rank"] = R.rank_by_abs(corr, k=top_k)
    return out
