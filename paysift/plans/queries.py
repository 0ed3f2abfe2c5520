"""Registered queries over the adapter view.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads the driver tables
in full.  Computed columns carry the same names as in the SQL of
``paysift.plans.oracle``; real-valued results are rounded where the two
engines may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import lookups as L
from paysift.functions.exprs import (location_key, location_region,
                                     safe_int)
from paysift.operators import bagging as BG
from paysift.operators import categorize as CT
from paysift.operators import clean as C
from paysift.operators import encode as E
from paysift.operators import metrics as M
from paysift.operators import profile as PR
from paysift.operators import ranking as R
from paysift.operators import train as TR
from paysift.plans import features as P
from paysift.plans.analysis import run as run_analysis
from paysift.plans import tuning as TU
from paysift.session import materialize
from paysift.sources.tables import (comp_view, planted_view, read_view,
                                    register_view)

LABEL = P.LABEL
KEY = P.KEY
NUMERIC_RAW = ["years_exp", "years_at", "skill_index", LABEL]


# --------------------------------------------------------------------------
# Shared inputs
# --------------------------------------------------------------------------

def _comp(spark: SparkSession, sf: str) -> DataFrame:
    return comp_view(spark, sf)


def _labeled_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept by cleaning (label present and below the cap), numbers
    cast; the same rows as the full cleaning, without the fills."""
    d = C.cap(C.require(comp_view(spark, sf), LABEL), LABEL, L.LABEL_CAP)
    return C.cast_double(d, ["years_exp", "years_at", LABEL])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """The full feature frame; learned values from all cleaned rows, as in
    the original analysis."""
    return P.feature_frame(comp_view(spark, sf))


def _one_feature(d: DataFrame, cols: list[str], out: str) -> DataFrame:
    return E.assemble(d, cols, out)


def _counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# Sources, profile, clean (Q01-Q17)
# --------------------------------------------------------------------------

def q01_view_round_trip(spark, sf):
    register_view(_comp(spark, sf), "comp_t1")
    return _counts(read_view(spark, "comp_t1"), "company")


def q02_preview(spark, sf):
    return PR.preview(_comp(spark, sf), 5, order_by=[KEY],
                      cols=[KEY, "company", "title"])


def q03_row_count(spark, sf):
    return PR.row_count(_comp(spark, sf))


def q04_schema(spark, sf):
    return PR.schema_profile(_comp(spark, sf))


def q05_drop_named(spark, sf):
    return C.drop_columns(_comp(spark, sf), ["years_at", "no_such_column"])


def q06_drop_empty(spark, sf):
    return C.drop_empty_columns(_comp(spark, sf))


def q07_null_profile(spark, sf):
    return PR.null_profile(_comp(spark, sf))


def q07b_null_profile_labeled(spark, sf):
    """Nulls after the label filter."""
    return PR.null_profile(C.require(_comp(spark, sf), LABEL))


def q07c_null_profile_clean(spark, sf):
    """Nulls after repair."""
    cleaned, _ = P.clean(_comp(spark, sf))
    return PR.null_profile(cleaned)


def q08_require_label(spark, sf):
    return PR.row_count(C.require(_comp(spark, sf), LABEL))


def q09_null_by_bucket(spark, sf):
    return PR.null_rate_by_bucket(_comp(spark, sf), KEY, 20)


def q10_fill_constants(spark, sf):
    d = C.fill_constants(_comp(spark, sf), {
        "gender": L.GENDER_FILL, "other_details": L.OTHER_DETAILS_FILL})
    return _counts(d, "gender", "other_details")


def q10b_fill_level(spark, sf):
    """The level filled with its constant."""
    d = C.fill_constants(_comp(spark, sf),
                         {"std_level": L.STANDARD_LEVEL_FILL})
    return _counts(d, "std_level")


def q11_fill_mode(spark, sf):
    d, _ = C.fill_mode(_comp(spark, sf), ["std_level"])
    return _counts(d, "std_level")


def q12_mean_impute(spark, sf):
    d, _ = C.impute_mean(_comp(spark, sf), ["skill_index"])
    return d.select(KEY, F.round("skill_index_imputed", 6)
                    .alias("skill_imputed"))


def q13_outlier_cap(spark, sf):
    d = C.cap(C.require(_comp(spark, sf), LABEL), LABEL, L.LABEL_CAP)
    return d.agg(F.count(F.lit(1)).alias("n"),
                 F.max(F.col(LABEL).try_cast("double")).alias("max_label"))


def q14_summary(spark, sf):
    s = PR.summary(_comp(spark, sf), NUMERIC_RAW)
    return s.select("column_name", "n", F.round("mean", 6).alias("mean"),
                    F.round("stddev", 6).alias("stddev"), "min_value",
                    "max_value")


def q14b_clean_summary(spark, sf):
    """Summary of the repaired numeric features and the capped label."""
    cleaned, _ = P.clean(_comp(spark, sf))
    s = PR.summary(cleaned, ["skill_index_imputed", "years_exp", "years_at",
                             LABEL])
    return s.select("column_name", "n", F.round("mean", 6).alias("mean"),
                    F.round("stddev", 6).alias("stddev"), "min_value",
                    "max_value")


FRAME_COLUMNS = [KEY, "years_exp", "years_at", LABEL, P.SKILL_OUT, "masters",
                 *P.INDEX_OUT]


def q14c_frame_summary(spark, sf):
    """Every number of the feature frame, cast to double but for the
    indexes, and summarised."""
    f = _features(spark, sf).select(*FRAME_COLUMNS)
    s = PR.summary(C.cast_all_double_except(f, P.INDEX_OUT), FRAME_COLUMNS)
    return s.select("column_name", "n", F.round("mean", 6).alias("mean"),
                    F.round("stddev", 6).alias("stddev"), "min_value",
                    "max_value")


def q15_value_counts(spark, sf):
    return PR.value_counts(_comp(spark, sf),
                           ["std_level", "gender", "title", "tag"])


def q16_distinct_counts(spark, sf):
    return PR.distinct_counts(_comp(spark, sf),
                              ["company", "title", "location", "tag"])


def q16c_bucket_cardinality(spark, sf):
    """Distinct buckets after categorizing (at most list size + 1)."""
    cat = P.categorized(_comp(spark, sf))
    return PR.distinct_counts(cat, ["cat_comp", "cat_title", "cat_location",
                                    "cat_tag"])


def q16b_distinct_rows(spark, sf):
    d = C.fill_constants(_comp(spark, sf),
                         {"other_details": L.OTHER_DETAILS_FILL})
    return PR.distinct_rows(d, ["other_details"])


def q16d_distinct_sketches(spark, sf):
    """Distinct counts from sketches kept per year of experience: whether
    the estimate of their union equals that of a sketch of all rows, and lies
    within three standard errors of the exact count."""
    cols = ["rec_id", "company", "location", "tag", "total_comp"]
    d = _comp(spark, sf)
    parts = PR.union_sketches(materialize(
        PR.distinct_sketches(d, cols, ["years_exp"])))
    whole = PR.union_sketches(PR.distinct_sketches(d, cols, [])) \
        .withColumnRenamed("n_distinct", "n_whole")
    exact = PR.distinct_counts(d, cols).withColumnRenamed("n_distinct",
                                                          "n_exact")
    bound = 3 * 1.04 / 2 ** 6 * F.col("n_exact")
    return exact.join(parts, "column_name").join(whole, "column_name") \
        .select("column_name", "n_exact",
                (F.col("n_distinct") == F.col("n_whole")).alias("same"),
                (F.abs(F.col("n_distinct") - F.col("n_exact")) <= bound)
                .alias("within"))


def q17_histogram(spark, sf):
    return PR.histogram(_labeled_numeric(spark, sf), LABEL, bins=20)


def q17c_int_histogram(spark, sf):
    """Distribution of the label read as a whole number."""
    d = C.cap(C.require(_comp(spark, sf), LABEL), LABEL, L.LABEL_CAP)
    return PR.histogram(d.withColumn(LABEL, safe_int(LABEL)), LABEL, bins=20)


def q17b_quartiles(spark, sf):
    return PR.quantiles(_labeled_numeric(spark, sf), LABEL)


# --------------------------------------------------------------------------
# Categorize (Q18-Q23)
# --------------------------------------------------------------------------

def q18_keep_list(spark, sf):
    d = CT.keep_list(_comp(spark, sf), "company", L.ADAPTER_COMPANY_KEEP,
                     "cat_comp")
    return _counts(d, "cat_comp")


def q19_title_ladder(spark, sf):
    d = CT.map_ladder(_comp(spark, sf), "title", L.ADAPTER_TITLE_LADDER,
                      "cat_title")
    return _counts(d, "cat_title")


def q20_location_lookup(spark, sf):
    c = _comp(spark, sf)
    return c.select(location_key("location").alias("location_key"),
                    location_region("location").alias("region")).distinct()


def q21_location_router(spark, sf):
    d = CT.route_location(_comp(spark, sf), "location", "cat_location")
    return _counts(d, "location", "cat_location")


def q22_tag_buckets(spark, sf):
    counts = _counts(_comp(spark, sf), "tag")
    keep = CT.keep_list(counts, "tag", L.ADAPTER_TAG_KEEP, "cat_tag") \
        .groupBy("cat_tag").agg(F.sum("n").alias("n")) \
        .select(F.lit("keep").alias("mode"), "cat_tag", "n")
    top = CT.top_k_bucket_counts(counts, "tag", "n", 2, "cat_tag") \
        .select(F.lit("top_k").alias("mode"), "cat_tag", "n")
    return keep.unionByName(top)


def q22c_tag_top_k(spark, sf):
    """The top-k rule on rows."""
    return CT.top_k_or_other(_comp(spark, sf), "tag", 2, "cat_tag").select(
        KEY, "cat_tag")


def q18b_original_companies(spark, sf):
    d = CT.keep_list(planted_view(spark, sf), "company", L.COMPANY_KEEP,
                     "cat_comp")
    return _counts(d, "company", "cat_comp")


def q19b_original_titles(spark, sf):
    d = CT.map_ladder(planted_view(spark, sf), "title", L.TITLE_LADDER,
                      "cat_title")
    return _counts(d, "title", "cat_title")


def q21b_original_locations(spark, sf):
    d = CT.route_location(planted_view(spark, sf), "location",
                          "cat_location")
    return _counts(d, "location", "cat_location")


def q22b_original_tags(spark, sf):
    d = CT.keep_list(planted_view(spark, sf), "tag", L.TAG_KEEP, "cat_tag")
    return _counts(d, "tag", "cat_tag")


def q23_degree_flag(spark, sf):
    d = CT.regex_flag(_comp(spark, sf), "other_details", "masters")
    return _counts(d, "masters")


# --------------------------------------------------------------------------
# Encode (Q24-Q29)
# --------------------------------------------------------------------------

def q24_frequency_index(spark, sf):
    return E.frequency_index(P.label_counts(_comp(spark, sf))[2])


def q25_one_hot(spark, sf):
    f = _features(spark, sf)
    return E.explode_vector(f, KEY, "cat_location_vec")


def q26_dense_sparse(spark, sf):
    """Sums per slot of the dense forms."""
    f = _features(spark, sf).select(*P.ONEHOT_OUT)
    for v in P.ONEHOT_OUT:
        f = E.densify(f, v, v)
    return E.slot_totals(f, P.ONEHOT_OUT)


def q27_assembled(spark, sf):
    f = _features(spark, sf)
    return E.explode_vector(f, KEY, "features").select(
        KEY, "slot", F.round("val", 6).alias("val"))


def q28_random_split(spark, sf):
    """The random split of a written model input: all rows, rows in both
    parts, rows in none."""
    f = stash_keys(P.model_input(_features(spark, sf)))
    train, test = E.random_split(f, L.SPLIT_WEIGHTS, L.SPLIT_SEED)
    both = train.select(KEY).unionByName(test.select(KEY)).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"))
    return f.select(KEY).join(both, KEY, "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_overlap"),
        F.count_if(F.col("n").isNull()).alias("n_missing"))


def stash_keys(df: DataFrame) -> DataFrame:
    """The keys of a frame, written once."""
    return materialize(df.select(KEY))


def q29_hash_split(spark, sf):
    d = _labeled_numeric(spark, sf)
    part = F.when(E.hash_part(KEY, 70), "train").otherwise("test")
    return d.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(KEY).alias("sum_id"))


# --------------------------------------------------------------------------
# Linear models and metrics (Q30-Q36)
# --------------------------------------------------------------------------

def _linear_part(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = _labeled_numeric(spark, sf).select(KEY, "years_exp", "years_at",
                                           LABEL)
    return E.materialized_split(d, KEY)


def _fit(train: DataFrame, cols: list[str]):
    return TR.linear(LABEL, "x").fit(_one_feature(train, cols, "x"))


def q30_linear_coefs(spark, sf):
    train, _ = _linear_part(spark, sf)
    one = _fit(train, ["years_exp"])
    two = _fit(train, ["years_exp", "years_at"])
    rows = [("one", "intercept", float(one.intercept)),
            ("one", "years_exp", float(one.coefficients[0])),
            ("two", "intercept", float(two.intercept)),
            ("two", "years_exp", float(two.coefficients[0])),
            ("two", "years_at", float(two.coefficients[1]))]
    return spark.createDataFrame(rows, "model string, term string, "
                                       "coef double").select(
        "model", "term", F.round("coef", 4).alias("coef"))


def q30b_group_coefs(spark, sf):
    """The linear family on one contrast column: the intercept is the mean
    of the dropped group, a coefficient the difference to it."""
    comp = _comp(spark, sf)
    learned = P.learn(comp)
    f = P.encode(P.categorized(comp, learned=learned), learned)
    vec = P.LINEAR_VEC["gender_idx"]
    train, _ = E.materialized_split(f.select(KEY, vec, LABEL), KEY)
    m = TR.linear(LABEL, vec).fit(train)
    names = learned.labels["gender"]
    rows = [("intercept", float(m.intercept))] + [
        (n, float(c)) for n, c in zip(names, m.coefficients)]
    return spark.createDataFrame(rows, "term string, coef double").select(
        "term", F.round("coef", 4).alias("coef"))


def _scored_two(spark, sf) -> DataFrame:
    train, test = _linear_part(spark, sf)
    two = _fit(train, ["years_exp", "years_at"])
    t = _one_feature(test, ["years_exp", "years_at"], "x")
    return TR.score(two, t, keep=[KEY, LABEL])


def q31_scored(spark, sf):
    return _scored_two(spark, sf).select(
        KEY, F.round("prediction", 4).alias("prediction"))


def q32_smape_mape(spark, sf):
    m = M.regression_metrics(_scored_two(spark, sf), LABEL)
    return m.where(F.col("metric").isin("smape", "mape")).select(
        "metric", F.round("value", 6).alias("value"), "n_undefined")


def q33_rmse_r2(spark, sf):
    m = M.regression_metrics(_scored_two(spark, sf), LABEL)
    return m.where(F.col("metric").isin("rmse", "r2")).select(
        "metric", F.round("value", 6).alias("value"))


def _model_frames(spark, sf):
    """(train, test) of the narrow model input, written once to the
    shared folder so the many passes of fitting read that copy."""
    return E.materialized_split(P.model_input(_features(spark, sf)), KEY)


def q34_leaderboard(spark, sf):
    train, test = _model_frames(spark, sf)
    models = TR.fit_many({fam: TU.estimator(fam, train) for fam in
                          ("linear", "tree", "forest", "boosting")}, train)
    lb = M.score_models(models, test, LABEL)
    return lb.select("model", "metric", F.round("value", 6).alias("value"))


def q34b_tuned_leaderboard(spark, sf):
    """Default vs tuned (CV, and TVS for linear) per family on the test
    part, over the original grids with 5 folds."""
    train, test = _model_frames(spark, sf)
    lb, _ = TU.compare(spark, train, test)
    return lb.select("model", "stage", "metric",
                     F.round("value", 6).alias("value"))


def q34c_leaderboard_train_fit(spark, sf):
    """The flagship: learned values fitted on the training part only."""
    lb = run_analysis(spark, sf)
    return lb.select("model", "metric", F.round("value", 6).alias("value"))


def q35_train_validation(spark, sf):
    """Train/validation tuning of the linear family, all 30 points."""
    train, _ = _model_frames(spark, sf)
    return TR.tuning_table(spark, TU.tune_split(
        train, "linear", L.LINEAR_GRID)).select(
        "point", F.round("rmse", 4).alias("rmse"))


def q35b_train_validation_exact(spark, sf):
    """The same split tuning where SQL can follow: one feature, no penalty,
    with and without intercept."""
    train, _ = _linear_part(spark, sf)
    t = _one_feature(train, ["years_exp"], "x")
    tuned = TR.tune_train_validation(
        TR.linear(LABEL, "x", regParam=0.0),
        {"fitIntercept": [True, False]}, t, LABEL, KEY)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


def q36_cv_folds(spark, sf):
    train, _ = _linear_part(spark, sf)
    t = _one_feature(train, ["years_exp"], "x").withColumn(
        "fold", (F.col(KEY) % 5).cast("int"))
    tuned = TR.tune_cross_validation(
        TR.linear(LABEL, "x", regParam=0.0), {"fitIntercept": [True, False]},
        t, LABEL, "fold", folds=5)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


def _one_feature_folds(spark, sf) -> DataFrame:
    train, _ = _linear_part(spark, sf)
    return _one_feature(train, ["years_exp"], "x").withColumn(
        "fold", (F.col(KEY) % 5).cast("int"))


def q35c_elastic_split_exact(spark, sf):
    """Train/validation tuning over the whole original linear grid, on one
    feature, where each point has a closed form."""
    tuned = TR.tune_train_validation(
        TR.linear(LABEL, "x"), L.LINEAR_GRID, _one_feature_folds(spark, sf),
        LABEL, KEY)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


def _elastic_folds(spark, sf) -> TR.Tuned:
    return TR.tune_cross_validation(
        TR.linear(LABEL, "x"), L.LINEAR_GRID, _one_feature_folds(spark, sf),
        LABEL, "fold", folds=5)


def q36c_elastic_grid_exact(spark, sf):
    """5-fold cross-validation over the whole original linear grid, on one
    feature."""
    return TR.tuning_table(spark, _elastic_folds(spark, sf)).select(
        "point", F.round("rmse", 4).alias("rmse"))


def q36d_elastic_best_exact(spark, sf):
    """The best parameters of that grid."""
    return TR.best_point(spark, _elastic_folds(spark, sf))


def q36b_linear_grid(spark, sf):
    """Best parameters of the cross-validated linear model (M16)."""
    return _grid_best(spark, sf, "linear")


# --------------------------------------------------------------------------
# Trees, forests, boosting (Q37-Q41b)
# --------------------------------------------------------------------------

def _stump_input(spark, sf) -> DataFrame:
    train, _ = _linear_part(spark, sf)
    return _one_feature(train, ["years_exp"], "x")


def _leaf_result(model, t: DataFrame) -> DataFrame:
    return TR.leaf_table(model, t).select(
        "leaf", "n", F.round("prediction", 4).alias("prediction"))


def q37_tree_stump(spark, sf):
    t = _stump_input(spark, sf)
    m = TR.tree(LABEL, "x", max_bins=32, maxDepth=1).fit(t)
    return _leaf_result(m, t)


def _grid_best(spark, sf, family: str) -> DataFrame:
    """The winner of a family's original grid, 5 folds."""
    train, _ = _model_frames(spark, sf)
    return TR.best_params(spark, TU.tune_family(
        train, family, TU.FULL_GRIDS[family]))


def q38_tree_grid(spark, sf):
    return _grid_best(spark, sf, "tree")


def q38b_tree_cv_stump(spark, sf):
    """3-fold CV (fold column) of a depth-1 tree on years_exp: the mean
    held-out RMSE, exactly checkable by a per-fold split search."""
    t = _stump_input(spark, sf).withColumn(
        "fold", (F.col(KEY) % 3).cast("int"))
    tuned = TR.tune_cross_validation(
        TR.tree(LABEL, "x", max_bins=32, maxDepth=1), {"maxDepth": [1]}, t,
        LABEL, "fold", folds=3)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


TREE_COLS = ["years_exp", "years_at", "masters_flag"]


def _tree_input(spark, sf) -> DataFrame:
    """Training rows with a vector of three ordered features."""
    d = C.fill_constants(_labeled_numeric(spark, sf),
                         {"other_details": L.OTHER_DETAILS_FILL})
    d = CT.regex_flag(d, "other_details", "masters")
    d = d.withColumn("masters_flag", F.col("masters").cast("double"))
    train, _ = E.materialized_split(d.select(KEY, *TREE_COLS, LABEL), KEY)
    return _one_feature(train, TREE_COLS, "x")


def q38c_tree_cv_depths(spark, sf):
    """3-fold CV of depths 1 and 2, both read from one fit of depth 2."""
    t = _tree_input(spark, sf).withColumn(
        "fold", (F.col(KEY) % 3).cast("int"))
    tuned = TR.tune_cross_validation(
        TR.tree(LABEL, "x", max_bins=32), {"maxDepth": [1, 2]}, t, LABEL,
        "fold", folds=3)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


def q39_forest_stump(spark, sf):
    t = _stump_input(spark, sf)
    m = TR.forest(LABEL, "x", max_bins=32, maxDepth=1, numTrees=1,
                  bootstrap=False, featureSubsetStrategy="all").fit(t)
    return _leaf_result(m, t)


def q39b_bagged_stumps(spark, sf):
    """Five stumps bagged by the record key: the weight and prediction of
    their leaves."""
    t = _tree_input(spark, sf)
    model = BG.fit_bagged_forest(t, LABEL, "x", KEY, 5, subset="all",
                                 max_bins=32, maxDepth=1)
    return BG.bag_leaves(model, t, KEY).select(
        "tree", "leaf", "weight", F.round("prediction", 4)
        .alias("prediction"))


def q40_forest_grid(spark, sf):
    return _grid_best(spark, sf, "forest")


def q40b_forest_grid_exact(spark, sf):
    """3-fold CV over numbers of trees and depths of a forest that SQL can
    grow: no bootstrap, all features, so its trees are equal."""
    t = _tree_input(spark, sf).withColumn(
        "fold", (F.col(KEY) % 3).cast("int"))
    tuned = TR.tune_cross_validation(
        TR.forest(LABEL, "x", max_bins=32, bootstrap=False,
                  featureSubsetStrategy="all"),
        {"numTrees": [1, 2], "maxDepth": [1, 2]}, t, LABEL, "fold", folds=3)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


def q41_boost_stump(spark, sf):
    t = _stump_input(spark, sf)
    m = TR.boosting(LABEL, "x", max_bins=32, maxDepth=1, maxIter=1).fit(t)
    return _leaf_result(m, t)


def q41b_boost_grid(spark, sf):
    return _grid_best(spark, sf, "boosting")


def q41c_boost_grid_exact(spark, sf):
    """3-fold CV over iterations and steps of boosted stumps, both
    iterations read from one run."""
    t = _tree_input(spark, sf).withColumn(
        "fold", (F.col(KEY) % 3).cast("int"))
    tuned = TR.tune_cross_validation(
        TR.boosting(LABEL, "x", max_bins=32),
        {"maxIter": [1, 2], "maxDepth": [1], "stepSize": [0.3, 0.1]}, t,
        LABEL, "fold", folds=3)
    return TR.tuning_table(spark, tuned).select(
        "point", F.round("rmse", 4).alias("rmse"))


# --------------------------------------------------------------------------
# Ranking (Q42-Q46)
# --------------------------------------------------------------------------

CODE_COLUMNS = {"cat_location": "cat_location_vec",
                "std_level": "std_level_vec", "cat_title": "cat_title_vec",
                "gender": "gender_vec"}


def q42_code_tables(spark, sf):
    comp = _comp(spark, sf)
    learned = P.learn(comp)
    f = P.encode(P.categorized(comp, learned=learned), learned)
    at = E.slot_offsets(f, P.FEATURE_COLS)
    return E.code_table({c: learned.labels[c] for c in CODE_COLUMNS},
                        {c: at[v] for c, v in CODE_COLUMNS.items()}, spark)


def q43_slot_names(spark, sf):
    # Slot names are metadata written by the stages fitted on the data.
    return E.slot_table(_features(spark, sf), "features")


def q44_forest_importance(spark, sf):
    train, _ = _model_frames(spark, sf)
    model = TU.estimator("forest", train).fit(train)
    imp = R.feature_importance(model, train, "features", k=L.TOP_K)
    return imp.select("rank", "idx", "name",
                      F.round("importance", 6).alias("importance"))


def q44b_tree_importance(spark, sf):
    """Importances of a forest of one tree of depth 2 on all rows and
    features, where SQL can search the splits."""
    t = _tree_input(spark, sf)
    model = TR.forest(LABEL, "x", max_bins=32, maxDepth=2, numTrees=1,
                      bootstrap=False, featureSubsetStrategy="all").fit(t)
    imp = R.feature_importance(model, t, "x", k=L.TOP_K)
    return imp.select("rank", "idx", "name",
                      F.round("importance", 6).alias("importance"))


def q45_label_correlation(spark, sf):
    f = _features(spark, sf)
    c = R.label_correlation(f, "features", LABEL)
    return c.select("idx", "name", F.round("corr", 6).alias("corr"))


def q45b_correlation_matrix_row(spark, sf):
    f = E.assemble(_features(spark, sf).drop("features"),
                   P.FEATURE_COLS + [LABEL], "features_with_target")
    target = len(E.slot_names(f, "features_with_target")) - 1
    return R.correlation_row(f, "features_with_target", target).select(
        "idx", "name", F.round("corr", 6).alias("corr"))


def q46_corr_ranked(spark, sf):
    f = _features(spark, sf)
    c = R.label_correlation(f, "features", LABEL)
    return R.rank_by_abs(c, k=L.TOP_K).select(
        "rank", "idx", "name", F.round("corr", 6).alias("corr"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items())
    if name.startswith("q") and name[1:3].isdigit() and callable(fn)
}
