"""The survey table's feature plan: clean -> categorize -> encode.

Each step is a function ``DataFrame -> DataFrame`` built from the operators;
learned values (mode, mean, category indexes) come from ``fit_filter`` rows
when one is given (e.g. the training part), else from all rows, which is
what the original analysis did.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions import lookups as L
from paysift.functions.exprs import (degree_flag, keep_or_other, ladder,
                                     location_region, safe_double)
from paysift.operators import clean as C
from paysift.operators import encode as E
from paysift.session import materialize

LABEL = "total_comp"
KEY = "rec_id"
NUMERIC = ["years_exp", "years_at", LABEL]
SKILL = "skill_index"
SKILL_OUT = "skill_index_imputed"

# Indexed columns (frequency ascending) and their outputs.
INDEX_IN = ["cat_comp", "cat_title", "gender", "cat_location", "cat_tag",
            "std_level"]
INDEX_OUT = [f"{c}_idx" for c in INDEX_IN]
# One-hot encoded subset.
ONEHOT_IN = ["cat_title_idx", "gender_idx", "cat_location_idx",
             "std_level_idx"]
ONEHOT_OUT = ["cat_title_vec", "gender_vec", "cat_location_vec",
              "std_level_vec"]
# FIXED VALUES: assembly order of the original feature vector.
FEATURE_COLS = ["cat_location_vec", "masters", "cat_comp_idx", "years_exp",
                "years_at", "cat_title_vec", "gender_vec", "cat_tag_idx",
                SKILL_OUT, "std_level_vec"]
# The linear family's own vector: every index one-hot with its most frequent
# level dropped, so that the columns are independent of the intercept.
LINEAR_FEATURES = "features_linear"
LINEAR_VEC = {o: o.removesuffix("_idx") + "_contrast" for o in INDEX_OUT}


@dataclass
class Lookups:
    """Bucketing lists; the defaults fit the adapter view."""
    company_keep: list = field(default_factory=lambda: list(
        L.ADAPTER_COMPANY_KEEP))
    title_ladder: list = field(default_factory=lambda: list(
        L.ADAPTER_TITLE_LADDER))
    tag_keep: list = field(default_factory=lambda: list(L.ADAPTER_TAG_KEEP))
    degrees: list = field(default_factory=lambda: list(L.DEGREES))


ORIGINAL_LOOKUPS = Lookups(company_keep=list(L.COMPANY_KEEP),
                           title_ladder=list(L.TITLE_LADDER),
                           tag_keep=list(L.TAG_KEEP),
                           degrees=list(L.DEGREES))


# Columns known to be empty in the source (the original listed ten by
# name); ``clean.drop_empty_columns`` finds such columns by data instead.
EMPTY_COLUMNS = ["_c16", "_c17"]


@dataclass
class Learned:
    """Everything cleaning and indexing learn from the data: the level's
    mode, the skill mean and the frequency-ordered labels of each indexed
    column (rarest first, ties alphabetical)."""
    modes: dict = field(default_factory=dict)
    skill_mean: float | None = None
    labels: dict = field(default_factory=dict)

    def indexers(self, handle_invalid: str = "error"
                 ) -> list[StringIndexerModel]:
        """One fitted-equivalent StringIndexerModel per indexed column
        (single-column models: the multi-column constructor pads shorter
        label lists with nulls)."""
        return [StringIndexerModel.from_labels(
            self.labels[c], inputCol=c, outputCol=o,
            handleInvalid=handle_invalid) for c, o in zip(INDEX_IN, INDEX_OUT)]


def _category_exprs(lk: Lookups) -> dict[str, Column]:
    """Indexed columns as they look after cleaning and bucketing, written
    against the raw columns (std_level before its mode fill)."""
    return {
        "cat_comp": keep_or_other("company", lk.company_keep),
        "cat_title": ladder("title", lk.title_ladder),
        "gender": F.coalesce(F.col("gender"), F.lit(L.GENDER_FILL)),
        "cat_location": location_region("location"),
        "cat_tag": keep_or_other("tag", lk.tag_keep),
        "std_level": F.col("std_level"),
    }


def learning_counts(df: DataFrame, fit_filter: Column | None = None,
                    lookups: Lookups | None = None) -> DataFrame:
    """The single aggregate behind ``learn``: per (column, value) of the
    indexed columns, rows among labelled rows (``n_all``), rows that
    survive the cap (``n_kept``), and the skill sum and count (carried by
    the first stacked column only, so each row counts once)."""
    lk = lookups or Lookups()
    d = C.require(df, LABEL)
    if fit_filter is not None:
        d = d.where(fit_filter)
    kept = F.coalesce(safe_double(LABEL) < F.lit(L.LABEL_CAP), F.lit(False))
    x = safe_double(SKILL)
    x = F.when(~F.isnan(x), x)
    exprs = _category_exprs(lk)
    stack_args = []
    for i, (name, e) in enumerate(exprs.items()):
        stack_args += [F.lit(name), e.cast("string"),
                       x if i == 0 else F.lit(None).cast("double")]
    pairs = d.select(kept.alias("kept"), F.stack(
        F.lit(len(exprs)), *stack_args).alias("column_name", "value", "x"))
    return pairs.groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("kept")).alias("n_kept"),
        F.sum("x").alias("sx"), F.count("x").alias("nx"))


def label_counts(df: DataFrame, fit_filter: Column | None = None,
                 lookups: Lookups | None = None
                 ) -> tuple[str | None, float | None, DataFrame]:
    """The level's mode, the skill mean, and (column_name, value, n) of the
    indexed columns after cleaning, from the one learning aggregate (written
    once).  The level's null count is added to its mode, exactly as filling
    before indexing would."""
    counts = materialize(learning_counts(df, fit_filter, lookups))
    level = (F.col("column_name") == "std_level") & \
        F.col("value").isNotNull()
    first = F.col("column_name") == INDEX_IN[0]
    mode, sx, nx = counts.agg(
        F.min_by(F.when(level, F.col("value")), F.when(
            level, F.struct(-F.col("n_all"), F.col("value")))),
        F.sum(F.when(first, F.col("sx"))),
        F.sum(F.when(first, F.col("nx")))).first()
    value = F.coalesce("value", F.when(
        F.col("column_name") == "std_level", F.lit(mode)))
    kept = counts.groupBy("column_name", value.alias("value")).agg(
        F.sum("n_kept").alias("n")).where(
            (F.col("n") > 0) & F.col("value").isNotNull())
    return mode, (sx / nx) if nx else None, kept


def learn(df: DataFrame, fit_filter: Column | None = None,
          lookups: Lookups | None = None) -> Learned:
    """Learn mode, mean and category labels in ONE aggregation pass.

    The original fits three things one after another (mode of the level on
    labelled rows, mean of skill on labelled rows, indexers on the capped
    rows), each a full pass.  Here every labelled row is stacked into
    (column, value) pairs, tagged with whether it survives the cap, and
    counted once; the skill sum and count ride on the first stacked pair.
    Mode and mean are aggregates over the counts, and the driver receives
    what it must hold anyway: the label lists of the indexers, which are the
    slots of the feature vector.  ``encode.frequency_index`` numbers values
    that are not one-hot encoded on the cluster.
    """
    mode, mean, kept = label_counts(df, fit_filter, lookups)
    labels: dict = {c: [] for c in INDEX_IN}
    for r in kept.orderBy("column_name", "n", "value").collect():
        labels[r.column_name].append(r.value)
    return Learned(modes={"std_level": mode}, skill_mean=mean,
                   labels=labels)


def clean(df: DataFrame, fit_filter: Column | None = None,
          learned: Learned | None = None, lookups: Lookups | None = None
          ) -> tuple[DataFrame, Learned]:
    """Original cleaning order: drop empty columns, require the label, fill
    the level with its mode, impute skill with its mean (null and NaN are
    missing, malformed strings too), fill gender and details with
    constants, cap the label, cast numbers.  One lazy projection/filter
    chain over values learned in one pass (``learn``)."""
    learned = learned or learn(df, fit_filter, lookups)
    df = C.drop_columns(df, EMPTY_COLUMNS)
    df = C.require(df, LABEL)
    mode = learned.modes.get("std_level")
    if mode is not None:
        df = C.fill_constants(df, {"std_level": mode})
    x = safe_double(SKILL)
    df = df.withColumn(SKILL_OUT, F.when(x.isNull() | F.isnan(x), F.lit(
        learned.skill_mean).cast("double")).otherwise(x)).drop(SKILL)
    df = C.fill_constants(df, {"gender": L.GENDER_FILL,
                               "other_details": L.OTHER_DETAILS_FILL})
    df = C.cap(df, LABEL, L.LABEL_CAP)
    df = C.cast_double(df, NUMERIC)
    return df, learned


def categorize(df: DataFrame, lookups: Lookups | None = None) -> DataFrame:
    """Company keep-list, title ladder, location router, degree flag, tag
    keep-list: one projection of native expressions."""
    lk = lookups or Lookups()
    return df.withColumns({
        "cat_comp": keep_or_other("company", lk.company_keep),
        "cat_title": ladder("title", lk.title_ladder),
        "cat_location": location_region("location"),
        "masters": degree_flag("other_details", lk.degrees),
        "cat_tag": keep_or_other("tag", lk.tag_keep),
    })


def contrasts(df: DataFrame, learned: Learned) -> tuple[DataFrame, dict]:
    """One-hot of every index without its most frequent level; a category
    not seen when learning counts as that level.  Returns the frame and the
    vector of each index column (a single-level column has none)."""
    made = {}
    for c, o in zip(INDEX_IN, INDEX_OUT):
        labels = learned.labels[c]
        if len(labels) > 1:
            known = F.least(F.col(o), F.lit(float(len(labels) - 1)))
            df = df.withColumn(f"{o}_known", known).withMetadata(
                f"{o}_known", {"ml_attr": {"type": "nominal", "name": o,
                                           "vals": labels}})
            made[o] = LINEAR_VEC[o]
    df, _ = E.one_hot(df, [f"{o}_known" for o in made],
                      list(made.values()), drop_last=True)
    return df.drop(*[f"{o}_known" for o in made]), made


def encode(df: DataFrame, learned: Learned,
           handle_invalid: str = "error") -> DataFrame:
    """Index with the learned labels, one-hot, assemble: no job at all,
    sizes come from the indexers' metadata.  ``features`` is the original
    vector, ``features_linear`` the one without collinear columns."""
    for model in learned.indexers(handle_invalid):
        df = model.transform(df)
    df, _ = E.one_hot(df, ONEHOT_IN, ONEHOT_OUT)
    df, made = contrasts(df, learned)
    linear = [*made.values(), "masters", "years_exp", "years_at", SKILL_OUT]
    df = E.assemble(df, linear, LINEAR_FEATURES)
    return E.assemble(df, FEATURE_COLS, "features")


def categorized(df: DataFrame, lookups: Lookups | None = None,
                fit_filter: Column | None = None,
                learned: Learned | None = None) -> DataFrame:
    cleaned, _ = clean(df, fit_filter, learned, lookups)
    return categorize(cleaned, lookups)


def feature_frame(df: DataFrame, lookups: Lookups | None = None,
                  fit_filter: Column | None = None) -> DataFrame:
    """Full chain from the raw survey-shaped table to ``features``: one
    learning pass, then a lazy chain (unseen categories of rows outside
    the fit part get their own index instead of failing)."""
    learned = learn(df, fit_filter, lookups)
    return encode(categorized(df, lookups, fit_filter, learned), learned,
                  handle_invalid="keep" if fit_filter is not None
                  else "error")


def train_filter(train_percent: int = 70) -> Column:
    """Rows of the training part of the hash split on the record key."""
    return E.hash_part(KEY, train_percent)


def model_input(features: DataFrame) -> DataFrame:
    """The narrow frame models read: key, the two vectors, label."""
    return features.select(KEY, "features", LINEAR_FEATURES, F.col(LABEL))
