"""Feature ranking: importances and Pearson correlation with the label,
named by slot and ranked.

The ranked tables have one row per feature slot (p rows, p = vector width),
so their ranking windows run on a bounded table; nothing proportional to
the data reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.exprs import col_of
from paysift.operators.encode import slot_table
from paysift.operators.moments import slot_correlations


def _rank(df: DataFrame, value: str, k: int | None, by_abs: bool) -> DataFrame:
    key = F.abs(F.col(value)) if by_abs else F.col(value)
    # p rows only: a single ordered window is fine here.
    w = Window.orderBy(key.desc_nulls_last(), F.col("idx"))
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k is not None else out


def feature_importance(model, features_df: DataFrame, vec: str = "features",
                       k: int | None = 10) -> DataFrame:
    """(rank, idx, name, importance) of a tree ensemble, top ``k``.

    Importances (p numbers, summing to 1) are joined to the slot names by
    index, then ranked: descending, lower index first on ties.
    """
    spark = features_df.sparkSession
    imp = model.featureImportances.toArray().tolist()
    imps = spark.createDataFrame(list(enumerate(map(float, imp))),
                                 "idx int, importance double")
    named = imps.join(slot_table(features_df, vec), "idx", "left")
    return _rank(named, "importance", k, by_abs=False).select(
        "rank", "idx", "name", "importance")


def _named(corr: DataFrame, df: DataFrame, vec: str) -> DataFrame:
    return slot_table(df, vec).join(
        corr, F.col("idx") == F.col("slot"), "left").select(
        "idx", "name", "corr")


def label_correlation(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(idx, name, corr) of each slot with the label, in ONE aggregate;
    undefined ones (a constant slot) are null.

    Only the label's row of the correlation matrix is needed, so p
    correlations are computed (not p²) from the vectors' stored entries.
    """
    return _named(slot_correlations(df, vec, col_of(label)), df, vec)


def correlation_row(df: DataFrame, vec: str, target: int) -> DataFrame:
    """(idx, name, corr) of one slot with every other slot: one row of the
    Pearson matrix, of which no more is computed; undefined entries (a
    constant slot) are null.  Any width: at most one row a slot is shuffled
    (``moments.slot_correlations``).
    """
    return _named(slot_correlations(df, vec, target), df, vec) \
        .filter(F.col("idx") != target)


def rank_by_abs(corr: DataFrame, k: int | None = 10,
                exclude: str | None = None) -> DataFrame:
    """(rank, idx, name, corr) by |corr| descending, lower index on ties,
    undefined last; ``exclude`` drops one name (the label itself)."""
    c = corr if exclude is None else corr.where(F.col("name") != exclude)
    return _rank(c, "corr", k, by_abs=True).select("rank", "idx", "name",
                                                   "corr")
