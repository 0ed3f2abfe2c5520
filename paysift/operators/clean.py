"""Cleaning operators: drops, required columns, caps, safe casts and
missing-value repair (constant, mode, mean)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.functions.exprs import col_of, safe_double
from paysift.operators.profile import value_counts


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop by name; names that do not exist are ignored."""
    return df.drop(*names)


def empty_columns(df: DataFrame, cols: Sequence[str] | None = None
                  ) -> list[str]:
    """Columns holding no non-null value, found in ONE aggregation pass
    (one counter per column reaches the driver)."""
    cols = list(cols) if cols is not None else list(df.columns)
    row = df.agg(*[F.count(col_of(c)).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame, cols: Sequence[str] | None = None
                       ) -> DataFrame:
    """Drop every all-null column (the original typed a list of ten)."""
    return df.drop(*empty_columns(df, cols))


def require(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Keep rows where every listed column is non-null."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    cond = None
    for c in cols:
        t = col_of(c).isNotNull()
        cond = t if cond is None else cond & t
    return df.where(cond)


def cap(df: DataFrame, c: str, upper: float) -> DataFrame:
    """Keep rows whose value, read as a number, is strictly below ``upper``.

    Null and malformed values are removed (they fail the comparison).
    """
    return df.where(safe_double(c) < F.lit(upper))


def cast_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Safe cast of many columns in one projection (bad strings -> null)."""
    return df.withColumns({c: safe_double(c) for c in cols})


def cast_all_double_except(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Cast every column not excluded; excluded (e.g. indexed) columns keep
    their ML metadata, which a cast would erase."""
    ex = set(exclude)
    return cast_double(df, [c for c in df.columns if c not in ex])


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls with per-column constants; columns whose type does not
    take the constant (a text for a number, say) are left alone, and so are
    names that do not exist."""
    def takes(kind: T.DataType, value: object) -> bool:
        if isinstance(value, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(value, str):
            return isinstance(kind, T.StringType)
        if isinstance(value, int):
            return isinstance(kind, T.NumericType)
        return isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
    fits = {c: v for c, v in values.items()
            if c in df.columns and takes(df.schema[c].dataType, v)}
    return df.na.fill(fits) if fits else df


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, ties to the smallest value.

    One stacked value count for all columns (partial aggregation before the
    shuffle), then the top row per column: only ``len(cols)`` values reach
    the driver, whatever the cardinality.
    """
    counts = value_counts(df, list(cols), order=False).where(
        F.col("value").isNotNull())
    # min_by over (-n, value) is a bounded-memory aggregate: no task ever
    # holds all distinct values of a column, as a ranking window would.
    top = counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value")))
        .alias("value"))
    found = {r["column_name"]: r["value"] for r in top.collect()}
    return {c: found.get(c) for c in cols}


def fill_mode(df: DataFrame, cols: Sequence[str],
              fit_df: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Fill nulls with each column's mode, learned on ``fit_df`` (default
    ``df``).  Returns the filled frame and the learned values."""
    learned = modes(fit_df if fit_df is not None else df, cols)
    values = {c: v for c, v in learned.items() if v is not None}
    return (fill_constants(df, values) if values else df), learned


def impute_mean(df: DataFrame, cols: Sequence[str], suffix: str = "_imputed",
                fit_df: DataFrame | None = None, drop_input: bool = True
                ) -> tuple[DataFrame, ImputerModel]:
    """Mean imputation with ``pyspark.ml.feature.Imputer``.

    Inputs are safely cast to double first (malformed strings count as
    missing); null and NaN are missing; the mean is learned on ``fit_df``
    (default ``df``) in one aggregation and applied as a projection.
    Output columns are ``<c><suffix>``; inputs are dropped by default.
    """
    cols = list(cols)
    casted = cast_double(df, cols)
    fit_on = cast_double(fit_df, cols) if fit_df is not None else casted
    imputer = Imputer(strategy="mean", inputCols=cols,
                      outputCols=[f"{c}{suffix}" for c in cols])
    model = imputer.fit(fit_on)
    out = model.transform(casted)
    return (out.drop(*cols) if drop_input else out), model
