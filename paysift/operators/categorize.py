"""Category bucketing: keep-lists, first-match ladders, the location
router, the degree flag, and data-driven top-k-or-other.

The original used opaque row-at-a-time UDFs; here each rule is a native
expression (CASE WHEN over hash-set lookups), so it runs inside whole-stage
codegen and filters on the new columns still push down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.functions import lookups as L
from paysift.functions.exprs import (col_of, degree_flag, keep_or_other,
                                     ladder, location_region)


def keep_list(df: DataFrame, c: str, keep: Sequence[str], out: str,
              other: str = L.OTHER) -> DataFrame:
    """``out`` = value if listed, else ``other`` (null included)."""
    return df.withColumn(out, keep_or_other(c, keep, other))


def map_ladder(df: DataFrame, c: str,
               arms: Sequence[tuple[str, Sequence[str]]], out: str,
               default: str = L.OTHER) -> DataFrame:
    """``out`` = bucket of the first arm listing the value, else default."""
    return df.withColumn(out, ladder(c, arms, default))


def route_location(df: DataFrame, c: str, out: str, **lists) -> DataFrame:
    """``out`` = US region for "City, ST", country group for
    "City, Region, Country" (see ``exprs.location_region``)."""
    return df.withColumn(out, location_region(c, **lists))


def regex_flag(df: DataFrame, c: str, out: str,
               words: Sequence[str] = L.DEGREES) -> DataFrame:
    """``out`` = value matches any word (unanchored regex, case-sensitive)."""
    return df.withColumn(out, degree_flag(c, words))


def top_k_values(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent non-null values of ``c`` (ties: smaller value).

    Partial counts per partition, one shuffle of (value, count), then a
    top-k that keeps k rows per partition: bounded by k end to end.
    """
    counts = (df.where(col_of(c).isNotNull()).groupBy(col_of(c).alias("key"))
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.col("n").desc(), F.col("key")).limit(k)


def top_k_or_other(df: DataFrame, c: str, k: int, out: str,
                   other: str = L.OTHER) -> DataFrame:
    """Keep the k most frequent values, the rest (and null) -> ``other``.

    The data-driven form of a typed-in keep-list.  Rows are read once for
    the counts and once for the join; Spark joins the top-k table by its
    measured size (broadcast when small, else a shuffle join whose hot
    partitions AQE splits - nulls have a partition like any value).
    """
    top = top_k_values(df, c, k).select(F.col("key").alias("__key"),
                                        F.lit(True).alias("__keep"))
    joined = df.join(top, col_of(c) == F.col("__key"), "left")
    return joined.withColumn(
        out, F.when(F.col("__keep"), col_of(c)).otherwise(F.lit(other))
    ).drop("__key", "__keep")


def top_k_bucket_counts(counts: DataFrame, value: str, n: str, k: int,
                        out: str, other: str = L.OTHER) -> DataFrame:
    """(out, n) of ``top_k_or_other`` from counts per value already at hand:
    no further pass over the data."""
    top = counts.where(col_of(value).isNotNull()) \
        .orderBy(col_of(n).desc(), col_of(value)).limit(k)
    return counts.join(top.select(col_of(value).alias("__key")),
                       col_of(value) == F.col("__key"), "left") \
        .groupBy(F.coalesce("__key", F.lit(other)).alias(out)) \
        .agg(F.sum(n).alias("n"))
