"""Profiling operators: counts, null profiles, value counts, distinct counts,
summaries and histograms.

Each profile is ONE aggregation pass over the data, however many columns it
covers (the original ran one job per column and per step).  Wide results
are unpivoted to long form (one row per column) so they join, filter and
print like any other table.  Nothing is collected but a handful of scalars.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.exprs import col_of, safe_double
from paysift.session import materialize


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else list(df.columns)


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a lazy one-row frame (n bigint)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None,
            cols: Sequence[str] | None = None) -> DataFrame:
    """First n rows, ordered by a key so the rows are defined.

    Plans as a top-k (``TakeOrderedAndProject``): each partition keeps n
    rows, so no full sort or shuffle of the input happens.
    """
    out = df.select(*[col_of(c) for c in cols]) if cols else df
    if order_by:
        out = out.orderBy(*[col_of(c) for c in order_by])
    return out.limit(n)


def _long(one_row: DataFrame, cols: Sequence[str], value_name: str,
          ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot per-column aggregate columns ``c`` into (column_name, value)."""
    return one_row.unpivot(list(ids), [col_of(c) for c in cols],
                           "column_name", value_name)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column in one pass: (column_name, n_null, n_rows)."""
    cols = _cols(df, cols)
    agg = df.agg(F.count(F.lit(1)).alias("__n_rows"),
                 *[F.count_if(col_of(c).isNull()).alias(c) for c in cols])
    return _long(agg, cols, "n_null", ids=["__n_rows"]).select(
        "column_name", "n_null", F.col("__n_rows").alias("n_rows"))


def schema_profile(df: DataFrame, cols: Sequence[str] | None = None
                   ) -> DataFrame:
    """Schema rows with data: (pos, column_name, type, n_non_null).

    The printable schema of the original, joined with a non-null count per
    column computed in the same single pass as ``null_profile``.
    """
    cols = _cols(df, cols)
    fields = {f.name: f for f in df.schema.fields}
    pos = F.create_map(*[x for i, c in enumerate(cols)
                         for x in (F.lit(c), F.lit(i))])
    typ = F.create_map(*[x for c in cols for x in
                         (F.lit(c), F.lit(fields[c].dataType.simpleString()))])
    prof = null_profile(df, cols)
    return prof.select(
        pos[F.col("column_name")].alias("pos"),
        "column_name",
        typ[F.col("column_name")].alias("type"),
        (F.col("n_rows") - F.col("n_null")).alias("n_non_null"))


def null_rate_by_bucket(df: DataFrame, key: str, buckets: int = 20,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """Null mask overview: rows grouped into ``buckets`` equal ranges of an
    integer key, null count per column per range.

    (bucket, column_name, n_null, n) - the data behind a null heatmap, at
    most buckets × columns rows whatever the table size.  One small
    aggregate finds the key range (two scalars reach the driver); one
    grouped aggregate counts, with partial counts before the shuffle.
    """
    cols = [c for c in _cols(df, cols) if c != key]
    lo, hi = df.agg(F.min(col_of(key)), F.max(col_of(key))).first()
    if lo is None:
        lo, hi = 0, 0
    # decimals: a 64-bit key times the bucket count does not fit a long
    offset = col_of(key).cast("decimal(20,0)") - F.lit(lo).cast(
        "decimal(20,0)")
    bucket = F.expr(f"(__offset * {int(buckets)}) div {hi - lo + 1}BD")
    agg = (df.withColumn("__offset", offset).groupBy(bucket.alias("bucket"))
           .agg(F.count(F.lit(1)).alias("n"),
                *[F.count_if(col_of(c).isNull()).alias(c) for c in cols]))
    return _long(agg, cols, "n_null", ids=["bucket", "n"]).select(
        "bucket", "column_name", "n_null", "n")


def value_counts(df: DataFrame, cols: Sequence[str] | str,
                 order: bool = True) -> DataFrame:
    """Value counts of one or more columns: (column_name, value, n).

    ``n`` is ``count(value)``, so the null group is listed with 0, as in the
    original.  Several columns are stacked into (column_name, value) pairs
    and counted by one grouped aggregate: one scan, one shuffle of partial
    counts.  Sorted by count descending, then value.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    pairs = df.select(F.stack(F.lit(len(cols)), *[
        x for c in cols for x in (F.lit(c), col_of(c).cast("string"))]
    ).alias("column_name", "value"))
    out = pairs.groupBy("column_name", "value").agg(
        F.count("value").alias("n"))
    if order:
        out = out.orderBy("column_name", F.col("n").desc(),
                          F.col("value").asc_nulls_last())
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str],
                    approx_rsd: float | None = None) -> DataFrame:
    """Distinct counts per column, without and with null:
    (column_name, n_distinct, n_distinct_with_null).

    Exact by default: stack + distinct (column, value) + group by column;
    the distinct step is a partial-aggregated shuffle, avoiding the
    per-column row copies of the multi-``countDistinct`` Expand plan.  With
    ``approx_rsd`` every column gets a HyperLogLog++ sketch in one pass
    (fixed memory per column, no shuffle of values) for very wide or
    very high-cardinality tables.
    """
    cols = list(cols)
    if approx_rsd is not None:
        agg = df.agg(*[F.struct(
            F.approx_count_distinct(col_of(c), approx_rsd).alias("d"),
            F.max(col_of(c).isNull().cast("int")).alias("z")).alias(c)
            for c in cols])
        return _long(agg, cols, "s").select(
            "column_name", F.col("s.d").alias("n_distinct"),
            (F.col("s.d") + F.col("s.z")).cast("bigint")
            .alias("n_distinct_with_null"))
    pairs = df.select(F.stack(F.lit(len(cols)), *[
        x for c in cols for x in (F.lit(c), col_of(c).cast("string"))]
    ).alias("column_name", "value"))
    return (pairs.distinct()
            .groupBy("column_name")
            .agg(F.count("value").alias("n_distinct"),
                 F.count(F.lit(1)).alias("n_distinct_with_null")))


def distinct_sketches(df: DataFrame, cols: Sequence[str],
                      by: Sequence[Column | str], lg_k: int = 12
                      ) -> DataFrame:
    """(by..., column_name, sketch): a mergeable distinct-count sketch of
    every column for each group, e.g. a day, in one stacked aggregate.

    Sketches have a fixed size, so a table's history is kept as one small
    row a day and column, and ``union_sketches`` answers any range of days
    without reading the rows again.  Null values do not count."""
    cols = list(cols)
    pairs = df.select(*by, F.stack(F.lit(len(cols)), *[
        x for c in cols for x in (F.lit(c), col_of(c).cast("string"))]
    ).alias("column_name", "value"))
    names = [c for c in pairs.columns if c not in ("column_name", "value")]
    return pairs.groupBy(*names, "column_name").agg(
        F.hll_sketch_agg("value", F.lit(lg_k)).alias("sketch"))


def union_sketches(sketches: DataFrame) -> DataFrame:
    """(column_name, n_distinct): the estimate of all given sketches
    together.  With 2**lg_k registers its relative standard error is about
    1.04 / sqrt(2**lg_k): 1.6 % at the default.  The union is merged with
    itself, so that the registers alone decide the estimate, not the order
    in which values and sketches came."""
    union = sketches.groupBy("column_name").agg(
        F.hll_union_agg("sketch").alias("u"))
    return union.select("column_name", F.hll_sketch_estimate(
        F.hll_union("u", "u")).alias("n_distinct"))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None
                  ) -> DataFrame:
    """Number of distinct rows over ``cols`` (null counts as a value)."""
    sub = df.select(*[col_of(c) for c in cols]) if cols else df
    return sub.distinct().agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample stddev, min, max per column after a safe cast to
    double: (column_name, n, mean, stddev, min_value, max_value).

    Unlike ``describe()`` the statistics are numbers, min/max are numeric
    rather than lexical, and NaN is treated as missing.
    """
    cols = list(cols)

    def stats(c: str) -> Column:
        x = safe_double(c)
        x = F.when(~F.isnan(x), x)
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"),
                        F.stddev_samp(x).alias("stddev"),
                        F.min(x).alias("min_value"),
                        F.max(x).alias("max_value")).alias(c)

    agg = df.agg(*[stats(c) for c in cols])
    return _long(agg, cols, "s").select(
        "column_name", "s.n", "s.mean", "s.stddev", "s.min_value",
        "s.max_value")


def histogram(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram with density: (bin, lo, hi, n, density).

    One pass for min/max (two scalars reach the driver), one grouped pass
    for the counts.  The top edge is closed (max falls in the last bin);
    density = n / (N · width) integrates to 1.  Empty bins are omitted.
    """
    x = safe_double(c)
    b = df.select(x.alias("x")).where(F.col("x").isNotNull() &
                                      ~F.isnan("x"))
    lo, hi, total = b.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if total == 0:
        return b.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"),
                        F.lit(0.0).alias("hi"), F.lit(0).cast("bigint")
                        .alias("n"), F.lit(0.0).alias("density")).limit(0)
    width = (hi - lo) / bins
    if width == 0:
        idx = F.lit(0)
    else:
        idx = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width))
                      .cast("int"), F.lit(bins - 1))
    counts = b.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lo_e = F.lit(lo) + F.col("bin") * F.lit(width)
    return counts.select(
        "bin", lo_e.alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n",
        F.try_divide(F.col("n").cast("double"),
                     F.lit(float(total)) * F.lit(width)).alias("density"))


def quantiles(df: DataFrame, c: str,
              probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles of a column: (prob, value), the smallest value whose
    rank reaches ``prob`` times the number of values.

    Values are counted (partial counts before the shuffle), the distinct
    ones range-partitioned, and the totals per partition - one number each -
    tell which partitions hold the wanted ranks; only those are ranked.  No
    task sees more than its own range of values.
    """
    x = safe_double(c)
    counts = df.select(x.alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")) \
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, "value")
                         .withColumn("part", F.spark_partition_id()))
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(
        F.sum("n").alias("n")).collect())
    total = sum(n for _, n in totals)
    wanted = []
    for p in probs if total else ():
        rank, before = max(math.ceil(p * total), 1), 0
        for part, n in totals:
            if rank <= before + n:
                wanted.append((float(p), part, rank - before))
                break
            before += n
    asked = df.sparkSession.createDataFrame(
        wanted, "prob double, part int, rank long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ranked = ranged.where(F.col("part").isin([w[1] for w in wanted])) \
        .withColumn("upto", upto)
    return ranked.join(asked, "part").where(
        (F.col("rank") <= F.col("upto"))
        & (F.col("rank") > F.col("upto") - F.col("n"))) \
        .select("prob", "value")
