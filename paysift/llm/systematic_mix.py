"""Mixing sources to target weights by systematic sampling.

DataFrame functions only.  Sources weigh 1, 2, 3, repeating, in code-point
order (null last) and share 100 % of all sizes; a target stops at ``cap``
times its source's size and the excess is reshared by weight.

Within a source the rows are ordered by (size, key) and every row expects
``target / source_size`` copies.  The running sum of expected copies, moved
by one pseudo-random offset per source, is cut at whole numbers: a row is
emitted once per boundary it crosses.  Ordering by size spreads the copies
evenly over short and long rows, so the words taken come near the target.

The running sum over a hot source is never held by one task.  The keys' range
is cut into as many equal cells as the square root of the rows; rows are
counted per (source, size, cell) with map-side aggregation; cells get their
offsets from running sums over the distinct sizes of a source and over the
cells of one (source, size); rows are ranked within a cell only.  So whether
keys are dense or spread over 64 bits, neither a cell nor the cells of one
source and size exceed about the square root of the rows.

Defined cases: null or empty text has size 0 and is taken with 0 words; a
null source is a source of its own, last in order; a null key sorts first;
rows with equal key are ranked one after the other; an empty table gives an
empty result; extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def key_cell(rows: DataFrame, key: str) -> Column:
    """The cell of a key: equal parts of the keys' range, in key order; null
    keys have the first cell."""
    x = F.col(key).cast("long")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(x), F.max(x)).first()
    if low is None:
        return F.lit(-1).cast("long")
    cells, low = math.ceil(math.sqrt(n)), float(low)
    part = (x.cast("double") - low) / (float(high) - low + 1.0) * cells
    return F.coalesce(F.floor(part), F.lit(-1)).cast("long")


def source_targets(rows: DataFrame, source: str, size: str,
                   n_weights: int = 3, cap: int = 3) -> DataFrame:
    """One row per source: __none, __src, source_size, target."""
    src = rows.groupBy(F.col(source).isNull().alias("__none"),
                       F.coalesce(F.col(source), F.lit("")).alias("__src")) \
        .agg(F.sum(size).alias("source_size"))
    named = Window.orderBy("__none", "__src")
    src = src.withColumn(
        "__w", 1 + (F.row_number().over(named) - 1) % n_weights)
    order = Window.orderBy(F.col("source_size") / F.col("__w"),
                           "__none", "__src")
    whole = order.rowsBetween(Window.unboundedPreceding,
                              Window.unboundedFollowing)
    before = F.coalesce(F.sum("source_size").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__w").over(
        order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole)
    src = src.withColumn("__level", (total - cap * before).cast("double")
                         / rest.cast("double"))
    full = (cap * F.col("source_size")).cast("double") \
        <= F.col("__w").cast("double") * F.col("__level")
    src = src.withColumn("__full", full)
    level = F.first(F.when(~F.col("__full"), F.col("__level")),
                    ignorenulls=True).over(whole)
    return src.withColumn("__final", level).select(
        "__none", "__src", "source_size",
        F.when(F.col("__full"), (cap * F.col("source_size")).cast("double"))
        .otherwise(F.col("__w").cast("double") * F.col("__final"))
        .alias("target"))


def offset_of(seed: str):
    """The random offset of a source, from the md5 of seed and name."""
    name = F.concat(F.lit(seed), F.when(F.col("__none"), F.lit("?"))
                    .otherwise(F.concat(F.lit("="), F.col("__src"))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") \
        / F.lit(4294967296.0)


def mix_sources(rows: DataFrame, source: str = "source", size: str = "size",
                key: str = "doc_id", n_weights: int = 3, cap: int = 3,
                seed: str = "mix") -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` (how often
    the mix takes the row, 0 to ``cap``).  Columns of these names are
    replaced."""
    keep = [c for c in rows.columns
            if c not in ("source_size", "target", "copies")]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep])
    rows = rows.withColumns({
        "__none": F.col(source).isNull(),
        "__src": F.coalesce(F.col(source), F.lit("")),
        "__size": F.coalesce(F.col(size), F.lit(0)).cast("long"),
        "__block": key_cell(rows, key),
    })
    cell = ["__none", "__src", "__size", "__block"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    same_size = ["__none", "__src", "__size"]
    sizes = cells.groupBy(*same_size).agg(F.sum("__n").alias("__m"))
    by_size = Window.partitionBy("__none", "__src").orderBy("__size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*same_size, F.coalesce(
        F.sum("__m").over(by_size), F.lit(0)).alias("__before_size"))
    by_block = Window.partitionBy(*same_size).orderBy("__block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(
        F.sum("__n").over(by_block), F.lit(0)).alias("__before_block"))
    targets = source_targets(rows, source, "__size", n_weights, cap)
    cells = cells.join(sizes, same_size).join(targets, ["__none", "__src"]) \
        .select(*cell, "source_size", "target",
                (F.col("__before_size") + F.col("__before_block"))
                .alias("__before"), offset_of(seed).alias("__u"))
    ranked = rows.withColumn("__r", F.row_number().over(
        Window.partitionBy(*cell).orderBy(key)))
    out = ranked.join(cells, cell)
    rank = (F.col("__before") + F.col("__r")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target")
                  / F.col("source_size").cast("double")).otherwise(0.0)
    out = out.withColumn("__each", each)
    copies = F.floor(F.col("__u") + F.col("__each") * rank) \
        - F.floor(F.col("__u") + F.col("__each") * (rank - 1))
    return out.withColumn("copies", copies.cast("long")) \
        .select(*[F.col(f"`{c}`") for c in keep],
                "source_size", "target", "copies")
