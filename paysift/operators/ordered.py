"""Running totals over ordered rows, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.session import shared_path


def _plus(a: Column, b: Column) -> Column:
    return a + b


def running(rows: DataFrame, by: Sequence[str], order: Sequence,
            totals: Mapping[str, Column],
            agg: Callable[[Column], Column] = F.sum,
            combine: Callable[[Column, Column], Column] = _plus
            ) -> DataFrame:
    """``rows`` and, for each name of ``totals``, ``agg`` of its expression
    over the rows before in the same group ``by`` (0 for the first).

    Rows are range-partitioned by group and order (and by their place in the
    input, so that equal rows split too) and written with their place; every
    partition totals its own rows, and one row per partition and group carries
    the totals of the partitions before.  The columns ``by`` must not be
    null; groups may be as large as the table.  ``combine`` joins two totals.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    place = [*[F.col(c) for c in by], *order, F.col("__place")]
    path = shared_path(spark, "running")
    placed = rows.withColumn("__place", F.monotonically_increasing_id()) \
        .repartitionByRange(parts, *place).sortWithinPartitions(*place) \
        .drop("__place").withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path) \
        .withColumn("__part", F.shiftright("__at", 33))
    keys = ["__part", *by]
    before = Window.partitionBy(*by).orderBy("__part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy("__at") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(*[
        agg(x).alias(f"__{n}") for n, x in totals.items()])
    sums = sums.select(*keys, *[
        F.coalesce(agg(F.col(f"__{n}")).over(before), F.lit(0))
        .alias(f"__{n}") for n in totals])
    own = {n: F.coalesce(agg(x).over(inside), F.lit(0))
           for n, x in totals.items()}
    out = rows.withColumns(own).join(sums, keys)
    return out.withColumns({n: combine(F.col(f"__{n}"), F.col(n))
                            for n in totals}) \
        .drop("__at", "__part", *[f"__{n}" for n in totals])
