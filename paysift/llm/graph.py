"""Connected components of a link table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.stash import pin

#: Links of a round in one task and file, where there are many.
TASK_LINKS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), for every node of a
    link between different nodes.

    Alternating large-star and small-star rounds: every node hands its larger
    neighbours, then all its neighbours, to the smallest one.  Minima are
    aggregated map-side and joined back, so a hub is never one task's group;
    each round is checkpointed, in as many files as its links need or the
    cluster has cores.  Links with a null end are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = pin(links.select(F.greatest(x, y).alias("u"),
                         F.least(x, y).alias("v"))
            .filter(x.isNotNull() & y.isNotNull()).filter("u > v")
            .distinct())
    cores = e.sparkSession.sparkContext.defaultParallelism
    n, last = e.count(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"),
                                F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u"))
                                    .alias("m"))
        large = both.filter("v > u").join(low, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v"))
        e = pin(small.distinct()
                .coalesce(max(cores, math.ceil(n / TASK_LINKS))))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.expr(
            "cast(xxhash64(u, v) as decimal(38, 0))"))).first())
        if now == last:
            break
        n, last = now[0], now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(e.select(F.col("v").alias("node"),
                        F.col("v").alias("component")).distinct())
