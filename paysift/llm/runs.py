"""Exact comparison of crowded runs, block against block.

A run is a set of rows that agree on the first part of a sorted key.  A
window of neighbours sees all pairs of a run of ``window + 1`` rows; a larger
run is crowded, and what the window cannot see there is compared here, every
pair whose ends are not yet joined.

No task holds a run: the rows outside the run's largest component are dealt
to blocks of ``block`` rows, those of that component to blocks of their own,
which meet only the former.  Joining links leave the tasks, pairs do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(batches: Iterator[pa.RecordBatch],
            by: list[int]) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the columns ``by``, of a stream
    sorted by them."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in by]
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0]
                        for i in by):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def crowded(rows: DataFrame, window: int) -> DataFrame:
    """The rows (run, ...) of runs with more than ``window + 1`` rows."""
    large = rows.groupBy("run").count() \
        .filter(F.col("count") > window + 1).select("run")
    return rows.join(large, "run")


def with_roots(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``root``: the component, or the id itself."""
    return rows.join(groups.select(F.col("node").alias("id"),
                                   F.col("component").alias("root")),
                     "id", "left") \
        .withColumn("root", F.coalesce("root", "id"))


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """run, i, j, own, id, root, ... of (run, id, root, ...): every row once
    for each pair of blocks (i, j), i <= j, in which its block ``own`` meets another
    or itself.  Runs that are one component already are left out."""
    size = rows.groupBy("run", "root").count().groupBy("run").agg(
        F.max(F.struct("count", "root")).alias("top"),
        F.sum("count").alias("n")).filter(F.col("top.count") < F.col("n")) \
        .select("run", F.col("top.root").alias("top"),
                F.ceil((F.col("n") - F.col("top.count")) / block)
                .cast("int").alias("few"),
                F.ceil(F.col("top.count") / block).cast("int").alias("many"))
    h = F.xxhash64("id")
    inside = F.col("root") == F.col("top")
    more = [c for c in rows.columns if c not in ("run", "id", "root")]
    return rows.join(size, "run").select(
        "run", "id", "root", *more,
        F.when(inside, F.col("few") + F.pmod(h, F.col("many")))
        .otherwise(F.pmod(h, F.col("few"))).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few"))
                             .otherwise(F.col("few") + F.col("many")) - 1))
        .alias("other")) \
        .select("run", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"), "own", "id", "root",
                *more)


def _blocks(rows: DataFrame, work: Callable, shape: str) -> DataFrame:
    by = ["run", "i", "j"]
    return rows.select(*by, "own", "id", "root", "data") \
        .repartition(*by).sortWithinPartitions(*by) \
        .mapInArrow(work, shape)


def _met(batches, prepare: Callable) -> Iterator[tuple]:
    """(group, rows of block i, ids, roots, row -> which rows are near)."""
    for t in grouped(batches, [0, 1, 2]):
        root = t.column(5).to_numpy().copy()
        if (root == root[0]).all():
            continue
        mine = np.flatnonzero(t.column(3).to_numpy()
                              == t.column(1)[0].as_py())
        near = prepare([x.as_buffer() for x in t.column(6)])
        yield t, mine.tolist(), t.column(4).to_numpy(), root, near


def suspects(rows: DataFrame, prepare: Callable) -> DataFrame:
    """run, i, j, own, id, root: the rows near a row of another root, for
    each pair of blocks where they meet it; from (run, i, j, own, id, root,
    data).  With other data in place they go to ``run_links`` as they are."""
    def work(batches):
        for t, mine, ids, root, near in _met(batches, prepare):
            found = np.zeros(len(ids), dtype=bool)
            for r in mine:
                hit = near(r) & (root != root[r])
                found |= hit
                found[r] |= hit.any()
            yield from t.select(["run", "i", "j", "own", "id", "root"]) \
                .filter(pa.array(found)).to_batches()
    return _blocks(rows, work, "run long, i int, j int, own int, id long, "
                               "root long")


def run_links(rows: DataFrame, prepare: Callable) -> DataFrame:
    """a, b: near rows of one run that join different roots; from
    (run, i, j, own, id, root, data)."""
    def work(batches):
        for _, mine, ids, root, near in _met(batches, prepare):
            a, b = [], []
            for r in mine:
                other = root != root[r]
                if not other.any():
                    break
                hit = np.flatnonzero(near(r) & other)
                reached, first = np.unique(root[hit], return_index=True)
                a += [ids[r]] * len(first)
                b += ids[hit[first]].tolist()
                root[np.isin(root, reached)] = root[r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["a", "b"])
    return _blocks(rows, work, "a long, b long").distinct()
