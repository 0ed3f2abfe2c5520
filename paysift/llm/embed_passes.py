"""Embedding near-duplicates by sorted projection passes.

Equal vectors of one label fall into one class.  In every pass a class gets a
key of concatenated one-bit random projections; classes are sorted by (pass,
label, dimension, key) and compared with their ``window`` next neighbours in
double precision.  Verified pairs of all passes are united.  Rows that agree
on the first ``deep`` bits of a key form a run; where more than the window
holds do, as in a dense region, what is not yet joined is compared block
against block.  ``deep`` follows from the largest label's size and the number
of passes from ``deep``, so that a pair at the threshold shares no run, and is
missed, with probability ``miss`` at most, however large or dense the input.

A component's direct links are counted exactly afterwards, by comparing its
members block against block; counts leave the tasks, pairs do not, so there
is no cap on a vector's partners.

Vectors are scaled to unit length once; all steps compare those by one rule.

No task holds a group: sorted rows are read as a stream with the last
``window`` rows kept, rows around partition boundaries meet in a second small
step by their places in the whole order, and members of a large component are
dealt to blocks of ``block`` rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, rows with a null label and rows with a null key link with nothing
and are kept (component: their own key); vectors of different length do not
link; equal vectors link with each other; a row that repeats a key is a
vector of its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.graph import components
from paysift.llm.runs import (crowded, dealt, grouped, run_links,
                              with_roots)
from paysift.llm.stash import pin, stash

_ROW = "label long, dim int, key long, id long, vec binary"


def vectors(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.float64) for v in column]


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs join two parts not joined by earlier pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x
    out = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out[i] = True
    return out


def units(vec: np.ndarray) -> np.ndarray:
    """Rows divided by their length; by their largest component first, so
    that squares neither overflow nor vanish."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.sqrt(np.einsum("ij,ij->i", vec, vec))[:, None]


def settle(cos: np.ndarray, x: np.ndarray, y: np.ndarray,
           least: float) -> np.ndarray:
    """Which cosines reach ``least``; ``cos`` has those of the unit vectors
    ``x`` with ``y``, row by row or (two axes) each with each.  Sums so close
    to the threshold that their order could decide are taken again, exactly
    rounded, so that all steps decide a pair alike."""
    ok = cos >= least
    for at in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):
        ok[at] = math.fsum(x[at[0]] * y[at[-1]]) >= least
    return ok


def _links(group: np.ndarray, ids: np.ndarray, vec: np.ndarray, lo: int,
           window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs among ``window`` neighbours, one end at ``lo`` or
    later; of those only what joins new parts."""
    out_a, out_b = [], []
    for g in range(1, window + 1):
        s = max(0, lo - g)
        if s + g >= len(ids):
            continue
        x, y = slice(s, len(ids) - g), slice(s + g, None)
        cos = np.einsum("ij,ij->i", vec[x], vec[y])
        ok = settle(cos, vec[x], vec[y], least) & \
            (group[x] == group[y]).all(axis=1)
        out_a.append(ids[x][ok])
        out_b.append(ids[y][ok])
    a = np.concatenate(out_a) if out_a else ids[:0]
    b = np.concatenate(out_b) if out_b else ids[:0]
    keep = spanning(a, b)
    return a[keep], b[keep]


def usable(label: str, vec: str):
    """Whether a row can link at all."""
    x = F.col(vec)
    return F.col(label).isNotNull() & x.isNotNull() & F.coalesce(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c)
                 & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) \
        & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))


def keyed(classes: DataFrame, passes: int, bits: int,
          seed: int) -> DataFrame:
    """Every class once per pass, with its projection key (``vec``: unit
    vectors)."""
    def rows(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            vecs = vectors(batch.column(2))
            lens = np.array([len(v) for v in vecs])
            for dim in np.unique(lens).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)) \
                        .standard_normal((dim, passes * bits))
                at = np.flatnonzero(lens == dim)
                side = np.stack([vecs[i] for i in at]) @ planes[dim] > 0
                part = batch.take(pa.array(at))
                for p in range(passes):
                    key = side[:, p * bits:(p + 1) * bits] @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(at), pa.int32()),
                         part.column(1), pa.array([dim] * len(at),
                                                  pa.int32()),
                         pa.array(key), part.column(0), part.column(2)],
                        names=["pass", "label", "dim", "key", "id", "vec"])
    return classes.select("id", "label", "vec").mapInArrow(
        rows, "pass int, " + _ROW)


def pass_links(rows: DataFrame, window: int, least: float) -> DataFrame:
    """a, b: verified neighbours in the order of some pass.

    A partition compares its own rows as a stream and hands on its first and
    last ``window`` rows.  With the partitions' sizes these get their places
    in the whole order, and meet in cells of ``window`` places: rows of a cell
    and the next one.  So neighbours meet however many partitions, short or
    empty ones too, lie between them.
    """
    spark = rows.sparkSession
    order = ["pass", "label", "dim", "key", "id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, *order) \
        .sortWithinPartitions(*order)
    shape = "a long, b long, part int, at long, size long, pass int, " \
        "label long, dim int, vec binary"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
             pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in shape.split(", ")]

    def batch_of(m: int, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[n], t) if n in columns else pa.nulls(m, t)
             for n, t in zip(names, types)], names=names)

    def compare(batches):
        pid = TaskContext.get().partitionId()

        def edge(at, group, ids, vec):
            m = len(ids)
            return batch_of(m, a=ids, part=[pid] * m,
                            at=np.arange(at, at + m), **{
                                "pass": group[:, 0], "label": group[:, 1],
                                "dim": group[:, 2],
                                "vec": [v.tobytes() for v in vec]})
        tail, last, seen = None, [], 0
        for _, block in _by_dim(batches):
            group, ids, vec = block
            m = min(max(window - seen, 0), len(ids))
            if m:
                yield edge(seen, group[:m], ids[:m], vec[:m])
            n = len(ids)
            if m < n:  # what may be among the partition's last rows
                k = max(m, n - window)
                last.append((seen + k, group[k:], ids[k:], vec[k:]))
                while sum(len(x[2]) for x in last[1:]) >= window:
                    last.pop(0)
            seen += n
            old = 0
            if tail is not None and tail[2].shape[1] == vec.shape[1]:
                old = len(tail[1])
                group, ids, vec = (np.concatenate((p, q)) for p, q in
                                   zip(tail, block))
            a, b = _links(group, ids, vec, old, window, least)
            yield batch_of(len(a), a=a, b=b)
            tail = group[-window:], ids[-window:], vec[-window:]
        for at, group, ids, vec in last:
            k = min(max(seen - window - at, 0), len(ids))
            if k < len(ids):
                yield edge(at + k, group[k:], ids[k:], vec[k:])
        yield batch_of(1, part=[pid], size=[seen])

    def meet(batches):
        for t in grouped(batches, [0]):
            ids = t.column(2).to_numpy()
            group = np.column_stack([t.column(i).to_numpy()
                                     for i in (3, 4, 5)])
            vecs = vectors(t.column(6))
            lens = np.array([len(v) for v in vecs])
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                a, b = _links(group[at], ids[at],
                              np.stack([vecs[i] for i in at]), 0, window,
                              least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b)], names=["a", "b"])
    out = stash(rows.mapInArrow(compare, shape), "passes")
    # one row a partition
    starts = out.filter("size is not null").select("part", F.coalesce(
        F.sum("size").over(Window.orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    edges = out.filter("at is not null").join(starts, "part").withColumn(
        "place", F.col("start") + F.col("at"))
    cell = F.floor(F.col("place") / window)
    border = edges.withColumn("cell", F.explode(F.array(cell, cell - 1))) \
        .repartition(parts, "cell").sortWithinPartitions("cell", "place") \
        .select("cell", "place", F.col("a").alias("id"), "pass", "label",
                "dim", "vec").mapInArrow(meet, "a long, b long")
    return out.filter("b is not null").select("a", "b").union(border) \
        .distinct()


def _by_dim(batches) -> Iterator[tuple]:
    """(dim, (group, ids, vectors)) of runs of rows with one dimension."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.column_stack([
            batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in (0, 1, 2)])
        ids = batch.column(4).to_numpy()
        vecs = vectors(batch.column(5))
        dims = group[:, 2]
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(),
                len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield int(dims[lo]), (group[lo:hi], ids[lo:hi],
                                  np.stack(vecs[lo:hi]))


def close_vectors(least: float):
    """For runs: row -> which rows' vectors are similar to its own."""
    def prepare(data):
        vecs = [np.frombuffer(x, np.float64) for x in data]
        lens = np.array([len(v) for v in vecs])
        unit = np.zeros((len(vecs), int(lens.max())))
        for row, v in zip(unit, vecs):
            row[:len(v)] = v

        def near(r: int) -> np.ndarray:
            same = np.broadcast_to(unit[r], unit.shape)
            return settle(unit @ unit[r], unit, same, least) \
                & (lens == lens[r])
        return near
    return prepare


def count_links(classes: DataFrame, groups: DataFrame, least: float,
                block: int) -> DataFrame:
    """id, links: for every class of a component the vectors (copies
    counted) of other classes linked with it directly."""
    size = groups.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q"))
    rows = classes.join(groups, classes["id"] == groups["node"]) \
        .join(size, "component") \
        .select("component", "q", "id", "label", "m", "vec",
                F.pmod(F.xxhash64("id"), F.col("q")).cast("int")
                .alias("own"))
    # block i meets block j in task (i, j), i <= j
    rows = rows.withColumn("other", F.explode(
        F.sequence(F.lit(0), F.col("q") - 1))) \
        .select("component", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"), "own", "id", "label",
                "m", "vec")

    def count(batches):
        for t in grouped(batches, [0, 1, 2]):
            own = t.column(3).to_numpy()
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            ids, label, m = (t.column(c).to_numpy() for c in (4, 5, 6))
            vecs = vectors(t.column(7))
            lens = np.array([len(v) for v in vecs])
            total = np.zeros(len(ids), dtype=np.int64)
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                v = np.stack([vecs[x] for x in at])
                for lo in range(0, len(at), 512):  # rows against all
                    part, w = at[lo:lo + 512], v[lo:lo + 512]
                    ok = settle(w @ v.T, w, v, least) & \
                        (label[part][:, None] == label[at][None, :])
                    ok &= ids[part][:, None] != ids[at][None, :]
                    if i != j:
                        ok &= own[part][:, None] != own[at][None, :]
                    total[part] += ok @ m[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(total)], names=["id", "links"])
    by = ["component", "i", "j"]
    return rows.repartition(*by).sortWithinPartitions(*by) \
        .mapInArrow(count, "id long, links long") \
        .groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, key: str = "vec_id",
                 vec: str = "embedding", label: str = "label",
                 least: float = 0.93, window: int = 32, miss: float = 1e-3,
                 bits: int = 48, block: int = 2048,
                 seed: int = 5) -> DataFrame:
    """key, n_links, component_id, kept for every row of ``rows``."""
    rows = rows.select(
        F.col(key).cast("long").alias("key"),
        F.col(label).cast("long").alias("label"),
        F.col(vec).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable("label", "v")
                           & F.col("key").isNotNull())
    mark = {"h1": F.xxhash64("label", "v"),
            "h2": F.xxhash64(F.lit(seed), "v", "label")}

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(
                    [units(x.values.to_numpy()[None])[0].tobytes()
                     for x in batch.column(batch.num_columns - 1)],
                    pa.binary())],
                names=["id", "m", "h1", "h2", "label", "vec"])
    classes = stash(
        rows.filter("ok").withColumns(mark).groupBy("h1", "h2")
        .agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("m"),
             F.first("label").alias("label"), F.first("v").alias("v"))
        .select("id", "m", "h1", "h2", "label", "v")
        .mapInArrow(packed, "id long, m long, h1 long, h2 long, label long, "
                            "vec binary"), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")) \
        .first()[0] or 1
    deep = min(bits, max(1, math.ceil(math.log2(max(2.0,
                                                    largest / window)))))
    agree = (1 - math.acos(least) / math.pi) ** deep
    passes = max(4, math.ceil(math.log(miss) / math.log1p(-agree)))
    order = keyed(classes, passes, bits, seed)
    near = pin(pass_links(order, window, least))
    groups = pin(components(near))
    # runs that outgrow the window, where they are not one component yet
    runs = pin(with_roots(crowded(order.select(
        F.xxhash64("pass", "label", "dim",
                   F.shiftright("key", bits - deep)).alias("run"),
        "id", "label"), window), groups))
    if not runs.isEmpty():
        groups = components(near.union(run_links(
            dealt(runs, block).join(classes.select(
                "id", "label", F.col("vec").alias("data")),
                ["id", "label"]), close_vectors(least))))
    links = count_links(classes, groups, least, block)
    known = classes.drop("vec", "label") \
        .join(groups, classes["id"] == groups["node"], "left") \
        .join(links, "id", "left") \
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1)
                .alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumns(mark).select("key", "ok", "h1", "h2") \
        .join(known, ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")) \
        .otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0))
        .cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
