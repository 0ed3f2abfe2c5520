"""MinHash near-duplicates by an LSH forest.

Every text becomes a set of hashed word shingles; equal sets fall into one
class.  A class has ``trees`` signatures of ``depth`` minhashes.  All
signatures of a tree are sorted, and a class's candidates are its ``window``
neighbours on either side: those with the longest common prefix.  How deep
the prefix is adapts to the region: in a dense one the neighbours agree on
many minhashes, in a sparse one on few, down to ``min_depth``.  Classes that
agree on all minhashes of a tree are candidates of their direct neighbour
only; three and more of them are a crowded run.

Candidates whose minhashes agree too rarely for the threshold (five standard
deviations) are dropped, the rest form families.  Links are confirmed on full
sets: first every member against the smallest member of its family (one copy
of each set is shuffled), then every candidate pair whose ends are not yet
joined.  More classes than the window holds may agree on the first
``min_depth`` minhashes of a tree; such runs are crowded too.  What is not yet
joined in crowded runs is compared block against block: signatures first, then,
in the same blocks, the full sets of classes that resemble a class of another
component.  A run inside a crowded run is not compared again.  So a pair
is compared if it agrees on ``min_depth`` minhashes of any tree, however many
classes do.  Components of the confirmed links are the result.

No task holds a group: signatures are range-sorted with the row's place and
id as the last keys and read as a stream; only ``2 * window`` rows on each
side of a partition boundary meet on the driver.

Defined cases: null text, empty text and text without words have the empty
set, are linked with nothing and kept; a text with fewer words than a shingle
has one shingle, its whole word sequence; a null key is linked with nothing
and kept, with a null component; equal texts are one class, whose smallest
key is kept; a repeated key counts as one node; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.bpe import forget
from paysift.llm.graph import components
from paysift.llm.runs import crowded, dealt, run_links, suspects, with_roots
from paysift.llm.stash import pin, release, stash
from paysift.llm.words import (chunks, hashed_words, mix64, run_hash,
                               sliced)
from paysift.session import bound_batches

_U = np.uint64
_U4 = np.uint32


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for lo, hi in chunks(texts):
        h, first = hashed_words([t.lower() for t in texts[lo:hi]])
        runs = run_hash(h, k)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(runs[a:b - k + 1])
            elif b > a:
                yield run_hash(h[a:b], b - a) ^ _U(b - a)
            else:
                yield np.zeros(0, _U)


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 31, n, dtype=_U4) * _U4(2) + _U4(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(_U4)


def minhashes(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The minhash of ``s`` under every function, two bytes each."""
    a, b = (x[:, None] for x in family)
    low = np.full(len(a), 0xFFFFFFFF, dtype=_U4)
    x = (s ^ (s >> _U(32))).astype(_U4)
    for i in range(0, len(x), 2048):
        y = x[None, i:i + 2048] * a
        y += b
        y ^= y >> _U4(15)
        y *= _U4(0x85EBCA6B)
        np.minimum(low, y.min(axis=1), out=low)
    low = low ^ (low >> _U4(13))
    return ((low * _U4(0xC2B2AE35)) >> _U4(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, key: str, text: str, shingle: int,
               n: int, seed: int) -> DataFrame:
    """key, n_shingles, f1 and f2 (fingerprint of the set), sig."""
    def rows(batches):
        forget()
        family = hash_family(n, seed)
        for batch in sliced(batches, 1):
            keys = batch.column(0)
            texts = [b"" if t is None else t
                     for t in batch.column(1).to_pylist()]
            size, f1, f2, sig = [], [], [], []
            for s in shingle_sets(texts, shingle):
                size.append(len(s))
                f1.append(int(mix64(s).sum(dtype=_U).view(np.int64)))
                f2.append(int(mix64(s ^ _U(0x5851F42D4C957F2D))
                              .sum(dtype=_U).view(np.int64)))
                sig.append(minhashes(s, family) if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(size, pa.int64()), pa.array(f1, pa.int64()),
                 pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
                names=["key", "n_shingles", "f1", "f2", "sig"])
    return docs.select(F.col(key).cast("long").alias("key"),
                       F.col(text).cast("binary").alias("text")) \
        .mapInArrow(rows, "key long, n_shingles long, f1 long, f2 long, "
                          "sig binary")


def _near(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, lag: int,
          from_row: int, min_depth: int, pct: int) -> tuple:
    """Pairs (i, i + lag) of sorted rows that agree on ``min_depth``
    minhashes and whose sizes allow the similarity; i + lag >= from_row.
    Rows that agree on all minhashes form a chain (lag 1)."""
    lo = max(0, from_row - lag)
    a, b = slice(lo, len(ids) - lag), slice(lo + lag, None)
    if lo + lag >= len(ids):
        return ids[:0], ids[:0]
    ok = (keys[a, :min_depth + 1] == keys[b, :min_depth + 1]).all(axis=1)
    small = np.minimum(sizes[a], sizes[b])
    large = np.maximum(sizes[a], sizes[b])
    ok &= (100 * small >= pct * large) & (ids[a] != ids[b])
    if lag > 1:
        ok &= (keys[a] != keys[b]).any(axis=1)
    return ids[a][ok], ids[b][ok]


def forest_neighbours(classes: DataFrame, trees: int, depth: int,
                      window: int, min_depth: int, pct: int) -> DataFrame:
    """a, b: distinct neighbours in some tree; from classes (id, n, sig)."""
    width = 2 * depth
    spark = classes.sparkSession
    rows = classes.select(
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
        "id", "n", "sig")
    rows = rows.select("tree", F.substring(
        F.col("sig"), F.col("tree") * width + 1, F.lit(width)).alias("k"),
        "id", F.col("n").cast("int").alias("n"),
        # equal signatures stand in another order in every tree
        F.xxhash64("tree", "id").alias("place"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["tree", "k", "place", "id"]
    rows = rows.repartitionByRange(parts, *order) \
        .sortWithinPartitions(*order).drop("place")

    def pairs(batches):
        pid = TaskContext.get().partitionId()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()),
                            ("edge", pa.int64()), ("at", pa.int64()),
                            ("tree", pa.int32()), ("k", pa.binary()),
                            ("n", pa.int32())])

        def table(batch) -> tuple:
            tree = batch.column(0).to_numpy()
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()),
                              dtype=">u2").reshape(-1, depth)
            return (np.column_stack((tree, k)).astype(np.int32),
                    batch.column(2).to_numpy(), batch.column(3).to_numpy())

        def edge(keys, ids, sizes, at) -> pa.RecordBatch:
            """Rows near the partition's border, to meet the next one's."""
            m = len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.nulls(m, pa.int64()),
                pa.array([pid] * m, pa.int64()),
                pa.array(np.arange(at, at + m), pa.int64()),
                pa.array(keys[:, 0], pa.int32()),
                pa.array([r.astype(">u2").tobytes() for r in keys[:, 1:]],
                         pa.binary()),
                pa.array(sizes, pa.int32())], schema=schema)
        tail, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, sizes = table(batch)
            if seen < window:
                take = min(window - seen, len(ids))
                yield edge(keys[:take], ids[:take], sizes[:take], seen)
            old = 0
            if tail is not None:
                old = len(tail[1])
                keys, ids, sizes = (np.concatenate((p, q)) for p, q in
                                    zip(tail, (keys, ids, sizes)))
            seen += len(ids) - old
            found = [_near(keys, ids, sizes, g, old, min_depth, pct)
                     for g in range(1, window + 1)]
            a = np.concatenate([x[0] for x in found])
            b = np.concatenate([x[1] for x in found])
            if len(a):
                m = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b)] +
                    [pa.nulls(m, t) for t in schema.types[2:]],
                    schema=schema)
            tail = keys[-window:], ids[-window:], sizes[-window:]
        if tail is not None:
            m = len(tail[1])
            skip = max(0, window - (seen - m))  # those sent as first rows
            yield edge(*(x[skip:] for x in tail), seen - m + skip)
    out = pin(rows.mapInArrow(
        pairs, "a long, b long, edge long, at long, tree int, k binary, "
               "n int"))
    border = out.filter("edge is not null") \
        .select("edge", "at", "tree", "k", "a", "n").orderBy("edge", "at") \
        .collect()  # at most 2 * window rows a partition
    across = []
    if border:
        keys = np.column_stack((
            [r.tree for r in border],
            np.frombuffer(b"".join(bytes(r.k) for r in border), ">u2")
            .reshape(-1, depth))).astype(np.int32)
        ids = np.array([r.a for r in border])
        part = np.array([r.edge for r in border])
        sizes = np.array([r.n for r in border])
        for g in range(1, window + 1):
            for i in np.flatnonzero(part[:-g] != part[g:]):
                x, y = _near(keys[i:i + g + 1], ids[i:i + g + 1],
                             sizes[i:i + g + 1], g, g, min_depth, pct)
                across += list(zip(x.tolist(), y.tolist()))
    pairs_df = out.filter("edge is null").select("a", "b")
    if across:
        a, b = zip(*across)
        # an Arrow table: a list of rows would go through Python workers
        pairs_df = pairs_df.union(spark.createDataFrame(pa.table(
            {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})))
    return pairs_df.select(F.least("a", "b").alias("a"),
                           F.greatest("a", "b").alias("b")).distinct()


def similar_signatures(pairs: DataFrame, classes: DataFrame,
                       least_share: float) -> DataFrame:
    """The pairs whose minhashes agree at ``least_share`` or more."""
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()),
                                  np.uint16).reshape(batch.num_rows, -1)
                    for i in (2, 3))
            ok = (x == y).mean(axis=1) >= least_share
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(ok))
    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b") \
        .select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def confirmed(pairs: DataFrame, pct: int) -> DataFrame:
    """a, b of the rows (a, b, x, y) whose sets x and y are similar."""
    def rows(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(x.as_buffer(), _U)
                y = np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(ok, pa.bool_()))
    return pairs.select("a", "b", "x", "y") \
        .mapInArrow(rows, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str,
              shingle: int) -> DataFrame:
    """id, family, set: the whole shingle sets of the wanted rows."""
    def rows(batches):
        for batch in sliced(batches, 2):
            texts = [b"" if t is None else t
                     for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([s.tobytes() for s in
                           shingle_sets(texts, shingle)], pa.binary())],
                names=["id", "family", "set"])
    return docs.select(F.col(key).cast("long").alias("id"),
                       F.col(text).cast("binary").alias("text")) \
        .join(ids, "id").select("id", "family", "text") \
        .mapInArrow(rows, "id long, family long, set binary")


def close_signatures(least_share: float):
    """For runs: row -> which rows' signatures agree with its own."""
    def prepare(data):
        sig = np.ascontiguousarray(np.stack(
            [np.frombuffer(x, np.uint16) for x in data]).T)
        least = least_share * len(sig)
        return lambda r: (sig == sig[:, r:r + 1]) \
            .sum(axis=0, dtype=np.uint16) >= least
    return prepare


def close_sets(pct: int):
    """For runs: row -> which rows' sets are similar to its own."""
    def prepare(data):
        sets = [np.frombuffer(x, _U) for x in data]
        n = np.array([len(x) for x in sets])
        first = np.cumsum(n) - n
        found, codes = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(len(found), dtype=bool)

        def near(r):
            own = codes[first[r]:first[r] + n[r]]
            held[own] = True
            both = np.add.reduceat(held[codes], first, dtype=np.int64)
            held[own] = False
            return 100 * both >= pct * (n + n[r] - both)
        return near
    return prepare


def crowded_links(docs: DataFrame, classes: DataFrame, groups: DataFrame,
                  key: str, text: str, shingle: int, pct: int, trees: int,
                  depth: int, min_depth: int, window: int,
                  least_share: float, block: int) -> DataFrame | None:
    """a, b: links between components of ``groups`` inside runs that agree
    on ``min_depth`` minhashes of a tree and outgrow the window, or on all
    and outgrow a pair; None without such runs."""
    release(docs.sparkSession)
    rows = classes.select("id", "sig", F.explode(F.sequence(
        F.lit(0), F.lit(trees - 1))).alias("tree"))

    def run(prefix: int) -> Column:
        return F.xxhash64("tree", F.substring(
            F.col("sig"), F.col("tree") * (2 * depth) + 1,
            F.lit(2 * prefix)))
    rows = rows.select(run(min_depth).alias("run"), run(depth).alias("equal"),
                       "id")
    wide = crowded(rows.drop("equal"), window)
    # a crowded run holds all pairs of the equal rows within
    narrow = rows.join(wide.select("run").distinct(), "run", "left_anti") \
        .select(F.col("equal").alias("run"), "id")
    rows = pin(with_roots(wide.union(crowded(narrow, 1)), groups))
    if rows.isEmpty():
        return None
    alike = pin(suspects(
        dealt(rows, block).join(
            classes.select("id", F.col("sig").alias("data")), "id"),
        close_signatures(least_share)))
    if alike.isEmpty():
        return None
    sets = stash(full_sets(
        docs, alike.select("id", F.col("id").alias("family")).distinct(),
        key, text, shingle).dropDuplicates(["id"])
        .select("id", F.col("set").alias("data")), "crowded")
    return run_links(alike.join(sets, "id"), close_sets(pct))


def near_duplicates(docs: DataFrame, key: str = "doc_id",
                    text: str = "text", shingle: int = 5, pct: int = 80,
                    trees: int = 20, depth: int = 6, window: int = 8,
                    min_depth: int = 3, seed: int = 11,
                    block: int = 512) -> DataFrame:
    """key, n_shingles, component_id, kept for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    n = trees * depth
    signed = stash(signatures(docs, key, text, shingle, n, seed), "sets")
    mark = ["n_shingles", "f1", "f2"]
    classes = stash(
        signed.filter("n_shingles > 0 and key is not null")
        .groupBy(*mark).agg(F.min(F.struct("key", "sig")).alias("m"))
        .select(F.col("m.key").alias("id"), F.col("n_shingles").alias("n"),
                "f1", "f2", F.col("m.sig").alias("sig")), "classes")
    share = pct / 100
    least_share = share - 5 * (share * (1 - share) / n) ** 0.5
    candidates = pin(similar_signatures(
        forest_neighbours(classes, trees, depth, window, min_depth, pct),
        classes, least_share))
    families = pin(components(candidates).select(
        F.col("node").alias("id"), F.col("component").alias("family")))
    sets = stash(full_sets(docs, families, key, text, shingle)
                 .dropDuplicates(["id"]), "full")
    heads = sets.filter("id = family").select(
        "family", F.col("set").alias("y"))
    first = pin(confirmed(
        sets.filter("id <> family").join(heads, "family")
        .select(F.col("family").alias("a"), F.col("id").alias("b"),
                F.col("set").alias("x"), "y"), pct))
    # candidate pairs whose ends the first links have not joined
    joined = first.select(F.col("b").alias("id"), F.col("a").alias("root"))
    rest = candidates
    for end in ("a", "b"):
        rest = rest.join(joined.select(F.col("id").alias(end),
                                       F.col("root").alias(f"r{end}")),
                         end, "left") \
            .withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    rest = rest.filter("ra <> rb").select("a", "b")
    more = confirmed(
        rest.join(sets.select(F.col("id").alias("a"),
                              F.col("set").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"),
                          F.col("set").alias("y")), "b"), pct)
    links = pin(first.union(more))
    groups = pin(components(links))
    more = crowded_links(docs, classes, groups, key, text, shingle, pct,
                         trees, depth, min_depth, window, least_share, block)
    if more is not None:
        groups = components(links.union(more))
    root = classes.join(groups, classes["id"] == groups["node"], "left") \
        .select(F.col("n").alias("n_shingles"), "f1", "f2",
                F.coalesce("component", "id").alias("component_id"))
    out = signed.drop("sig").join(root, mark, "left")
    component = F.when(F.col("key").isNotNull(),
                       F.coalesce("component_id", "key"))
    return out.select(
        F.col("key").alias(key), "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
