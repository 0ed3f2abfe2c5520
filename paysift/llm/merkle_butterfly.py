"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf.  Per group (language) leaves ascend by key; while more
than one node is left, every ``fanout`` consecutive nodes become their hash.
The groups' roots, ordered by group, are joined to one root the same way.

Leaves are ranked within their group and dealt to blocks of
``fanout ** levels`` leaves, aligned with the tree, so that a block builds its
lower levels alone.  The upper levels follow from a butterfly: in round r the
blocks whose numbers differ in one digit of base ``fanout`` swap the roots of
their subtrees, and each of them hashes the common ancestor for itself.  The
siblings received are the block's upper proof, so no downward pass is needed.
Where a sibling subtree has fewer blocks, its blocks answer for the missing
partners in turn.  A round moves at most ``fanout`` digests to each block, and
the rounds grow with the logarithm of the blocks.  The groups' tree goes on
with the same exchange over the blocks of all groups.

No task holds more than a block; ranks and first blocks come from distributed
running totals, for groups and for rows.

Defined cases: a null group is a group of its own and comes first; null keys
come first in their group; rows that repeat a key are leaves of their own,
ordered by their digests; a group of one leaf is that leaf; an empty table
gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, StringType, StructField,
                               StructType)

from paysift.llm.runs import grouped
from paysift.llm.stash import pin, stash
from paysift.operators.ordered import running


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: '-' for a null, else byte count, ':' and value."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"),
                                   F.lit(":"), s), F.lit("-"))
    return digest(*[field(c) for c in columns])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda a, s: digest(
        s["before"], a, s["after"]))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof: its siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(
        proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_tree(leaves: list[str], fanout: int,
               levels: int | None) -> list[list[str]]:
    """The nodes of a block, level by level up to its root: ``levels`` above
    the leaves, or (None) until one node is left."""
    tree = [leaves]
    while len(tree[-1]) > 1 if levels is None else len(tree) <= levels:
        low = tree[-1]
        tree.append([_hash("".join(low[i:i + fanout]))
                     for i in range(0, len(low), fanout)])
    return tree


def _tree_of(block: int, leaves: list[str], fanout: int,
             levels: int) -> list[list[str]]:
    # a first block that is not full is its group's only one
    alone = block == 0 and len(leaves) < fanout ** levels
    return block_tree(leaves, fanout, None if alone else levels)


def _block_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    def work(batches):
        for t in grouped(batches, [0, 1]):
            block = t.column(1)[0].as_py()
            tree = _tree_of(block, t.column(3).to_pylist(), fanout, levels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.column(0)[0].as_py()], pa.string()),
                 pa.array([block], pa.int64()), pa.array(tree[-1])],
                names=["group", "block", "digest"])
    by = ["group", "block"]
    return leaves.select(*by, "place", "leaf").repartition(*by) \
        .sortWithinPartitions(*by, "place") \
        .mapInArrow(work, "group string, block long, digest string")


_KEPT = ["group", "no", "block", "blocks", "first", "subroot"]


def _swap(state: DataFrame, level: int) -> DataFrame:
    """One round: every block learns its siblings' digests and hashes the
    parent.  ``state`` has id (the block's number over all groups), digest,
    at (its subtree among the siblings) and sibs (first id and number of
    blocks of each sibling subtree)."""
    own = F.get("sibs", F.col("at"))
    mine = F.col("id") - own["first"]
    to = F.col("to")
    partners = F.when(F.col("n") == F.col("at"), F.array("id")).when(
        mine < to["width"],
        F.sequence(to["first"] + mine, to["first"] + to["width"] - 1,
                   own["width"]))
    sent = state.select("id", "digest", "at", "sibs", *_KEPT,
                        F.posexplode("sibs").alias("n", "to")) \
        .select(F.explode(partners).alias("id"), "at", "digest",
                F.when(F.col("n") == F.col("at"), F.struct("at", *_KEPT))
                .alias("me"))
    met = sent.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"),
        F.max("me").alias("me"))

    def side(test) -> Column:
        return F.array_join(F.transform(F.filter("run", test),
                                        lambda x: x["digest"]), "")
    at = F.col("me.at")
    out = met.select(
        "id", *[F.col(f"me.{c}").alias(c) for c in _KEPT],
        side(lambda x: x["at"] < at).alias("before"),
        side(lambda x: x["at"] > at).alias("after"),
        digest(F.array_join(F.transform("run", lambda x: x["digest"]), ""))
        .alias("digest"), F.lit(level).alias("level"))
    return pin(out)


def _within(state: DataFrame, fanout: int, r: int) -> DataFrame:
    """at and sibs of round ``r`` in the trees of the groups."""
    size = fanout ** r
    node = F.floor(F.col("block") / size)
    head = (node - node % fanout).cast("long")
    last = F.least(head + fanout - 1, F.floor((F.col("blocks") - 1) / size))
    return state.withColumns({
        "at": (node % fanout).cast("int"),
        "sibs": F.transform(F.sequence(head, last), lambda s: F.struct(
            (F.col("first") + s * size).alias("first"),
            F.least(F.lit(size), F.col("blocks") - s * size)
            .cast("long").alias("width")))})


def _across(state: DataFrame, nodes: DataFrame, fanout: int,
            t: int) -> DataFrame:
    """at and sibs of round ``t`` in the tree of the groups' roots."""
    up = fanout ** (t + 1)
    sibs = nodes.groupBy(F.floor(F.col("node") / fanout).alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("first", "width")))
        .alias("sibs"))
    node = F.floor(F.col("no") / fanout ** t)
    return state.withColumn("up", F.floor(F.col("no") / up)) \
        .join(sibs, "up").withColumn("at", (node % fanout).cast("int"))


def butterfly(roots: DataFrame, fanout: int, levels: int
              ) -> tuple[DataFrame, DataFrame]:
    """From the roots of all blocks (group, block, digest): the upper proofs
    (group, block, level, before, after) and the final state (group, block,
    subroot, digest: the root)."""
    roots = pin(roots)
    groups = roots.groupBy("group").agg(F.count(F.lit(1)).alias("blocks"))
    groups = pin(running(groups, [], ["group"], {
        "no": F.lit(1), "first": F.col("blocks")}))
    most, n = groups.agg(F.max("blocks"), F.count(F.lit(1))).first()
    state = roots.join(groups, "group").select(
        (F.col("first") + F.col("block")).alias("id"), "digest", "group",
        "no", "block", "blocks", "first",
        F.lit(None).cast("string").alias("subroot"))
    base = ["id", "digest", *_KEPT]
    proofs, r = [], 0
    while fanout ** r < (most or 0):
        # groups of fewer blocks have their root already
        more = F.col("blocks") > fanout ** r
        met = _swap(_within(state.filter(more), fanout, r), levels + r)
        proofs.append(met)
        state = pin(met.select(*base).union(
            state.filter(~more).select(*base)))
        r += 1
    state = state.withColumn("subroot", F.col("digest"))
    nodes = groups.select(F.col("no").alias("node"), "first",
                          F.col("blocks").alias("width"))
    t = 0
    while fanout ** t < (n or 0):
        met = _swap(_across(state, nodes, fanout, t), levels + r + t)
        proofs.append(met)
        state = met
        nodes = nodes.groupBy(F.floor(F.col("node") / fanout)
                              .alias("node")).agg(
            F.min("first").alias("first"), F.sum("width").alias("width"))
        t += 1
    shape = ["group", "block", "level", "before", "after"]
    upper = roots.sparkSession.createDataFrame(
        [], "group string, block long, level int, before string, "
            "after string")
    for p in proofs:
        upper = upper.union(p.select(*shape))
    return upper, state.select("group", "block", "subroot", "digest")


def merkle_manifest(rows: DataFrame, key: str = "doc_id",
                    group: str = "lang", leaf: str = "leaf",
                    carry: Sequence[str] = (), fanout: int = 8,
                    levels: int = 4) -> DataFrame:
    """key, carry columns, leaf, subroot, root and proof (before and after:
    the siblings' digests left and right of the own node, level by level) of
    every row; ``leaf`` names the column with the row's digest."""
    size = fanout ** levels
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")),
                   F.lit("")).alias("group"),
        F.col(key).alias("key"), F.col(leaf).alias("leaf"),
        F.struct(F.lit(0).alias("__"), *carry).alias("carry"))
    ranked = running(stash(named, "leaves"), ["group"],
                     [F.asc_nulls_first("key"), "leaf"], {"rank": F.lit(1)})
    leaves = stash(ranked.select(
        "group", F.floor(F.col("rank") / size).alias("block"),
        (F.col("rank") % size).cast("int").alias("place"), "leaf", "key",
        "carry"), "blocks")
    upper, tops = butterfly(_block_roots(leaves, fanout, levels), fanout,
                            levels)
    null = {c: F.lit(None).cast(leaves.schema[c].dataType)
            for c in ("leaf", "key", "carry")}
    # a block's proof rows stand before its leaves
    heads = upper.select("group", "block",
                         (F.col("level") - 1000).alias("place"),
                         F.col("before").alias("a"), F.col("after")
                         .alias("b")) \
        .union(tops.select("group", "block", F.lit(-2000), "subroot",
                           "digest")).withColumns(null)
    none = F.lit(None).cast("string")
    both = leaves.withColumns({"a": none, "b": none}).unionByName(heads) \
        .select("group", "block", "place", "leaf", "key", "carry", "a", "b")

    def work(batches):
        for t in grouped(batches, [0, 1]):
            t = t.combine_chunks()
            place = t.column(2).to_numpy()
            up = int((place < 0).sum())
            left = t.column(6).slice(0, up).to_pylist()
            right = t.column(7).slice(0, up).to_pylist()
            t = t.slice(up)
            leaves = t.column(3).to_pylist()
            tree = _tree_of(t.column(1)[0].as_py(), leaves, fanout, levels)
            n, before, after = len(leaves), [], []
            at = list(range(n))
            for low in tree[:-1]:
                sides = []
                for i in range(len(low)):
                    lo = i - i % fanout
                    sides.append(("".join(low[lo:i]),
                                  "".join(low[i + 1:lo + fanout])))
                before.append([sides[i][0] for i in at])
                after.append([sides[i][1] for i in at])
                at = [i // fanout for i in at]
            for a, b in zip(left[1:], right[1:]):
                before.append([a] * n)
                after.append([b] * n)
            depth = len(before)

            def by_row(columns):
                flat = pa.array([x for c in columns for x in c],
                                pa.string())
                order = np.arange(depth * n).reshape(depth, n).T.ravel()
                return flat.take(pa.array(order))
            proof = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * depth),
                pa.StructArray.from_arrays(
                    [by_row(before), by_row(after)],
                    names=["before", "after"]))
            yield pa.RecordBatch.from_arrays(
                [t.column(4).combine_chunks(), t.column(5).combine_chunks(),
                 t.column(3).combine_chunks(), pa.array([left[0]] * n),
                 pa.array([right[0]] * n), proof],
                names=["key", "carry", "leaf", "subroot", "root", "proof"])
    text = StringType()
    schema = StructType([
        StructField("key", leaves.schema["key"].dataType),
        StructField("carry", leaves.schema["carry"].dataType),
        StructField("leaf", text), StructField("subroot", text),
        StructField("root", text),
        StructField("proof", ArrayType(StructType([
            StructField("before", text), StructField("after", text)])))])
    by = ["group", "block"]
    out = both.repartition(*by).sortWithinPartitions(*by, "place") \
        .mapInArrow(work, schema)
    return out.select(F.col("key").alias(key),
                      *[F.col(f"carry.{c}").alias(c) for c in carry],
                      "leaf", "subroot", "root", "proof")
