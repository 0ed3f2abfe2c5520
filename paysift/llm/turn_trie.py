"""Prefix trie of conversations from adaptive radix trees.

A turn's id is the MD5 of its role and text, 16 bytes, big-endian; a
conversation is the row of its turns' ids.  Conversations are cut every
``stretch`` turns, so that no key is longer than that; a later stretch hangs
below the node where the one before ended, which is named by two exclusive ors
of hashes of (place, id) over all turns before - an associative sum, so no task
holds a long conversation.  Stretches are sorted over range partitions by
(beginning, ids, conversation); every partition builds a radix tree for each
beginning and reads nodes off its turn-aligned depths only.  A node whose
conversations stand in several partitions is summed from theirs.  So neither a
common first turn nor thousands of equal conversations meet in one task.

Sums over subtrees come from pointer doubling over the nodes: log2(depth)
rounds of a pre-aggregated sum and a join.  The ids that end at a node leave
the trees in sorted chunks, which are hashed as a stream.

Defined cases: null role or text counts as empty; turns of a conversation with
equal numbers (null first) stand in the order of their ids; repeated rows are
turns of their own; rows without a conversation id name no conversation and
are left out; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.radix import RadixTree
from paysift.llm.runs import grouped
from paysift.llm.stash import pin, stash
from paysift.operators.ordered import running

_WIDTH = 16


def turn_rows(table: DataFrame, conv: str, turn: str, role: str,
              text: str) -> DataFrame:
    """c, pos (from 0), id (hex), size (code points) of every turn."""
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = table.select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who,
                       said)).alias("id"),
        F.char_length(said).cast("long").alias("size")) \
        .filter("c is not null")
    return running(stash(rows, "turns"), ["c"],
                   [F.asc_nulls_first("turn"), "id"],
                   {"pos": F.lit(1)}).select("c", "pos", "id", "size")


def rebuilt(turns: DataFrame, group: int, most: int) -> tuple[DataFrame,
                                                              DataFrame]:
    """Conversations joined to the beginning of their group's first one:
    every ``c`` gets the first h turns of ``c - c % group``, then its own
    after its first h; h is crc32(c) modulo ``most``.  The new turns (c, pos,
    id, size), and (c, total) of every conversation."""
    known = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("c") - F.col("c") % group
    convs = known.select(
        "c", "n", base.alias("base"),
        (F.crc32(F.col("c").cast("string").cast("binary")) % most)
        .alias("h"))
    bases = known.filter(F.col("c") % group == 0).select(
        F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = pin(convs.join(bases, "base", "left").select(
        "c", "base", "h", "n",
        F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    heads = turns.filter((F.col("c") % group == 0) & (F.col("pos") < most)) \
        .select(F.col("c").alias("base"), "pos", "id", "size") \
        .join(convs, "base").filter(F.col("pos") < F.col("h")) \
        .select("c", "pos", "id", "size")
    own = turns.join(convs, "c").filter(F.col("pos") >= F.col("h")).select(
        "c", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"),
        "id", "size")
    total = F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return heads.union(own), convs.select("c", total.alias("total"))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def stretches(turns: DataFrame, convs: DataFrame,
              stretch: int) -> DataFrame:
    """c, no (of the stretch), a1, a2 (name of the node where it begins), b1,
    b2 (where a full one ends), key (ids), sizes."""
    mark = [F.xxhash64("pos", "id", F.lit(s)) for s in (1, 2)]
    parts = turns.groupBy(
        "c", F.floor(F.col("pos") / stretch).alias("no")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "size")))
        .alias("t"), F.bit_xor(mark[0]).alias("x1"),
        F.bit_xor(mark[1]).alias("x2"))
    turnless = convs.filter("total = 0").select(
        "c", F.lit(0).cast("long").alias("no"))
    parts = parts.unionByName(turnless, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    parts = parts.select(
        "c", "no", F.coalesce("x1", zero).alias("x1"),
        F.coalesce("x2", zero).alias("x2"),
        F.coalesce(F.unhex(F.array_join(F.transform(
            "t", lambda t: t["id"]), "")), F.lit(b"")).alias("key"),
        F.coalesce(F.transform("t", lambda t: t["size"]),
                   F.array().cast("array<long>")).alias("sizes"))
    out = running(parts, ["c"], ["no"],
                  {"a1": F.col("x1"), "a2": F.col("x2")}, F.bit_xor, _xor)
    return out.join(convs, "c").select(
        "c", "no", "a1", "a2", _xor(F.col("a1"), F.col("x1")).alias("b1"),
        _xor(F.col("a2"), F.col("x2")).alias("b2"), "key", "sizes",
        ((F.col("no") + 1) * stretch < F.col("total")).alias("more"))


_NODE = "id binary, parent binary, depth long, n long, least long, " \
        "size long, first long, ids binary"
_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
          pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _read_tree(tree: RadixTree, no: int, begin: bytes, stretch: int,
               sizes: dict, full: dict, goes_on: set, chunk: int):
    """The rows of a tree's nodes and of the ids that end there."""
    rows = []
    for key, n, least, ends in tree.aligned(_WIDTH):
        d = len(key) // _WIDTH

        def name(k: bytes) -> bytes:
            if not k:
                return begin
            return full[k] if len(k) == stretch * _WIDTH else \
                hashlib.md5(begin + k).digest()
        own = name(key)
        if d or not no:  # a later stretch's beginning is known already
            rows.append((own, name(key[:-_WIDTH]) if d else None,
                         no * stretch + d, n, least,
                         sizes[key[-_WIDTH:]] if d else 0, None, None))
        ends = sorted(c for c in ends if c not in goes_on)
        for lo in range(0, len(ends), chunk):
            ids = np.array(ends[lo:lo + chunk], np.int64)
            rows.append((own, None, None, None, None, None, ends[lo],
                         ids.tobytes()))
    return rows


def shard_nodes(rows: DataFrame, stretch: int, shard_rows: int,
                chunk: int) -> DataFrame:
    """Nodes (n, least of this partition's conversations) and chunks of the
    ids that end at a node, from radix trees over range partitions."""
    spark = rows.sparkSession
    rows = stash(rows, "stretches")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-rows.count() // shard_rows))
    order = ["no", "a1", "a2", "key", "c"]

    def work(batches):
        for t in grouped(batches, [0, 1, 2]):
            no, a1, a2 = (t.column(i)[0].as_py() for i in range(3))
            tree, sizes, full, goes_on = RadixTree(), {}, {}, set()
            for key, c, b1, b2, size, more in zip(*[
                    t.column(i).to_pylist() for i in range(3, 9)]):
                tree.insert(key, c)
                for i, s in enumerate(size):
                    sizes[key[i * _WIDTH:(i + 1) * _WIDTH]] = s
                if len(key) == stretch * _WIDTH:
                    full[key] = struct.pack(">qq", b1, b2)
                if more:
                    goes_on.add(c)
            found = _read_tree(tree, no, struct.pack(">qq", a1, a2),
                               stretch, sizes, full, goes_on, chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found), _TYPES)],
                names=_NAMES)
    return rows.repartitionByRange(parts, *order) \
        .sortWithinPartitions(*order) \
        .select(*order, "b1", "b2", "sizes", "more") \
        .mapInArrow(work, _NODE)


def _end_digests(chunks: DataFrame) -> DataFrame:
    """id, ends_sha256: digest of the decimal ids, ascending, with commas."""
    def work(batches):
        node, held = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, blob in zip(ids, batch.column(2).to_pylist()):
                if i != node:
                    if node is not None:
                        yield _digest_row(node, held)
                    node, held = i, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(",".join(map(str, np.frombuffer(
                    blob, np.int64).tolist())).encode())
        if node is not None:
            yield _digest_row(node, held)
    return chunks.select("id", "first", "ids").repartition("id") \
        .sortWithinPartitions("id", "first") \
        .mapInArrow(work, "id binary, ends_sha256 string")


def _digest_row(node: bytes, held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.binary()), pa.array([held.hexdigest()])],
        names=["id", "ends_sha256"])


def subtree_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` (id, parent, ...) with each of ``names`` summed over the
    subtree.  After round k a node holds the sum over its descendants of
    less than 2**k steps and points to its ancestor 2**k steps up."""
    t = pin(nodes.select("id", F.col("parent").alias("up"), *names))
    while not t.filter("up is not null").isEmpty():
        low = t.filter("up is not null").groupBy(F.col("up").alias("id")) \
            .agg(*[F.sum(c).alias(f"__{c}") for c in names])
        jump = t.filter("up is not null").select(
            F.col("id").alias("to"), F.col("up").alias("next"))
        # nodes that point past the root look for themselves, not for null
        t = pin(t.join(low, "id", "left").withColumn(
            "to", F.coalesce("up", "id")).join(jump, "to", "left").select(
            "id", F.when(F.col("up").isNotNull(), F.col("next"))
            .alias("up"),
            *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
              for c in names]))
    return nodes.drop(*names).join(t.drop("up"), "id")


def prefix_trie(table: DataFrame, conv: str = "conv_id",
                turn: str = "turn", role: str = "role", text: str = "text",
                group: int = 100, most: int = 6, stretch: int = 64,
                shard_rows: int = 1 << 15,
                chunk: int = 1 << 13) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes in the subtree), saved_tokens (code points that sharing saves in
    the subtree), ends_sha256, and id and parent, the nodes' names."""
    turns = stash(turn_rows(table, conv, turn, role, text), "ordered")
    made, convs = rebuilt(turns, group, most)
    found = stash(shard_nodes(stretches(made, convs, stretch), stretch,
                              shard_rows, chunk), "nodes")
    nodes = stash(found.filter("n is not null").groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
        F.max("size").alias("size")), "merged")
    children = nodes.filter("parent is not null") \
        .groupBy(F.col("parent").alias("id")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = pin(nodes.join(children, "id", "left").select(
        "id", "parent", "depth", "n_convs", "conv_id",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
        .alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")))
    ends = _end_digests(found.filter("ids is not null"))
    above = nodes.select(F.col("id").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"))
    return subtree_sums(nodes, ["n_leaves", "saved_tokens"]) \
        .join(above, "parent", "left").join(ends, "id", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
            .alias("ends_sha256"), "id", "parent")
