"""Merkle manifest, conversation trie and radix tree against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paysift.llm.merkle_butterfly import (folded, leaf_digest,
                                          merkle_manifest, proof_digest)
from paysift.llm.radix import RadixTree
from paysift.llm.turn_trie import prefix_trie
from tests.llm import cases


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """Per node the (before, after) digests level by level, and the root."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            lo = i - i % fanout
            p.append(("".join(nodes[lo:i]),
                      "".join(nodes[i + 1:lo + fanout])))
        nodes = [sha(*nodes[i:i + fanout])
                 for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return proofs, nodes[0]


def manifest(rows, fanout):
    """(key, leaf, subroot, root, proof) of (key, group, leaf)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[b"" if group is None else b"=" + group.encode()].append(
            (key is not None, key or 0, leaf, key))
    order, out, tops = sorted(groups), [], []
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        proofs, root = climb([r[2] for r in groups[g]], fanout)
        tops.append((proofs, root))
    upper, root = climb([t[1] for t in tops], fanout)
    for g, (proofs, sub), up in zip(order, tops, upper):
        out += [(r[3], r[2], sub, root, tuple(p + up))
                for r, p in zip(groups[g], proofs)]
    return out


def _plain(row):
    return (row.doc_id, row.leaf, row.subroot, row.root,
            tuple((p.before, p.after) for p in row.proof))


def _key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("fanout,levels", [(2, 0), (2, 1), (3, 2), (8, 1)])
def test_merkle_of_uneven_groups(spark, fanout, levels):
    rng = random.Random(5)
    sizes = [1, 2, 3, 5, 8, 9, 17, 26, 40, 65, 7, 1]
    rows = []
    for g, n in enumerate(sizes):
        group = None if g == 4 else f"l{g}é" if g % 2 else f"l{g}"
        rows += [(rng.randrange(-50, 1 << 40), group,
                  sha(f"{g}/{i}")) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    got = merkle_manifest(df, fanout=fanout, levels=levels)
    assert sorted(map(_plain, got.collect()), key=_key) == \
        sorted(manifest(rows, fanout), key=_key)
    bad = got.select(folded(F.col("leaf"), F.col("proof")).alias("r"),
                     "root").filter("r <> root")
    assert bad.isEmpty()


def test_merkle_awkward_rows(spark):
    docs = cases.awkward(spark)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = docs.select(*docs.columns, leaf_digest(*[
        F.col(c) for c in names]).alias("leaf"))

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    rows = [(r.doc_id, r.lang, sha(*[field(r[c]) for c in names]))
            for r in docs.collect()]
    got = merkle_manifest(leaves, fanout=2, levels=1).collect()
    assert sorted(map(_plain, got), key=_key) == \
        sorted(manifest(rows, 2), key=_key)
    assert len(got) == docs.count()


def test_merkle_finds_a_changed_row(spark):
    rows = [(i, "en" if i % 3 else None, sha(str(i))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    df = df.withColumn("forged", F.when(F.col("doc_id") == 7, F.lit(sha("x"))))
    got = merkle_manifest(df, carry=["forged"], fanout=4, levels=1).select(
        "doc_id", "root", folded(F.coalesce("forged", "leaf"),
                                 F.col("proof")).alias("r"),
        proof_digest(F.col("proof")).alias("p")).collect()
    assert [r.doc_id for r in got if r.r != r.root] == [7]
    want = {r[0]: sha(*[a + b for a, b in r[4]]) for r in manifest(rows, 4)}
    assert {r.doc_id: r.p for r in got} == want


def test_merkle_of_one_row_and_none(spark):
    shape = "doc_id long, lang string, leaf string"
    one = merkle_manifest(spark.createDataFrame([(3, None, "ab")], shape))
    assert [_plain(r) for r in one.collect()] == [(3, "ab", "ab", "ab", ())]
    assert merkle_manifest(spark.createDataFrame([], shape)).collect() == []


# ------------------------------------------------------------------ trie

def trie(rows, group=100, most=6):
    """Nodes by sequence of (conv, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))

    def ident(t):
        return hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}"
                           .encode()).hexdigest()
    own = {c: [(ident(t), len(t[3])) for t in
               sorted(v, key=lambda t: (t[0], t[1], ident(t)))]
           for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = own.get(c - int(abs(c) % group) * (1 if c >= 0 else -1),
                          [])[:h] + turns[h:]
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for c, turns in sorted(made.items()):
        for d in range(len(turns) + 1):
            path = tuple(t[0] for t in turns[:d])
            members[path].append(c)
            size[path] = turns[d - 1][1] if d else 0
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * size[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m),
         kids[p], leaves[p], saved[p], sha(",".join(map(str, ends[p]))))
        for p, m in members.items())


_COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
         "n_leaves", "saved_tokens", "ends_sha256"]
_CONV = "conv_id long, turn long, role string, text string"


def _nodes(df):
    return sorted(tuple(r) for r in df.select(*_COLS).collect())


def conversations(seed, n=60, words=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, n), *range(200, 200 + n), -5, -100, -103]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant",
                         f"said {rng.randrange(words)} é"))
    return rows


@pytest.mark.parametrize("stretch", [1, 2, 3, 64])
def test_trie_matches_brute_force(spark, stretch):
    rows = conversations(stretch)
    got = prefix_trie(spark.createDataFrame(rows, _CONV), stretch=stretch,
                      shard_rows=20, chunk=4)
    assert _nodes(got) == trie(rows)


def test_trie_of_copies_and_long_conversations(spark):
    """A third of the conversations are equal; one has 700 turns."""
    rows = conversations(9, 30)
    rows += [(c, t, "user", "hi") for c in range(1000, 1090) for t in
             range(7)]
    rows += [(5000, t, "user", f"x{t % 5}") for t in range(700)]
    got = prefix_trie(spark.createDataFrame(rows, _CONV), stretch=8,
                      shard_rows=16, chunk=5)
    assert _nodes(got) == trie(rows)


def test_trie_awkward_rows(spark):
    rows = [(0, None, None, None), (0, 1, "a", ""), (0, 1, "a", "b"),
            (0, 1, "a", "b"), (7, 0, "", "x" * 30_000), (7, None, "u", "中"),
            (None, 1, "u", "lost"), (100, 3, "1", "2"), (101, 3, "", "12"),
            (205, None, None, None)]
    df = spark.createDataFrame(rows, _CONV).withColumns(
        {c: F.lit("clash") for c in ("id", "c", "n", "pos", "key", "size")})
    assert _nodes(prefix_trie(df)) == trie(rows)
    assert prefix_trie(spark.createDataFrame([], _CONV)).collect() == []


def test_radix_tree_layouts_and_compression():
    rng = random.Random(1)
    keys = [bytes(rng.randrange(256) for _ in range(2 * rng.randrange(6)))
            for _ in range(3000)]
    keys += [bytes([9, b, 1, 1]) for b in range(256)] + [b"", b"\x09\x01"] * 2
    tree, want = RadixTree(), defaultdict(list)
    for v, k in enumerate(keys):
        tree.insert(k, v)
        for d in range(0, len(k) + 1, 2):
            want[k[:d]].append(v)
    ends = defaultdict(list)
    for v, k in enumerate(keys):
        ends[k].append(v)
    got = {k: (n, least, sorted(e)) for k, n, least, e in tree.aligned(2)}
    assert got == {k: (len(v), min(v), ends.get(k, []))
                   for k, v in want.items()}
    # layouts grew with the children
    assert type(tree.root.edges).__name__ == "Full"
    assert type(tree.root.edges.get(9).edges).__name__ in ("Full", "Sorted")
