"""Near-duplicates, repeated sequences, embeddings against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.llm import minhash_forest
from paysift.llm.embed_passes import near_vectors
from paysift.llm.fm_dedup import repeated_starts, strip_repeats
from paysift.llm.graph import components
from paysift.llm.minhash_forest import near_duplicates
from tests.conftest import SMALL
from tests.llm import cases


def documents(spark, path=SMALL):
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    docs = documents(spark, SMALL.replace("0.001", "0.01"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = cases.near_groups(texts, k)
    got = near_duplicates(docs, shingle=k).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == want
    for r in got:
        assert r.n_shingles == len(cases.shingles(texts[r.doc_id], k))
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_a_large_group(spark):
    """A chain of near copies of one text, none an exact copy."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        w[i % 200] = f"x{i}"
        w[(i * 7) % 200] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{i}q{j}" for j in range(60)))
             for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
        .collect()}
    assert got == cases.near_groups(dict(rows), 2)


def star(n, changed, seed):
    """Copies of one text, similar to it but not to each other; the text
    itself has the largest id."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(301)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in rng.choice(np.arange(1, 300, 2), changed, replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    return rows + [(n, " ".join(base))]


@pytest.mark.parametrize("changed", [10, 14])
def test_near_duplicates_of_a_star(spark, changed):
    """Every copy reaches the others through the largest id."""
    rows = star(400, changed, 3)
    want = cases.near_groups(dict(rows), 2)
    assert set(want.values()) == {0}
    got = {r.doc_id: r.component_id for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle=2,
        block=64).collect()}
    assert got == want


def test_crowded_rows_are_dealt_once_a_tree(spark, monkeypatch):
    """Runs within crowded runs are not dealt, nor the rows of signatures
    again for their full sets."""
    dealt, calls = minhash_forest.dealt, []

    def counted(rows, block):
        calls.append(max(r["count"] for r in
                         rows.groupBy("id").count().collect()))
        return dealt(rows, block)
    monkeypatch.setattr(minhash_forest, "dealt", counted)
    rows = star(60, 14, 3)
    got = {r.doc_id: r.component_id for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle=2,
        window=4).collect()}
    assert got == cases.near_groups(dict(rows), 2)
    assert len(calls) == 1 and calls[0] <= 20


def test_near_duplicates_awkward_rows(spark):
    got = near_duplicates(cases.awkward(spark), shingle=2).collect()
    assert len(got) == 15
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == \
            (0, i, True)
    assert by[5].component_id == by[7].component_id == 5
    assert by[6].component_id == 5 and not by[6].kept
    assert by[9].component_id == 8
    assert by[4].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_repeats_match_brute_force(spark):
    docs = documents(spark, SMALL.replace("0.001", "0.01"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = cases.repeats(texts)
    starts = repeated_starts(docs, hot=30, shard_words=20_000)
    got = strip_repeats(docs, starts, digest=True).collect()
    assert len(got) == len(texts)
    text = dict(texts)
    for r in got:
        flags = want[r.doc_id]
        left = [w for w, f in zip(cases.words(text[r.doc_id]), flags)
                if not f]
        assert (r.n_words, r.n_removed) == (len(flags), sum(flags))
        assert r.kept_sha256 == hashlib.sha256(
            " ".join(left).encode()).hexdigest()


def test_repeats_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = {r.doc_id: r for r in strip_repeats(
        docs, repeated_starts(docs)).collect()}
    assert got[1].text is None and got[1].n_words == 0
    assert got[5].n_removed == 0
    assert (got[6].n_removed, got[6].text) == (40, "Intro words tail")
    assert (got[7].n_removed, got[7].text) == (40, "")
    assert got[8].n_removed == 0 and got[8].n_words == 30_000
    # 30,000 words with a period of 30,907: only the other text repeats
    assert (got[9].n_removed, got[9].text) == (30_000, "end")
    assert got[13].n_removed == 49  # all windows but the first
    assert got[None].n_removed == 0
    none = cases.empty(spark)
    assert strip_repeats(none, repeated_starts(none)).count() == 0


def removed(spark, rows):
    """(key, text) -> words lost, for the distinct rows."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {}
    for r in docs.withColumnRenamed("text", "t").withColumn(
            "text", F.col("t")).transform(lambda d: strip_repeats(
                d, repeated_starts(d))).collect():
        assert out.setdefault((r.doc_id, r.t), r.n_removed) == r.n_removed
    return out


def test_repeats_of_rows_that_share_a_key(spark):
    """What repeats in one row says nothing about another of its key."""
    p = " ".join(f"p{i}" for i in range(40))
    twice = p + " " + p
    q = " ".join(f"q{i}" for i in range(70))
    assert removed(spark, [(None, twice), (None, q)]) == {
        (None, twice): 40, (None, q): 0}
    assert removed(spark, [(1, p), (5, p), (5, q)]) == {
        (1, p): 0, (5, p): 40, (5, q): 0}
    # equal rows are one document, also without a key
    assert removed(spark, [(None, p), (None, p), (5, p), (5, p), (6, p)]) \
        == {(None, p): 0, (5, p): 40, (6, p): 40}


def test_repeats_of_many_rows_without_a_key(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{p} " + " ".join(f"u{i}x{j}" for j in range(25)))
            for i in range(150)] + [(None, f"{p} tail")] * 60
    got = removed(spark, rows)
    # one of the texts keeps the passage, the others lose it
    assert sorted(got.values()) == [0] + [30] * 150


def test_repeats_hot_and_plain_routes_agree(spark):
    base = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} c{i} {base} d{i} e{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted(map(tuple, strip_repeats(
        docs, repeated_starts(docs, hot=h), digest=True).collect()))
        for h in (5, 10_000)]
    assert out[0] == out[1]
    want = cases.repeats(rows)
    assert {r[0]: r[2] for r in out[0]} == {
        d: sum(f) for d, f in want.items()}


def brute_vectors(rows):
    ok = [(k, x, v) for k, x, v in rows if x is not None and v and
          all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = []
    for i, (a, la, va) in enumerate(ok):
        for b, lb, vb in ok[i + 1:]:
            if la == lb and len(va) == len(vb):
                p, q = np.array(va, float), np.array(vb, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links.append((a, b))
    n = {k: 0 for k, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, cases.components([k for k, _, _ in rows], links)


def test_vectors_match_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in df.collect()]
    n, comp = brute_vectors(rows)
    got = near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        k: (n[k], comp[k]) for k in n}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_a_dense_group_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, 1, (base + 0.12 * rng.standard_normal(16)).tolist())
            for i in range(200)]
    rows += [(300 + i, i % 3, rng.standard_normal(16).tolist())
             for i in range(60)]
    rows += [(500, 1, None), (501, 1, []), (502, 1, [0.0] * 16),
             (503, 1, [float("nan")] + [1.0] * 15), (504, 1, [None] * 16),
             (505, None, rows[0][2]), (506, 1, rows[0][2]),
             (507, 1, [2 * x for x in rows[0][2]]), (508, 2, rows[0][2]),
             (509, 1, [1.0, 2.0])]
    df = spark.createDataFrame(
        rows, "vec_id long, label int, embedding array<double>") \
        .withColumns({c: F.lit(1) for c in ("id", "key", "m", "kept")})
    n, comp = brute_vectors(rows)
    got = near_vectors(df, window=4, block=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        k: (n[k], comp[k]) for k in n}
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_a_star(spark):
    """500 vectors near the one with the largest id, in a large label."""
    rng = np.random.default_rng(6)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    side = rng.standard_normal((500, 64))
    side = unit(side - np.outer(side @ centre, centre))
    leaves = 0.94 * centre + (1 - 0.94 ** 2) ** 0.5 * side
    vecs = np.concatenate((leaves, unit(rng.standard_normal((1500, 64))),
                           centre[None, :]))
    links = np.argwhere(np.triu(unit(vecs) @ unit(vecs).T >= 0.93, 1))
    want = cases.components(range(len(vecs)), links.tolist())
    assert sum(c == 0 for c in want.values()) == 501
    n = np.bincount(links.ravel(), minlength=len(vecs))
    got = near_vectors(spark.createDataFrame(
        [(i, 1, v.tolist()) for i, v in enumerate(vecs)],
        "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        k: (n[k], want[k]) for k in want}


@pytest.mark.parametrize("parts", [1, 8, 200, 400])
def test_vectors_meet_across_short_partitions(spark, parts):
    """A star of 31 vectors, whatever the number of range partitions."""
    rng = np.random.default_rng(11)
    centre = np.eye(32)[0]
    rows = [(0, 1, centre.tolist())]
    for i in range(1, 31):
        v = np.zeros(32)
        v[0], v[i] = 0.95, (1 - 0.95 ** 2) ** 0.5
        rows.append((i, 1, v.tolist()))
    rows += [(100 + i, 1, (rng.standard_normal(32)).tolist())
             for i in range(20)]
    n, comp = brute_vectors(rows)
    assert n[0] == 30 and n[1] == 1
    df = spark.createDataFrame(
        rows, "vec_id long, label int, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = near_vectors(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        k: (n[k], comp[k]) for k in n}


def test_vectors_at_the_threshold_and_of_extreme_size(spark):
    """Pairs at exactly 0.93 are decided alike by every step, and lengths
    beyond the range of squares do not matter."""
    side = (1 - 0.93 ** 2) ** 0.5
    rows = [(0, 1, [1.0, 0.0, 0.0]), (1, 1, [0.93, side, 0.0]),
            (2, 1, [0.93, -side, 0.0]), (3, 1, [0.93, 0.0, side]),
            (4, 2, [1e300, 1e300, 0.0]), (5, 2, [1e-300, 1e-300, 1e-301]),
            (6, 2, [0.0, 0.0, 1e308])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(
        rows, "vec_id long, label int, embedding array<double>")).collect()}
    linked = [i for i in (1, 2, 3) if got[i].component_id == 0]
    assert got[0].n_links == len(linked)
    assert [got[i].n_links for i in (1, 2, 3)] == \
        [int(i in linked) for i in (1, 2, 3)]
    assert got[4].component_id == got[5].component_id == 4
    assert (got[4].n_links, got[5].n_links, got[6].n_links) == (1, 1, 0)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + \
        [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)},
                   **{i: 100 for i in range(100, 160)}}
