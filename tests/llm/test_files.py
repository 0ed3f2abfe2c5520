"""Packing, token files, sharding, mixing and quality rules."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paysift.llm.bpe import Codes, Encoder
from paysift.llm.hilbert_pack import hilbert_key, pack_along_curve
from paysift.llm.hyper_shard import communication_matrix, shuffle_into_shards
from paysift.llm import queries
from paysift.llm.llr_quality import llr_quality
from paysift.llm.systematic_mix import mix_sources
from paysift.llm.token_shards import Shard, read_shards, write_shards
from paysift.llm.wavelet import FMIndex, WaveletMatrix
from paysift.llm.words import hashed_words, n_words
from tests.conftest import SMALL
from tests.llm import cases

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---- words -------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_hashed_words_follow_the_words(texts):
    h, first = hashed_words([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        own = [w.encode() for w in cases.words(t)]
        got = h[first[i]:first[i + 1]].tolist()
        assert len(own) == len(got)
        for w, x in zip(own, got):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# ---- wavelet matrix and FM-index ---------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300))
def test_wavelet_matrix_answers(values):
    v = np.array(values)
    w = WaveletMatrix.from_bytes(WaveletMatrix.of(v, 6).to_bytes())
    assert w.decode().tolist() == values
    assert w.access(np.arange(len(v))).tolist() == values
    for s in set(values) | {41}:
        ranks = w.rank(np.full(len(v) + 1, s), np.arange(len(v) + 1))
        assert ranks.tolist() == [0, *np.cumsum(v == s).tolist()]
        k = int((v == s).sum())
        assert w.select(np.full(k, s), np.arange(k)).tolist() == \
            np.flatnonzero(v == s).tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60),
       st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_matching_statistics(text, query):
    codes = np.array([0, *text, 0])
    index = FMIndex(codes, 8)
    q = np.array([0 if x == 4 else x for x in query])
    ends = np.arange(1, len(q) + 1)
    length, lo, hi = index.matching(q, ends, 8)
    for e, n, a, b in zip(ends, length, lo, hi):
        def count(k):
            p = q[e - k:e].tolist()
            return sum(codes[i:i + k].tolist() == p
                       for i in range(len(codes) - k + 1))
        best = max(k for k in range(min(8, e) + 1) if k == 0 or (
            0 not in q[e - k:e] and count(k)))
        assert n == best
        if n:
            assert b - a == count(n)


# ---- tokens --------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab C.!'sTRE12éÉß×º²İΣ \n\t\r\x0b\x1c\x85 　"
                        "é中🙂<|>endoftext", max_size=40), max_size=4))
def test_cached_encoding_equals_the_library(texts):
    texts.append("a <|endoftext|> b<|startoftext|>")
    for path, keep in ((BYTES, True), (WORDS, False)):
        enc = _encoder(path, keep)
        for t, ids in zip(texts, enc.encode(texts)):
            want = enc.whole.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want + [9]


def test_a_word_is_learnt_once_whatever_signs_touch_it(monkeypatch):
    learnt = []

    def learn(self, hashes, pieces, *rest):
        learnt.extend(pieces)
        return known(self, hashes, pieces, *rest)
    known = Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", learn)
    texts = ["(word word, word. \"word\" word: word) word; word!"]
    for path, keep, most in ((BYTES, True, 2), (WORDS, False, 1)):
        learnt.clear()
        enc = Encoder(path, 9, keep)
        got = np.frombuffer(enc.encode(texts)[0], "<u4").tolist()
        assert got == _ids(path, texts[0], 9)
        assert sum("word" in p for p in learnt) == most


def test_encoding_with_caches_that_overflow():
    texts = ["It's a small TEST of 2 caches.", "caf\u00e9 isn't a 10 TEST"]
    for path, keep in ((BYTES, True), (WORDS, False)):
        enc = Encoder(path, 9, keep, cached=2)
        for _ in range(3):
            for t in texts:
                assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == \
                    _ids(path, t, 9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=80,
                unique=True), st.integers(1, 40))
def test_codes_number_hashes_in_order(hashes, step):
    # few low bits, so that places collide; 0 marks a free place
    hashes = list(dict.fromkeys(h & ~0xFF | 2 for h in hashes)) + [0]
    codes = Codes(4)
    for i in range(0, len(hashes), step):
        codes.add(np.array(hashes[i:i + step]))
    assert codes.n == len(hashes)
    assert codes.find(np.array(hashes)).tolist() == list(range(len(hashes)))
    assert codes.find(np.array([5, 7])).tolist() == [-1, -1]


_ENC = {}


def _encoder(path, keep):
    if path not in _ENC:
        _ENC[path] = Encoder(path, 9, keep)
    return _ENC[path]


def _ids(path, text, end):
    return Tokenizer.from_file(path).encode(
        text or "", add_special_tokens=False).ids + [end]


def check_packing(rows, got):
    tok = Tokenizer.from_file(BYTES)
    want = Counter()
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[k, tuple(ids)] += 1
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(r)
    ids_of = {k: i for k, i in want}
    total = sum(len(i) * n for (_, i), n in want.items())
    assert sum(r.length for r in got) == total
    for r in got:
        ids = ids_of[r.doc_id]
        piece = ids[r.start:r.start + r.length]
        assert r.ids_crc32 == cases.crc(piece)
        assert r.doc_tokens == len(ids) and len(piece) == r.length
        assert r.offset + r.length <= 2048
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, pieces in seqs.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or s == len(seqs) - 1


def test_packing_whole_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, pack_along_curve(docs, BYTES).collect())


def test_packing_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, pack_along_curve(docs, BYTES).collect())
    assert pack_along_curve(cases.empty(spark), BYTES).count() == 0
    r = pack_along_curve(docs.filter("doc_id = 4"), BYTES,
                         with_ids=True).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == _ids(BYTES, "one", 1)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims,
                                    indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_key(grid, bits)
        assert sorted(key) == list(range(side ** dims))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_token_files_round_trip(spark, tmp_path):
    for name, docs in (("a", documents(spark)),
                       ("b", cases.awkward(spark)),
                       ("c", cases.empty(spark))):
        path = str(tmp_path / name)
        write_shards(docs, path, WORDS, shard_tokens=3000)
        got = sorted(read_shards(spark, path).collect(),
                     key=lambda r: r.start)
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()),
                      key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in got] == [k for k, _ in rows]
        at = 0
        for r, (_, t) in zip(got, rows):
            ids = _ids(WORDS, t, 2)
            assert (r.start, r.n_tokens, r.ids_crc32) == \
                (at, len(ids), cases.crc(ids))
            at += len(ids)
        files = spark.read.parquet(path).orderBy("part", "shard") \
            .limit(1).collect()
        if files:
            s = Shard(files[0].data)
            ids = s.matrix.decode().tolist()
            assert s.tokens(0).tolist() == ids[:int(s.lengths[0])]
            assert s.count(2) == ids.count(2)
            assert s.places(2).tolist() == [
                i for i, x in enumerate(ids) if x == 2]


# ---- shards -----------------------------------------------------------
def test_matrix_has_exact_margins():
    m = communication_matrix([5, 0, 17, 900, 31], 16, 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 900, 31]
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_shards_are_even_and_slots_gapless(spark):
    for docs in (documents(spark), cases.awkward(spark)):
        out = shuffle_into_shards(docs, block_rows=7)
        assert out.columns == [c for c in docs.columns if c not in (
            "shard", "slot")] + ["shard", "slot"]
        got = out.collect()
        assert Counter(r.doc_id for r in got) == Counter(
            r.doc_id for r in docs.collect())
        per = Counter(r.shard for r in got)
        sizes = [per.get(s, 0) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
        for s in per:
            assert sorted(r.slot for r in got if r.shard == s) == \
                list(range(per[s]))
    assert shuffle_into_shards(cases.empty(spark)).count() == 0


def test_shuffle_looks_uniform(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = shuffle_into_shards(rows, shards=4, block_rows=100).collect()
    x = np.array([(r.doc_id, r.shard * 1000 + r.slot) for r in got])
    assert abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.06


# ---- mixing -----------------------------------------------------------
def targets(sizes: dict, cap=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: cap * sizes[s] if s in capped else rest * weight[s] / w
               for s in names}
        over = {s for s in names if s not in capped
                and out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix_meets_targets(spark):
    for docs in (documents(spark), cases.awkward(spark)):
        sized = docs.withColumn("size", n_words(F.col("text")))
        got = mix_sources(sized).collect()
        assert len(got) == sized.count()
        sizes: dict = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r["size"]
            assert 0 <= r.copies <= 3
        want = targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source]
            assert math.isclose(r.target, want[r.source], abs_tol=1e-6)
        for s in sizes:
            taken = sum(r.copies * r["size"] for r in got if r.source == s)
            big = max(r["size"] for r in got if r.source == s)
            assert abs(taken - want[s]) <= 2 * big
        again = mix_sources(sized.repartition(5)).collect()
        assert sorted((str(r.doc_id), r.copies) for r in again) == \
            sorted((str(r.doc_id), r.copies) for r in got)
    none = cases.empty(spark).withColumn("size", F.lit(0).cast("long"))
    assert mix_sources(none).count() == 0


# ---- quality rules ----------------------------------------------------
def repeat_words(w, k=8):
    runs = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    flag = [False] * len(w)
    for i in range(len(w) - k + 1):
        if runs[tuple(w[i:i + k])] > 1:
            flag[i:i + k] = [True] * k
    return sum(flag)


def test_quality_rules_match_brute_force(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for docs in (documents(spark), cases.awkward(spark)):
        rows = docs.collect()
        got = llr_quality(docs, labels).collect()
        assert len(got) == len(rows)
        want = Counter()
        for r in rows:
            w = cases.words(r.text)
            lines = [x for x in (r.text or "").split("\n")
                     if cases.words(x)]
            n = repeat_words(w)
            want[(r.doc_id, len(w), sum(map(len, w)),
                  sum(c in "#*$%&|<>" for c in r.text or ""),
                  len(lines) - len(set(lines)), n,
                  len(w) < 20 or 100 * n > 30 * len(w))] += 1
        assert Counter(tuple(r)[:6] + (r.base_failed,) for r in got) == want
        for r in got:
            assert r.kept == (not r.base_failed and r.llr >= -0.4)
    assert llr_quality(cases.empty(spark), labels).count() == 0


def test_llr_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame(
        [(1, "a a b"), (2, "a c"), (3, "c c c")],
        "doc_id long, text string")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, 1, 1), (3, None, None), (None, 1, 0)],
        "doc_id long, quality int, toxic int")
    b = 1 << 14
    raw, good = {"a": 3, "b": 1, "c": 4}, {"a": 2, "b": 1, "c": 0}
    ratio = {w: math.log((good[w] + 1) / (3 + b))
             - math.log((raw[w] + 1) / (8 + b)) for w in raw}
    got = {r.doc_id: r.llr for r in llr_quality(docs, labels).collect()}
    for d, t in ((1, "aab"), (2, "ac"), (3, "ccc")):
        assert math.isclose(got[d], sum(ratio[w] for w in t) / len(t),
                            rel_tol=1e-5)
    bare = labels.filter("false")
    assert {r.llr for r in llr_quality(docs, bare).collect()} == {0.0}


def test_llr_counts_word_pairs(spark, tmp_path):
    """Words and word pairs share the buckets; the query counts both, so
    trusted words in another order score lower."""
    texts = {1: "a b c d", 2: "d c b a", 3: "z z", 4: "q", 5: None}
    docs = spark.createDataFrame(list(texts.items()),
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    b = 1 << 16
    grams = {d: [*cases.words(t), *zip(cases.words(t), cases.words(t)[1:])]
             for d, t in texts.items()}
    raw = Counter(g for own in grams.values() for g in own)
    good = Counter(grams[1])
    ratio = {g: math.log((good[g] + 1) / (good.total() + b))
             - math.log((raw[g] + 1) / (raw.total() + b)) for g in raw}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    query = queries.QUERIES["op4_quality_llr"](spark, str(tmp_path))
    for rows in (llr_quality(docs, labels, buckets=b, order=2), query):
        got = {r.doc_id: r.llr for r in rows.collect()}
        for d, own in grams.items():
            want = sum(ratio[g] for g in own) / len(own) if own else 0.0
            assert math.isclose(got[d], want, rel_tol=1e-4, abs_tol=1e-9)
        assert got[1] > got[2]


def test_crc_of_nothing():
    assert zlib.crc32(b"") == 0


def test_batches_are_cut_into_bounded_slices(spark):
    """What packing turns into Python objects at once is bounded by the
    bytes of the texts, not by the batch; no row is lost or moved."""
    from paysift.llm.words import slices
    texts = [None, "", "ab" * 30, None, *["äb"] * 50, "x" * 500, ""]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = list(slices(batch, 1, 60))
    assert sum((p.to_pylist() for p in parts), []) == batch.to_pylist()
    assert len(parts) > 3
    for p in parts:
        sizes = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert sum(sizes) - max(sizes) <= 60
    assert list(slices(batch.slice(0, 0), 1)) == []
    assert len(list(slices(batch.slice(0, 2), 1))) == 1
