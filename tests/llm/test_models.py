"""The trained models: gradients, held-out accuracy, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.llm.byte_gru import BiGru, Reader, identify_languages
from paysift.llm.byte_gru import has_letter, letter_runs
from paysift.llm.cotrain import fit_logistic, platt, quality_scores
from paysift.llm.cotrain import telling_words
from tests.conftest import SMALL
from tests.llm import cases

LARGER = SMALL.replace("0.001", "0.01")


def test_gru_gradients():
    model = BiGru(3, hidden=4, seed=1)
    model.params = {k: v.astype(np.float64)
                    for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (5, 4)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    _, grads = model.loss_and_grads(x, y)
    for k, g in grads.items():
        p = model.params[k]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if k[0] == "g":
                at = (int(x[0, 0]), at[1])
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = model.loss_and_grads(x, y)[0]
            p[at] = old - eps
            down = model.loss_and_grads(x, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps),
                                          rel=2e-2, abs=1e-5)


def test_reader_pools_every_position():
    model = BiGru(2, seed=4)
    words = letter_runs("Abc de, abc " + "x" * 60)
    assert [len(w) for w in words] == [3, 2, 3, 24, 24, 12]
    p = np.concatenate([model.probabilities(
        np.frombuffer(w, np.uint8)[None])[0] for w in words])
    for cached in (1 << 10, 2):
        got = Reader(model, 2, cached).pooled([words, []])
        assert np.allclose(got[0], p.mean(axis=0), atol=1e-5)
        assert got[1].tolist() == [0, 0]


def test_letters_are_unicode_letters():
    assert [has_letter(t) for t in (None, "", "12 _!", "²Ⅷ", "a", "é",
                                    "中")] == [
        False, False, False, False, True, True, True]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = identify_languages(docs).collect()
    assert len(got) == len(lang)
    test = [r for r in got if r.held_out]
    assert 250 < len(test) < 420
    right = sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test)
    assert right >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_awkward_rows(spark):
    rows = identify_languages(cases.awkward(spark).drop("score"), steps=5) \
        .collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 15
    for i in (1, 2, 3, 12):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[10].lang_pred in ("de", "en", "es", "fr")
    assert not got[None].held_out
    assert identify_languages(cases.empty(spark)).count() == 0
    bare = cases.awkward(spark).withColumn(
        "lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(bare).collect()} == \
        {"und"}


def test_logistic_and_calibration():
    rng = np.random.default_rng(2)
    x = np.column_stack((rng.standard_normal((400, 2)), np.ones(400)))
    y = (x @ [2.0, -1.0, 0.5] + rng.logistic(size=400) > 0).astype(float)
    w = fit_logistic(x, y, np.ones(400), ridge=1e-6)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.allclose(x.T @ (p - y), 0, atol=1e-3)
    a, b = platt(3 * (x @ w), y)
    assert a == pytest.approx(1 / 3, rel=0.05) and abs(b) < 0.05


def test_telling_words_are_found():
    words = [np.array([1, 2 + i % 7, 99], dtype=np.uint64) if i % 2 else
             np.array([1, 2 + i % 7], dtype=np.uint64) for i in range(60)]
    y = np.array([float(i % 2) for i in range(60)])
    assert telling_words(words, y, 5.0, 10).tolist() == [99]


def test_quality_on_labels(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    # learn from one half of the labels, judge on the other
    half = labels.filter(F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.kept for r in quality_scores(docs, half).collect()}
    rest = labels.filter((F.col("doc_id") % 2 == 1)).collect()
    good = [got[r.doc_id] for r in rest if r.quality == 1 and not r.toxic]
    bad = [got[r.doc_id] for r in rest if r.quality == 0]
    assert np.mean(good) >= 0.97
    assert np.mean(bad) <= 0.1


def test_quality_awkward_rows(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (4, 0, 0), (5, 1, 0), (6, 1, 1), (7, None, 0),
         (None, 1, 0), (8, 1, None), (8, 0, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels, carry=True)
    assert got.columns == [c for c in docs.columns if c not in (
        "p_text", "p_meta", "score", "kept")] + [
        "p_text", "p_meta", "score", "kept"]
    assert got.count() == 15
    one = quality_scores(docs, labels.filter("quality = 1"))
    assert {(r.score, r.kept) for r in one.collect()} <= {
        (1.0, True)} or one.count() == 15
    bare = quality_scores(docs, labels.filter("false")).collect()
    assert {(r.score, r.kept) for r in bare} == {(1.0, True)}
    assert quality_scores(cases.empty(spark), labels).count() == 0
