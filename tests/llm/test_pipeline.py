"""The pipeline: its stages one after the other, and as a whole."""

import numpy as np

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import cases
from tests.llm.test_files import check_packing


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "substring dedup",
        "mixing", "packing"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(
        f"{SMALL}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, SMALL)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, r in labels.items() if r.quality and not r.toxic]
    assert np.mean([d in kept for d in clean]) >= 0.95

    one = stages[1](spark, good, SMALL)
    assert one.columns == columns
    groups = cases.near_groups({d: start[d] for d in kept}, 5)
    rows = one.collect()
    assert {r.doc_id for r in rows} == set(groups.values())

    cut = stages[2](spark, one, SMALL)
    assert cut.columns == columns
    flags = cases.repeats([(r.doc_id, r.text) for r in rows])
    want = {}
    for r in rows:
        left = [w for w, f in zip(cases.words(r.text), flags[r.doc_id])
                if not f]
        if not any(flags[r.doc_id]):
            want[r.doc_id] = r.text
        elif left:
            want[r.doc_id] = " ".join(left)
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == want

    mixed = stages[3](spark, cut, SMALL)
    assert mixed.columns == columns
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    assert set(rows) <= set(want.items())
    check_packing(rows, stages[4](spark, mixed, SMALL).collect())


def test_stages_on_awkward_rows(spark):
    for docs in (cases.awkward(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs.count()


def test_run_is_the_chain(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32",
                           "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 100
