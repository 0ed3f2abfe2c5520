"""What an executor holds at once does not grow with Spark's batches."""

import numpy as np
import pyarrow as pa
import pytest

from paysift.llm import (cotrain, fm_dedup, graph, hilbert_pack,
                         minhash_forest)
from paysift.llm.words import chunks, sliced
from paysift.session import bound_batches

TEXTS = [f"word{i} " * 700 for i in range(1000)]  # about 6 MB
LIMIT = 2 << 20


class Frame:
    """Keeps the function that would run on the executors."""

    columns = ["doc_id", "text"]

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        self.work = work
        return self


def batches(kind, *more):
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(TEXTS)), pa.int64()), *more,
         pa.array(TEXTS).cast(kind)],
        names=[f"c{i}" for i in range(2 + len(more))])


def recorder(monkeypatch, module, name, seen):
    inner = getattr(module, name)

    def watch(texts, *a):
        seen.append(sum(map(len, texts)))
        return inner(texts, *a)
    monkeypatch.setattr(module, name, watch)


def test_signatures_take_slices(spark, monkeypatch):
    seen, frame = [], Frame()
    recorder(monkeypatch, minhash_forest, "shingle_sets", seen)
    minhash_forest.signatures(frame, "doc_id", "text", 5, 12, 11)
    out = list(frame.work(batches(pa.binary())))
    assert [k for b in out for k in b.column(0).to_pylist()] == \
        list(range(len(TEXTS)))
    assert sum(seen) == sum(map(len, TEXTS)) and max(seen) < LIMIT


def test_segments_take_slices(monkeypatch):
    seen, frame = [], Frame()
    inner = fm_dedup._texts
    monkeypatch.setattr(fm_dedup, "_texts", lambda c: seen.append(
        sum(map(len, inner(c)))) or inner(c))
    fm_dedup.segments(frame, 20, 5)
    who = pa.array(np.arange(len(TEXTS)))
    assert sum(b.num_rows for b in frame.work(batches(pa.binary(), who)))
    assert sum(seen) == sum(map(len, TEXTS)) and max(seen) < LIMIT


def test_scores_take_slices(spark, monkeypatch):
    seen = []
    recorder(monkeypatch, cotrain, "text_view", seen)
    monkeypatch.setattr(cotrain, "meta_view", lambda b, m: None)

    class Model:
        def score(self, words, shape, meta):
            return [np.ones(len(words))] * 3
    monkeypatch.setattr(cotrain, "fit_quality", lambda *a: Model())
    docs = spark.createDataFrame([], "doc_id long, text string")
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow",
                        lambda self, work, shape: held.append(work))
    cotrain.quality_scores(docs, docs, meta=())
    out = list(held[0](batches(pa.string())))
    assert sum(b.num_rows for b in out) == len(TEXTS)
    assert sum(seen) == sum(map(len, TEXTS)) and max(seen) < LIMIT


def test_hashing_takes_quarter_megabytes():
    raw = [t.encode() for t in TEXTS]
    ranges = list(chunks(raw))
    assert [i for lo, hi in ranges for i in range(lo, hi)] == \
        list(range(len(raw)))
    assert max(sum(map(len, raw[lo:hi])) for lo, hi in ranges) <= 1 << 18


def test_slices_keep_every_row():
    rows = [None, "", "x" * (3 << 20), "a", None, "b" * (1 << 20), "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])
    got = list(sliced([batch, batch.slice(0, 0), batch.slice(2)], 0))
    assert [x for b in got for x in b.column(0).to_pylist()] == \
        rows + rows[2:]
    assert all(b.num_rows for b in got)


@pytest.fixture
def batch_setting(spark):
    """The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    yield name
    spark.conf.set(name, before)


def test_batches_are_bounded(spark, batch_setting):
    spark.conf.set(batch_setting, str(64 << 20))
    docs = spark.range(0, 3000, 1, 1).selectExpr(
        "id as doc_id", "repeat(cast(id as string), 1200) as text",
        "'en' as lang", "'a' as source", "1L as n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def sizes(rows):
        for b in rows:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})
    cotrain.quality_scores(docs, labels)
    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and max(found) < 6 << 20
    spark.conf.set(batch_setting, str(1 << 20))
    bound_batches(spark)  # a smaller setting stays
    assert int(spark.conf.get(batch_setting)) == 1 << 20


def test_small_tables_need_no_python_workers(spark):
    rows = spark.range(100).selectExpr("id as row", "id % 7 as n")
    got = hilbert_pack.stream_offsets(rows, ["row"], "row", "n")
    assert "LocalTableScan" in \
        got._jdf.queryExecution().executedPlan().toString()
    ends = np.cumsum([i % 7 for i in range(100)])
    assert {r.row: r.before for r in got.collect()} == {
        i: int(ends[i]) - i % 7 for i in range(100)}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """A file of a local checkpoint folder costs its executor processes."""
    files = []

    def pin(df):
        out = df.checkpoint(eager=True)
        files.append(out.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(graph, "pin", pin)
    names = {"spark.sql.shuffle.partitions": "40",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        # chains of 10
        links = spark.range(300).filter("id % 10 < 9") \
            .selectExpr("id as a", "id + 1 as b")
        got = {r.node: r.component for r in graph.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(300)}
    cores = spark.sparkContext.defaultParallelism
    assert cores < 40 and max(files[1:]) <= cores
