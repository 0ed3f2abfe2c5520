"""Top-k inner products against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.llm.bit_slices import SlicedBlock, top_inner_products

_VEC = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, k=10, scale=1024):
    good = [(r, key, [math.floor(scale * x) for x in v])
            for r, (key, v, *_) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x)
                                     for x in v)]
    good = [g for g in good if len(g[2]) * max(
        [abs(x) for x in g[2]], default=0) ** 2 < 2 ** 57]
    out = []
    for r, key, q in good:
        if key is None or key % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), o is not None,
                       o or 0, o) for s, o, v in good
                      if s != r and len(v) == len(q))
        out += [(key, i + 1, b[3], -b[0]) for i, b in enumerate(best[:k])]
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select(
        "query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [16, 100, 1 << 15])
def test_top_k_matches_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(i), (rng.standard_normal(12) / 4).tolist(), 0)
            for i in rng.permutation(900)]
    got = top_inner_products(spark.createDataFrame(rows, _VEC), block=block)
    assert _rows(got) == brute(rows)


def test_top_k_of_ties_and_copies(spark):
    """A third of the vectors are one vector; scores tie throughout."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), 0)
            for i in range(200)]
    rows += [(i, [1.0, 2.0, -1.0, 0.5], 0) for i in range(200, 400)]
    rows += [(i, [0.0, 0.0, 0.0, 0.0], 0) for i in range(400, 501)]
    got = top_inner_products(spark.createDataFrame(rows, _VEC), block=64)
    assert _rows(got) == brute(rows)


def test_top_k_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [0.5, -3.0], None),
            (None, [5.0, 5.0], 1), (1, None, 1), (2, [], 1), (200, [], 1),
            (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1),
            (300, [1.0, 2.0, 3.0], 1), (6, [1e300, 1.0], 1),
            (7, [-1e5, 1e5], 1), (8, [1e-9, -1e-9], 1), (-100, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, _VEC).withColumns(
        {c: F.lit("clash") for c in ("row", "key", "dim", "v", "block",
                                     "score", "rank")})
    got = _rows(top_inner_products(df))
    assert got == brute(rows)
    assert (0, 2, None, 15 * 1024 * 1024) in got
    assert top_inner_products(spark.createDataFrame([], _VEC)).collect() == []


def test_sliced_scores_equal_products():
    rng = np.random.default_rng(8)
    v = rng.integers(-700, 500, (333, 9))
    block = SlicedBlock.of(v)
    for _ in range(20):
        q = rng.integers(-600, 600, 9)
        at, score = block.top(q, 400)
        want = v @ q
        assert sorted(at.tolist()) == list(range(333))
        assert (want[at] == score).all()
        at, score = block.top(q, 10, but=int(want.argmax()))
        order = [i for i in np.lexsort((np.arange(333), -want))
                 if i != want.argmax()][:10]
        assert sorted(at.tolist()) == sorted(order)
