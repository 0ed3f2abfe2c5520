import math

import pytest
from pyspark.sql import functions as F

from paysift.operators import clean as C
from paysift.operators import profile as PR


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(
        [("a", 1.0, None), ("b", None, None), ("c", float("nan"), None),
         ("d", 5.0, None)], "k string, x double, e string")


def test_null_profile_counts_null_not_nan(nulls):
    got = {r.column_name: (r.n_null, r.n_rows)
           for r in PR.null_profile(nulls).collect()}
    assert got == {"k": (0, 4), "x": (1, 4), "e": (4, 4)}


def test_drop_empty_columns(nulls):
    assert C.drop_empty_columns(nulls).columns == ["k", "x"]
    assert C.drop_columns(nulls, ["e", "missing"]).columns == ["k", "x"]


def test_impute_mean_treats_nan_and_null_as_missing(nulls):
    out, model = C.impute_mean(nulls, ["x"])
    vals = {r.k: r.x_imputed for r in out.collect()}
    assert vals == {"a": 1.0, "b": 3.0, "c": 3.0, "d": 5.0}
    assert "x" not in out.columns
    # Idempotent: imputing the repaired column changes nothing.
    again, _ = C.impute_mean(out, ["x_imputed"], suffix="_2")
    assert {r.k: r.x_imputed_2 for r in again.collect()} == vals


def test_summary_skips_nan(nulls):
    r = PR.summary(nulls, ["x"]).first()
    assert (r.n, r.mean, r.min_value, r.max_value) == (2, 3.0, 1.0, 5.0)
    assert math.isclose(r.stddev, math.sqrt(8.0))


def test_bad_numbers_cast_and_cap(spark):
    df = spark.createDataFrame([("100",), ("250000.5",), ("1500000",),
                                ("x",), (None,)], "v string")
    vals = [r.v for r in C.cast_double(df, ["v"]).collect()]
    assert vals == [100.0, 250000.5, 1500000.0, None, None]
    kept = sorted(r.v for r in C.cap(df, "v", 1000000).collect())
    assert kept == ["100", "250000.5"]


def test_value_counts_null_group_is_zero(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)],
                               "c string")
    rows = [(r.value, r.n) for r in PR.value_counts(df, "c").collect()]
    assert rows == [("a", 2), ("b", 1), (None, 0)]


def test_modes_tie_to_smallest_and_fill(spark):
    df = spark.createDataFrame([("L3",), ("L2",), ("L3",), ("L2",), (None,)],
                               "s string")
    out, learned = C.fill_mode(df, ["s"])
    assert learned == {"s": "L2"}
    assert sorted(r.s for r in out.collect()) == ["L2", "L2", "L2", "L3",
                                                  "L3"]


def test_fill_constants_only_named_columns(spark):
    df = spark.createDataFrame([(None, None)], "g string, o string")
    r = C.fill_constants(df, {"g": "Unknown"}).first()
    assert (r.g, r.o) == ("Unknown", None)


def test_distinct_counts_with_and_without_null(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("a", None)],
                               "p string, q string")
    got = {r.column_name: (r.n_distinct, r.n_distinct_with_null)
           for r in PR.distinct_counts(df, ["p", "q"]).collect()}
    assert got == {"p": (2, 2), "q": (1, 2)}


def test_histogram_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    h = PR.histogram(df, "v", bins=10).collect()
    assert sum(r.n for r in h) == 101
    assert math.isclose(sum(r.density * (r.hi - r.lo) for r in h), 1.0)
    # the maximum falls in the last bin
    assert max(r.bin for r in h) == 9


def test_quantiles_observed_values(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)],
                               "v double")
    got = {r.prob: r.value for r in PR.quantiles(df, "v").collect()}
    assert got == {0.25: 1.0, 0.5: 2.0, 0.75: 3.0}


def test_null_rate_by_bucket(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(6)],
                               "id long, c string")
    got = sorted(tuple(r) for r in
                 PR.null_rate_by_bucket(df, "id", 2).collect())
    assert got == [(0, "c", 1, 3), (1, "c", 2, 3)]
    # the row count per bucket is bounded by the bucket count, not the data
    assert PR.null_rate_by_bucket(spark.range(10_000).withColumn(
        "c", F.lit(None).cast("string")), "id", 7).count() == 7


def test_schema_profile(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    got = sorted(tuple(r) for r in PR.schema_profile(df).collect())
    assert got == [(0, "a", "bigint", 1), (1, "b", "string", 0)]


def test_preview_is_ordered_top_n(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    assert [r.k for r in PR.preview(df.orderBy(F.desc("k")), 3,
                                    order_by=["k"]).collect()] == [0, 1, 2]


def test_hot_value_counts_and_approx_distinct(spark):
    rows = [("hot", 1)] * 3000 + [(f"v{i}", i) for i in range(6000)] + \
        [(None, None)]
    df = spark.createDataFrame(rows, "s string, x int")
    vc = PR.value_counts(df, ["s"]).first()
    assert (vc.value, vc.n) == ("hot", 3000)
    exact = {r.column_name: tuple(r)[1:] for r in
             PR.distinct_counts(df, ["s", "x"]).collect()}
    approx = {r.column_name: tuple(r)[1:] for r in
              PR.distinct_counts(df, ["s", "x"], approx_rsd=0.01).collect()}
    assert exact == {"s": (6001, 6002), "x": (6000, 6001)}
    for c in ("s", "x"):
        assert abs(approx[c][0] - exact[c][0]) / exact[c][0] < 0.05
        assert approx[c][1] - approx[c][0] == 1


def test_column_names_with_spaces_and_slashes(spark):
    df = spark.createDataFrame(
        [("100", None), (None, "x"), ("bad", "y")],
        "`Base Salary (/year)` string, `Other Details` string")
    prof = {r.column_name: r.n_null for r in PR.null_profile(df).collect()}
    assert prof == {"Base Salary (/year)": 1, "Other Details": 1}
    s = PR.summary(df, ["Base Salary (/year)"]).first()
    assert (s.column_name, s.n, s.mean) == ("Base Salary (/year)", 1, 100.0)
    out, _ = C.impute_mean(df, ["Base Salary (/year)"])
    assert sorted(r[0] for r in out.select("`Base Salary (/year)_imputed`")
                  .collect()) == [100.0, 100.0, 100.0]
    vc = PR.value_counts(df, ["Other Details"]).collect()
    assert {(r.value, r.n) for r in vc} == {("x", 1), ("y", 1), (None, 0)}


def test_quantiles_are_exact_on_many_rows(spark):
    from pyspark.sql import functions as F
    n = 2_100_000
    df = spark.range(n).select(
        ((F.col("id") * 7919 + F.col("id") * F.col("id")) % 2_000_003)
        .alias("v"))
    import numpy as np
    i = np.arange(n, dtype=np.int64)
    v = np.sort((i * 7919 + i * i) % 2_000_003)
    got = {r.prob: r.value for r in PR.quantiles(
        df, "v", (0.001, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert got == {p: float(v[max(int(np.ceil(p * n)), 1) - 1])
                   for p in (0.001, 0.25, 0.5, 0.75, 1.0)}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("x",)], "v string")
    assert PR.quantiles(df, "v").count() == 0


def test_null_buckets_of_wide_keys(spark):
    df = spark.createDataFrame([(0, None), (1 << 60, 1), ((1 << 59) - 1, 2),
                                (-(1 << 63), 3), ((1 << 63) - 1, 4)],
                               "id long, x int")
    got = {(r.bucket, r.n_null, r.n) for r in
           PR.null_rate_by_bucket(df, "id", 4).collect()}
    assert got == {(0, 0, 1), (2, 1, 3), (3, 0, 1)}


def test_fill_constants_skips_other_types(spark):
    df = spark.createDataFrame([(None, None, None, None)],
                               "i int, s string, b boolean, d double")
    r = C.fill_constants(df, {"i": "text", "s": 5, "b": 1, "d": "x",
                              "gone": "y"}).first()
    assert tuple(r) == (None, None, None, None)
    r = C.fill_constants(df, {"i": 1, "s": "a", "b": True, "d": 2}).first()
    assert tuple(r) == (1, "a", True, 2.0)
