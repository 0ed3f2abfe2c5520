import pytest
from pyspark.sql import functions as F

from paysift.functions import lookups as L
from paysift.functions.exprs import location_region
from paysift.operators import categorize as CT


def test_location_router(spark):
    rows = [("Seattle, WA",), ("Toronto, ON, Canada",), ("Remote",),
            (None,), ("Austin, TX",), ("Lima, LI, Peru",),
            ("Berlin, BE, Germany",), ("Pune, MH, India",)]
    df = spark.createDataFrame(rows, "l string")
    got = [r.r for r in df.select(location_region("l").alias("r")).collect()]
    assert got == ["US_West", "Canada", "US_Southwest", "US_Southwest",
                   "US_Southwest", "Other", "Europe1", "Asia2"]


def test_title_ladder_first_arm_wins(spark):
    df = spark.createDataFrame([("Senior Director",), ("nobody",), (None,),
                                ("software engineer",),
                                ("Software Engineer",)], "t string")
    got = [r.c for r in CT.map_ladder(df, "t", L.TITLE_LADDER, "c").collect()]
    assert got == ["Product Managers", "Other", "Other", "Other",
                   "Software Engineers"]


def test_keep_list(spark):
    df = spark.createDataFrame([("Google",), ("Acme",), (None,)], "c string")
    got = [r.k for r in CT.keep_list(df, "c", L.COMPANY_KEEP, "k").collect()]
    assert got == ["Google", "Other", "Other"]


def test_degree_flag(spark):
    df = spark.createDataFrame([("Masters",), ("my PhD",), ("masters",),
                                ("Bachelors",)], "d string")
    got = [r.m for r in CT.regex_flag(df, "d", "m").collect()]
    assert got == [True, True, False, False]


@pytest.mark.parametrize("k,expected", [(1, {"a"}), (2, {"a", "b"})])
def test_top_k_or_other(spark, k, expected):
    df = spark.createDataFrame([(x,) for x in "aaabbc"] + [(None,)],
                               "t string")
    out = CT.top_k_or_other(df, "t", k, "c").collect()
    kept = {r.c for r in out} - {"Other"}
    assert kept == expected
    assert len(out) == 7  # no row lost or duplicated by the join
    assert all(r.c == "Other" for r in out if r.t is None)


def test_lookup_lists_shape():
    assert len(L.COMPANY_KEEP) == 37
    keys = [k for _, ks in L.TITLE_LADDER for k in ks]
    assert len(keys) == 98 and len(set(keys)) == 97
    assert [len(v) for _, v in L.US_REGIONS] == [11, 12, 9, 15]
    assert len(L.TAG_KEEP) == 13


def _skewed(spark):
    # one value holds a third of all rows
    rows = [("hot",)] * 300 + [(f"k{i % 200}",) for i in range(600)] + \
        [(None,)] * 9
    return spark.createDataFrame(rows, "t string")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_top_k_with_hot_key_both_join_paths(spark, threshold):
    """Spark chooses the join by size; both ways give the same rows."""
    df = _skewed(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = CT.top_k_or_other(df, "t", 3, "c")
        got = {r.c: r.n for r in out.groupBy("c").count()
               .withColumnRenamed("count", "n").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # hot, then k0 and k1 (3 rows each, ties to the smaller value)
    assert got == {"hot": 300, "k0": 3, "k1": 3, "Other": 603}
    # the same buckets from counts alone
    counts = df.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    assert {r.c: r.n for r in CT.top_k_bucket_counts(
        counts, "t", "n", 3, "c").collect()} == got
