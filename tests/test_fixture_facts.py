"""Golden facts of the adapter view at sf0.01, as published in FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from paysift.functions.exprs import degree_flag, location_region
from paysift.operators import clean as C
from paysift.operators import encode as E
from paysift.operators import profile as PR
from paysift.operators import train as TR
from paysift.sources.tables import comp_view

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def comp(spark):
    return comp_view(spark, SF01).cache()


def test_null_counts(comp):
    got = {r.column_name: r.n_null for r in PR.null_profile(comp).collect()}
    assert {k: got[k] for k in ("tag", "location", "gender", "std_level",
                                "skill_index", "other_details",
                                "total_comp", "_c16", "_c17")} == {
        "tag": 1154, "location": 1666, "gender": 3000, "std_level": 2143,
        "skill_index": 1364, "other_details": 2000, "total_comp": 155,
        "_c16": 15000, "_c17": 15000}


def test_planted_bad_values_and_cleaned_rows(comp):
    assert comp.where(F.col("skill_index") == "n/a").count() == 135
    assert comp.where(F.col("total_comp") == "2500000").count() == 71
    kept = C.cap(C.require(comp, "total_comp"), "total_comp", 1000000)
    assert kept.count() == 14774


def test_value_counts(comp):
    vc = {(r.column_name, r.value): r.n for r in
          PR.value_counts(comp, ["std_level", "gender"]).collect()}
    assert vc[("std_level", "L1")] == 2142
    assert all(vc[("std_level", f"L{i}")] == 2143 for i in range(2, 7))
    assert vc[("std_level", None)] == 0
    assert (vc[("gender", "Male")], vc[("gender", "Female")],
            vc[("gender", "Other")], vc[("gender", None)]) == (7529, 4000,
                                                                471, 0)
    _, modes = C.fill_mode(comp, ["std_level"])
    assert modes == {"std_level": "L2"}


def test_routed_locations(comp):
    got = {r.r: r.n for r in comp.groupBy(location_region("location")
                                          .alias("r")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"US_Southwest": 4999, "US_West": 1667,
                   "US_Midwest": 1667, "US_Northeast": 1667,
                   "US_Southeast": 1667, "Canada": 1667, "Europe1": 1666}


def test_skill_parse(comp):
    r = comp.agg(F.count(F.col("skill_index").try_cast("double")).alias("n"),
                 F.avg(F.col("skill_index").try_cast("double")).alias("m")
                 ).first()
    assert r.n == 13501 and round(r.m, 6) == 29.518702


def test_linear_fit_recovers_planted_effects(comp):
    d = C.cast_double(C.cap(C.require(comp, "total_comp"), "total_comp",
                            1000000), ["years_exp", "years_at", "total_comp"])
    d = d.withColumn("deg", degree_flag(
        F.coalesce("other_details", F.lit("Bachelors")), ["Masters", "PhD"]))
    d = E.assemble(d, ["years_exp", "years_at", "deg"], "x")
    m = TR.linear("total_comp", "x").fit(d)
    got = [round(v, 2) for v in m.coefficients] + [round(m.intercept, 2)]
    assert got == [2999.78, 992.71, 20004.80, 55045.27]
    assert math.isclose(m.summary.r2, 0.98996, abs_tol=5e-6)
