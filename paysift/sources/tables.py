"""Table sources: parquet tables with declared schemas, the adapter view,
temp-view round trips and schema rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.functions import lookups as L

# Declared schemas for the driver tables the adapter reads.  Declaring them
# skips footer-based inference and fixes the types at the source.
SCHEMAS = {
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
}

# Columns of the adapter view, in order (all strings but the key).
COMP_COLUMNS = [
    "rec_id", "company", "title", "tag", "location", "gender", "std_level",
    "skill_index", "other_details", "years_exp", "years_at", "total_comp",
    "_c16", "_c17",
]
LABEL_RAW = "total_comp"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; declared schema where one is known."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def comp_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey-shaped table built from ``orders`` and ``customer``.

    One row per order.  Nulls, malformed numbers, outliers and locations of
    one, two and three parts are planted by key arithmetic (FIXTURES.md §2),
    so every cleaning rule has work to do.  Only the four order columns and
    two customer columns are read; the join is planned by Spark (broadcast
    only when the customer side is measured small, else sort-merge with AQE
    skew splitting).
    """
    o = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = load_table(spark, sf_dir, "customer").select("c_custkey",
                                                     "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    null_s = F.lit(None).cast("string")

    location = (
        F.when(_mod(k, 9) == 0, "Seattle, WA")
        .when(_mod(k, 9) == 1, "Austin, TX")
        .when(_mod(k, 9) == 2, "Chicago, IL")
        .when(_mod(k, 9) == 3, "Boston, MA")
        .when(_mod(k, 9) == 4, "Miami, FL")
        .when(_mod(k, 9) == 5, "Toronto, ON, Canada")
        .when(_mod(k, 9) == 6, "Berlin, BE, Germany")
        .when(_mod(k, 9) == 7, "Remote")
        .otherwise(null_s))
    gender = (
        F.when(_mod(k, 5) == 0, null_s)
        .when(_mod(k, 3) == 0, "Female")
        .when(_mod(k, 17) == 1, "Other")
        .otherwise("Male"))
    std_level = F.when(_mod(k, 7) == 0, null_s).otherwise(
        F.concat(F.lit("L"), (_mod(k, 6) + 1).cast("string")))
    skill = (
        F.when(_mod(k, 11) == 0, null_s)
        .when(_mod(k, 101) == 0, "n/a")
        .otherwise(_mod(ck, 60).cast("string")))
    other_details = (
        F.when(_mod(k, 4) == 0, "Masters in CS")
        .when(_mod(k, 10) == 1, "PhD")
        .when(_mod(k, 6) == 5, null_s)
        .otherwise("Bachelors"))
    degree_bonus = F.when((_mod(k, 4) == 0) | (_mod(k, 10) == 1),
                          20000).otherwise(0)
    comp_value = (F.lit(50000) + F.lit(3000) * _mod(k, 31)
                  + F.lit(1000) * _mod(ck, 12) + degree_bonus
                  + _mod(k * F.lit(7919), 10007))
    total_comp = (
        F.when(_mod(k, 97) == 0, null_s)
        .when(_mod(k, 211) == 0, "2500000")
        .otherwise(comp_value.cast("string")))

    return j.select(
        k.alias("rec_id"),
        F.col("c_mktsegment").alias("company"),
        F.col("o_orderpriority").alias("title"),
        F.when(_mod(k, 13) == 0, null_s).otherwise(
            F.col("o_orderstatus")).alias("tag"),
        location.alias("location"),
        gender.alias("gender"),
        std_level.alias("std_level"),
        skill.alias("skill_index"),
        other_details.alias("other_details"),
        _mod(k, 31).cast("string").alias("years_exp"),
        _mod(ck, 12).cast("string").alias("years_at"),
        total_comp.alias("total_comp"),
        null_s.alias("_c16"),
        null_s.alias("_c17"),
    )


def planted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with company, title, tag and location dealt from the original
    analysis' own lists by key arithmetic, so that every entry of every list
    occurs; each list is followed by values it does not know and a null."""
    k = F.col("o_orderkey")

    def dealt(values: list) -> Column:
        listed = F.array(*[F.lit(v).cast("string") for v in values])
        return F.get(listed, (k % len(values)).cast("int"))
    return load_table(spark, sf_dir, "orders").select(
        k.alias("rec_id"),
        *[dealt(v).alias(c) for c, v in planted_values().items()])


def planted_values() -> dict[str, list]:
    """The values ``planted_view`` deals out, per column."""
    def arms(ladder) -> list[str]:
        return [v for _, own in ladder for v in own]
    states = [f"Town, {s}" for s in [*arms(L.US_REGIONS), "ZZ"]]
    countries = [f"City, Part, {c}" for c in
                 [*arms(L.COUNTRY_REGIONS), "Nowhere"]]
    return {
        "company": [*L.COMPANY_KEEP, "Unlisted Ltd", None],
        "title": [*arms(L.TITLE_LADDER), "Unlisted Title", None],
        "tag": [*L.TAG_KEEP, "Unlisted Tag", None],
        "location": [*states, *countries, "Remote", None],
    }


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Publish ``df`` as a session view; re-registering replaces it."""
    df.createOrReplaceTempView(name)
    return df


def read_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
