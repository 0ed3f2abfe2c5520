"""The corpus pipeline: documents, stage by stage.

Every stage takes all rows its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's rows as Parquet below
the shared checkpoint folder and reads them again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.llm.cotrain import quality_scores
from paysift.llm.fm_dedup import repeated_starts, strip_repeats
from paysift.llm.hilbert_pack import pack_along_curve
from paysift.llm.minhash_forest import near_duplicates
from paysift.llm.stash import stash
from paysift.llm.systematic_mix import mix_sources
from paysift.llm.words import n_words


def keep_good_quality(spark: SparkSession, docs: DataFrame,
                      sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, carry=True)
    return scored.filter("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame,
                         sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles,
    similarity 0.8): the one with the smallest id."""
    groups = near_duplicates(docs, shingle=5, pct=80)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame,
                 sf_dir: str) -> DataFrame:
    """Documents without word sequences (20 words and more) that occur
    earlier; documents left without a word go."""
    out = strip_repeats(docs, repeated_starts(docs))
    left = (F.col("n_removed") == 0) | (F.col("n_removed")
                                        < F.col("n_words"))
    changed = F.col("n_removed") > 0
    return out.filter(left).withColumn(
        "n_chars", F.when(changed, F.length("text"))
        .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) \
        .select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them (0 to 3 times)."""
    sized = docs.select(*docs.columns,
                        n_words(F.col("text")).alias("__words"))
    taken = mix_sources(sized, size="__words").filter("copies > 0")
    return taken.withColumn("__copy", F.explode(
        F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_along_curve(docs,
                            public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL expresses the trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
