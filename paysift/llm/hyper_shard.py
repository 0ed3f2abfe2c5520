"""Uniform shuffle into shards of exact size.

A hypergeometric communication matrix: rows fall into blocks by a hash of
their columns; for every block the counts it sends to each shard are drawn
exactly (multivariate hypergeometric on what the shards still lack), rows are
permuted within the block and dealt out by those counts, then permuted again
within the shard.  Shard sizes differ by one row at most.

The matrix is drawn in two levels: ``SUPER`` groups of blocks, whose counts
are all the driver sees, draw their share of every shard; a task for each group
then draws those of its blocks.  (What a set of rows sends to each shard has
this distribution whatever smaller sets it is put together from.)  No task
holds a whole shard: the second permutation sorts by a seeded hash, cut into
slices of its range, with running counts over the slices giving gapless slots.

Defined cases: a null key is hashed like a value; rows with equal keys are
separate rows, in different blocks unless they agree in all columns; an empty
table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.runs import grouped
from paysift.llm.stash import pin

#: Groups of blocks: the counts that reach the driver.
SUPER = 256


def communication_matrix(counts: list[int], shards: int,
                         seed: int) -> np.ndarray:
    """Rows sent from each block (row) to each shard (column): block sums are
    ``counts``, shard sums differ by one at most."""
    total = int(sum(counts))
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    return drawn(counts, left, np.random.default_rng(seed))


def drawn(counts: list[int], left: np.ndarray,
          rng: np.random.Generator) -> np.ndarray:
    """A matrix with row sums ``counts`` and column sums ``left``."""
    left = np.array(left, dtype=np.int64)
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, int(n),
                                                 method="marginals")
        left -= out[i]
    return out


def _block_plan(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """__block, __upto: the rows of each block sent to shards up to each
    one, from (__block, __n)."""
    spark = counts.sparkSession
    counts = pin(counts.withColumn("__super", F.col("__block") % SUPER))
    sums = sorted(counts.groupBy("__super").agg(F.sum("__n")).collect())
    matrix = communication_matrix([n for _, n in sums], shards, seed)
    share = spark.createDataFrame(
        [(int(s), row.tolist()) for (s, _), row in zip(sums, matrix)],
        "__super long, __left array<long>")

    def work(batches):
        for t in grouped(batches, [0]):
            group = t.column(0)[0].as_py()
            rows = drawn(t.column(2).to_pylist(), t.column(3)[0].as_py(),
                         np.random.default_rng((seed, group)))
            yield pa.RecordBatch.from_arrays(
                [t.column(1).combine_chunks(),
                 pa.array(rows.cumsum(axis=1).tolist(),
                          pa.list_(pa.int64()))],
                names=["__block", "__upto"])
    return counts.join(share, "__super") \
        .select("__super", "__block", "__n", "__left") \
        .repartition("__super").sortWithinPartitions("__super", "__block") \
        .mapInArrow(work, "__block long, __upto array<long>")


def shuffle_into_shards(rows: DataFrame, key: str = "doc_id",
                        shards: int = 16, block_rows: int = 1000,
                        seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in
    each shard).  Existing columns of these names are replaced."""
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep])
    plain = [F.col(f"`{c}`") for c, t in rows.dtypes
             if not t.startswith("map")]
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    rows = rows.withColumn("__block", F.pmod(
        F.xxhash64(F.lit(seed), F.col(key), *plain),
        F.lit(blocks)).cast("long"))
    plan = _block_plan(rows.groupBy("__block").agg(
        F.count(F.lit(1)).alias("__n")), shards, seed)
    local = Window.partitionBy("__block").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col(key), *plain))
    dealt = rows.withColumn("__r", F.row_number().over(local)) \
        .join(plan, "__block") \
        .withColumn("shard", F.size(F.filter(
            "__upto", lambda u: u < F.col("__r"))).cast("int"))
    # second permutation: by a seeded hash, in slices of its range
    slices = max(1, -(-n // (shards * block_rows)))
    bits = max(0, int(slices - 1).bit_length())
    dealt = dealt.withColumn("__g", F.xxhash64(
        F.lit(seed + 2), F.col(key), F.col("__r"), F.col("__block")))
    dealt = dealt.withColumn("__slice", F.shiftright("__g", 64 - bits)
                             if bits else F.lit(0).cast("long"))
    sums = dealt.groupBy("shard", "__slice").agg(
        F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "__slice", F.coalesce(
        F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("shard", "__slice").orderBy("__g")
    out = dealt.withColumn("__s", F.row_number().over(inner)) \
        .join(sums, ["shard", "__slice"])
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "shard",
        (F.col("__before") + F.col("__s") - 1).cast("long").alias("slot"))
