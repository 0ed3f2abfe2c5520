"""Feature encoding: frequency indexing, one-hot, assembly, splits, slot
names and vector explosion - all on ``pyspark.ml`` stages and SQL
functions.

Indexers for all categorical columns are ONE multi-column StringIndexer
(one counting job instead of one per column).  Vectors stay sparse; slot
names are read from the ``ml_attr`` metadata the stages write, instead of
hard-coded offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import (OneHotEncoder, OneHotEncoderModel,
                                StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.functions import lookups as L
from paysift.functions.exprs import col_of, hash_percent
from paysift.operators.moments import stored
from paysift.operators.ordered import running
from paysift.session import compilable_methods, shared_path

# Columns of a written model input: the part, and the fold of training rows.
PART, FOLD = "__part", "__fold"


def index_columns(df: DataFrame, cols: Sequence[str], outs: Sequence[str],
                  order: str = "frequencyAsc", handle_invalid: str = "error",
                  fit_df: DataFrame | None = None
                  ) -> tuple[DataFrame, StringIndexerModel]:
    """Map each category to a double index; ``frequencyAsc`` gives the
    rarest value 0.0, ties broken alphabetically.  Learned on ``fit_df``
    (default ``df``)."""
    idx = StringIndexer(inputCols=list(cols), outputCols=list(outs),
                        stringOrderType=order, handleInvalid=handle_invalid)
    model = idx.fit(fit_df if fit_df is not None else df)
    return model.transform(df), model


def frequency_index(counts: DataFrame, column: str = "column_name",
                    value: str = "value", n: str = "n") -> DataFrame:
    """(column_name, value, idx): values of each column numbered from 0, the
    rarest first, equal counts by value - ``index_columns`` as a table.

    Ranked on the cluster (``ordered.running``): no task holds a column's
    values, and none reach the driver."""
    rows = counts.select(col_of(column).alias("column_name"),
                         col_of(value).alias("value"), col_of(n).alias("n"))
    return running(rows, ["column_name"], ["n", "value"],
                   {"rank": F.lit(1)}).select(
        "column_name", "value", F.col("rank").cast("double").alias("idx"))


def index_by_table(df: DataFrame, index: DataFrame, cols: Sequence[str],
                   outs: Sequence[str]) -> DataFrame:
    """Add the indexes of ``frequency_index`` to rows; a value it does not
    know, and null, have a null index.  Joins by value: Spark broadcasts a
    small index by its size and splits a hot value's partition otherwise."""
    for i, (c, out) in enumerate(zip(cols, outs)):
        own = index.filter(F.col("column_name") == c).select(
            F.col("value").alias(f"__v{i}"), F.col("idx").alias(out))
        df = df.join(own, col_of(c) == F.col(f"__v{i}"), "left") \
            .drop(f"__v{i}")
    return df


def one_hot(df: DataFrame, cols: Sequence[str], outs: Sequence[str],
            drop_last: bool = False) -> tuple[DataFrame, OneHotEncoderModel]:
    """One-hot encode index columns into sparse vectors.  Sizes come from
    the indexers' metadata, so fitting runs no job."""
    enc = OneHotEncoder(inputCols=list(cols), outputCols=list(outs),
                        dropLast=drop_last)
    model = enc.fit(df)
    return model.transform(df), model


def densify(df: DataFrame, c: str, out: str) -> DataFrame:
    """Dense copy of a vector column (for export; densifying drops the slot
    names, so models are fed the sparse form)."""
    return df.withColumn(out, array_to_vector(vector_to_array(col_of(c))))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Concatenate numeric, boolean and vector columns into one vector."""
    va = VectorAssembler(inputCols=list(cols), outputCol=out,
                         handleInvalid=handle_invalid)
    return va.transform(df)


def random_split(df: DataFrame, weights: Sequence[float] = (0.7, 0.3),
                 seed: int = 1) -> list[DataFrame]:
    """Spark's ``randomSplit``.  Which rows land where depends on the
    partitioning; prefer ``hash_split`` for reproducible parts."""
    return df.randomSplit(list(weights), seed=seed)


def hash_part(key: str, train_percent: int = 70):
    """Column expression: True for the training part of a hash split."""
    return hash_percent(key) < F.lit(train_percent)


def fold_column(key: str, folds: int) -> Column:
    """Fold number 0..folds-1 from a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


def hash_split(df: DataFrame, key: str, train_percent: int = 70
               ) -> tuple[DataFrame, DataFrame]:
    """Deterministic split by a key hash: same rows on any cluster layout,
    no shuffle, no sampling state.  Returns (train, test)."""
    part = hash_part(key, train_percent)
    return df.where(part), df.where(~part)


def materialized_split(df: DataFrame, key: str, train_percent: int = 70,
                       folds: int = L.NUM_FOLDS,
                       partitions: int | None = None
                       ) -> tuple[DataFrame, DataFrame]:
    """Hash split of a narrow frame that is written once, as Parquet below
    the shared checkpoint folder, by part and fold.  Returns (train, test);
    train carries its fold number in ``FOLD``.

    Every later pass reads only the columns and parts it asks for.  The
    rows' layout depends on the key and ``partitions`` (default: the shuffle
    partitions) alone, whatever the source's partitions or the number of
    cores: rows are dealt by part, fold and key and sorted by key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(col_of(key)), F.lit(max(1, n // (2 * folds))))
    path = shared_path(spark, "model-input")
    with compilable_methods(spark):
        (df.withColumns({PART: F.when(hash_part(key, train_percent), "train")
                         .otherwise("test"), FOLD: fold_column(key, folds)})
         .repartition(n, PART, FOLD, salt)
         .sortWithinPartitions(PART, FOLD, key)
         .write.partitionBy(PART, FOLD).parquet(path))
    schema = T.StructType(df.schema.fields + [
        T.StructField(PART, T.StringType()),
        T.StructField(FOLD, T.IntegerType())])
    m = spark.read.schema(schema).parquet(path)
    return (m.where(F.col(PART) == "train").drop(PART),
            m.where(F.col(PART) == "test").drop(PART, FOLD))


def slot_names(df: DataFrame, vec: str) -> list[tuple[int, str]]:
    """(slot index, name) of a vector column, from its ML metadata."""
    meta = df.schema[vec].metadata.get("ml_attr", {})
    slots: list[tuple[int, str]] = []
    for group in meta.get("attrs", {}).values():
        for a in group:
            slots.append((int(a["idx"]), a.get("name", f"{vec}_{a['idx']}")))
    if not slots:
        n = int(meta.get("num_attrs", 0))
        slots = [(i, f"{vec}_{i}") for i in range(n)]
    return sorted(slots)


def slot_table(df: DataFrame, vec: str) -> DataFrame:
    """Slot names as a table (idx, name); bounded by the vector width."""
    return df.sparkSession.createDataFrame(slot_names(df, vec),
                                           "idx int, name string")


def slot_offsets(df: DataFrame, inputs: Sequence[str]) -> dict[str, int]:
    """First slot of each assembled input column: the widths of the inputs
    before it, from their own metadata (a scalar has one slot)."""
    offsets, at = {}, 0
    for c in inputs:
        offsets[c] = at
        if isinstance(df.schema[c].dataType, VectorUDT):
            width = len(slot_names(df, c))
            if not width:
                raise ValueError(f"{c} has no slot metadata")
            at += width
        else:
            at += 1
    return offsets


def explode_vector(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Vector column to rows (key, slot, val) of its non-zero slots."""
    return df.select(col_of(key), F.inline(stored(vec)).alias("slot", "val"))


def slot_totals(df: DataFrame, vecs: Sequence[str]) -> DataFrame:
    """(column_name, slot, total): the sum of every slot of several vector
    columns, where it is not 0, from one scan."""
    def named(v: str) -> Column:
        return F.transform(stored(v), lambda e: F.struct(
            F.lit(v).alias("column_name"), e["slot"].alias("slot"),
            e["val"].alias("val")))
    entries = F.concat(*[named(v) for v in vecs])
    return df.select(F.inline(entries)).groupBy("column_name", "slot").agg(
        F.sum("val").alias("total"))


def code_table(labels: Mapping[str, Sequence[str]],
               offsets: Mapping[str, int], spark: SparkSession) -> DataFrame:
    """(column_name, value, idx): the learned labels of each column with
    their index, shifted by the column's offset.  No pass over the data."""
    return spark.createDataFrame(
        [(c, v, float(offsets.get(c, 0) + i))
         for c, own in labels.items() for i, v in enumerate(own)],
        "column_name string, value string, idx double")
