"""Cut lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from paysift.session import ensure_checkpoint_dir, shared_path


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows and their partition layout are fixed, and
    survive lost executors.  For narrow frames."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: compressed, prunable by column.  For wide frames."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the shuffle files of finished
    steps go only when their plans do, which a driver that is mostly idle
    puts off while the disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
