"""Session helpers: a configured SparkSession and the checkpoint folder."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry.  Master, memory and shuffle
# partitions belong to the cluster: they are set only when asked for.  Size
# shuffle partitions to input bytes / 128-256 MB; AQE coalesces small ones
# and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # concurrent fits share the cores
    "spark.scheduler.mode": "FAIR",
    # delete checkpoint files of model inputs once they are unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "paysift",
                shuffle_partitions: int | None = None,
                driver_memory: str | None = None,
                checkpoint_dir: str | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.  What is not
    given stays as the cluster or the submit command set it."""
    b = SparkSession.builder.appName(app)
    conf = dict(BASE_CONF)
    for name, value in (
            ("spark.master", master),
            ("spark.sql.shuffle.partitions", shuffle_partitions),
            ("spark.driver.memory", driver_memory),
            ("spark.checkpoint.dir", checkpoint_dir)):
        if value is not None:
            conf[name] = str(value)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: list[SparkContext] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that functions
    of its modules run there wherever the driver was started.  The archive
    is written to the folder Spark keeps for such files on the driver."""
    sc = spark.sparkContext
    if any(x is sc for x in _SHIPPED):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    above, name = os.path.split(home)
    folder = os.path.join(SparkFiles.getRootDirectory(), uuid.uuid4().hex)
    os.makedirs(folder)
    archive = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.relpath(path, above))
    sc.addPyFile(archive)
    _SHIPPED[:] = [sc]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.

    Read from the session.  On a cluster a missing setting is an error; in
    local mode (tests) the folder is then one below the session's warehouse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        local = sc.master == "local" or sc.master.startswith("local[")
        if not local:
            raise RuntimeError(
                "spark.checkpoint.dir is not set: point it at a folder "
                "shared by all executors (e.g. on HDFS or object storage)")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        configured = f"{warehouse}/_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a method beyond which the JVM does not compile it.
_METHOD_BYTES = "8000"


@contextmanager
def compilable_methods(spark: SparkSession) -> Iterator[None]:
    """For what runs inside: a stage whose generated code has a method the
    JVM would interpret runs operator by operator, in smaller methods.  A
    chain of cleaning, bucketing and encoding is that long."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, _METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of a batch of rows that Spark hands to Python.
_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of about 4 MB, unless the session asks
    for smaller ones.  An executor holds a batch of every running task on
    both sides, several times over; 10,000 texts are 20 MB and more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > _BATCH_BYTES:
        spark.conf.set(name, _BATCH_BYTES)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    Used before a frame feeds many passes (model fits, tuning): the passes
    read the written copy instead of re-running scan, join and encoding, and
    the copy survives the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
