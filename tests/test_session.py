"""Checkpoint folder rules: read from the session, a fallback only in
local mode, an error on a cluster without a shared folder."""

import pytest

from paysift.operators import encode as E
from paysift.session import compilable_methods, ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        if key == "spark.sql.warehouse.dir":
            return "/shared/warehouse"
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext = _Context(master)
        self.conf = _Conf(configured)


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]",
                                    "spark://host:7077"])
def test_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(master))


def test_configured_folder_is_used():
    s = _Session("yarn", "hdfs:///shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_local_mode_falls_back_to_the_warehouse():
    s = _Session("local[2]")
    assert ensure_checkpoint_dir(s) == "/shared/warehouse/_checkpoints"


def test_master_and_partitions_stay_unless_asked(monkeypatch):
    """A preset master or shuffle setting is not overridden."""
    from paysift import session as S
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def config(self, key, value):
            seen[key] = value
            return self

        def getOrCreate(self):
            return spark

    class spark:
        class sparkContext:
            @staticmethod
            def setLogLevel(level):
                pass

            @staticmethod
            def getCheckpointDir():
                return "/shared"

    class Session:
        builder = Builder()
    monkeypatch.setattr(S, "SparkSession", Session)
    S.get_session()
    assert not {"spark.master", "spark.driver.memory",
                "spark.sql.shuffle.partitions"} & set(seen)
    S.get_session(master="local[2]", shuffle_partitions=3)
    assert seen["spark.master"] == "local[2]"
    assert seen["spark.sql.shuffle.partitions"] == "3"


def test_existing_context_folder_wins(spark):
    assert ensure_checkpoint_dir(spark) == \
        spark.sparkContext.getCheckpointDir()


def test_model_input_is_written_by_compilable_methods(spark, monkeypatch):
    """While it is written, stages with too long methods are not fused; the
    session's own setting comes back, also after a failure."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(name), []
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def noted(self, *args, **kw):
        seen.append(spark.conf.get(name))
        return parquet(self, *args, **kw)
    monkeypatch.setattr(writer, "parquet", noted)
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)] +
                                 [(None, None), (3, 3.0)], "k long, x double")
    train, test = E.materialized_split(rows, "k")
    assert seen == ["8000"] and spark.conf.get(name) == before
    got = [tuple(r) for part in (train.drop(E.FOLD), test)
           for r in part.collect()]
    assert sorted(got, key=str) == sorted(map(tuple, rows.collect()),
                                          key=str)
    with pytest.raises(ZeroDivisionError):
        with compilable_methods(spark):
            1 / 0
    assert spark.conf.get(name) == before
