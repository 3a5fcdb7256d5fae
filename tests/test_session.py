import os

import pytest

from runlens import session


def test_cut_lineage_and_clean_up(spark, rows):
    kept = session.cut_lineage(spark.range(5))
    assert rows(kept) == [(i,) for i in range(5)]
    assert "Parquet" in kept._jdf.queryExecution().executedPlan().toString() or kept.inputFiles()
    folder = os.path.dirname(session.work_path(spark, "x"))
    assert os.path.isdir(folder)


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/dir"}.get(key, default)

    class Context:
        applicationId = "app-1"
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.work_path(Session(), "a").startswith("hdfs://shared/dir/runlens-app-1/a-")
    Session.conf.get = lambda key, default=None: default
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_small_sides_are_broadcast_large_ones_are_not(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    big = spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(big.join(session.broadcast_if_small(small), big.id == small.k))
        assert "SortMergeJoin" in plan(big.join(session.broadcast_if_small(small, 5), big.id == small.k))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_leaves_large_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide, narrow = spark.range(0, 100, 1, cores * 2), spark.range(0, 100, 1, 1)
    assert session.spread(wide, "id") is wide
    assert session.spread(narrow, "id").rdd.getNumPartitions() == cores
