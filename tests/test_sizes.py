"""What grows with the input: tasks, triggers, plans and writers, on small copies of the shapes that were slow."""

import os
from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__
from runlens.operators import config
from runlens.plans import adapters
from runlens.plans.queries import streams
from runlens.sources import growing
from runlens.sources.files import number_lines, scan_lines

SMALL = "/root/testdata/sf0.001"


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "1k")
        lines = scan_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert lines.select("block").distinct().count() > 40
        numbered = number_lines(lines).collect()
    finally:
        spark.conf.set(setting, before)
    assert len(numbered) == 5000 and all(r.value == f"line {r.line_no}" for r in numbered)


def test_longer_files_take_no_more_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "PIECE", 512)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"{i}\n" for i in range(6000)))
    started = []

    def start(lines):
        started.append(1)
        assert len(started) <= 12
        writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        return writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    streams._piece_by_piece(SimpleNamespace(spark=spark), str(tmp_path / "in"), start)
    assert {(r.record_key, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(i + 1, str(i)) for i in range(6000)}


def test_nested_plan_has_every_level_once(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("id"), F.concat(F.lit("a.b.c.d.e.f.k"), "id").alias("key"), F.lit("v").alias("value"))
    trees, rejects = config.nest_config(rows, "id")
    assert trees._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 8
    assert trees.count() == 3 and rejects.isEmpty() and config.unnest_config(trees, "id").count() == 40


def test_edges_of_a_small_file_are_made_by_many_tasks(spark):
    plan = __spark_entry__.queries()["graph_from_records"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_splits_of_many_small_files_share_tasks():
    reader = growing.GrowingFilesReader({"path": "/none", "notes": "/none", "split_bytes": "1000"})
    tasks = reader.partitions({}, {f"/none/f{i:04}": 2500 for i in range(1000)})
    assert len(tasks) <= 80 and sum(len(t.splits) for t in tasks) == 3000
    (alone,) = reader.partitions({}, {"/none/f": 900})
    assert [(s.at, s.until) for s in alone.splits] == [(0, 900)]


def test_writers_of_run_folders_grow_with_the_events(spark, monkeypatch):
    monkeypatch.setattr(adapters, "EVENTS_PER_WRITER", 40)
    monkeypatch.setattr(adapters, "_TREES", {})
    root = adapters.results_tree(adapters.Tables(spark, SMALL))
    parts = {f.split("-")[1] for _, _, files in os.walk(root.removeprefix("file:")) for f in files if f.startswith("part-")}
    assert len(parts) > 10
