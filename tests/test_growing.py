"""Streams over files that grow: numbers, restarts, ids."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.extract import registered
from runlens.operators.extract.base import event_id
from runlens.sources import growing
from runlens.sources.files import number_lines, scan_lines
from runlens.streaming.extract import run_extraction


@pytest.fixture
def drain(spark, tmp_path):
    """Run a stream over the folder once; returns all rows taken so far."""

    def run(folder, **options):
        lines = growing.growing_lines(spark, str(folder), str(tmp_path / "notes"), **options)
        q = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("file", "record_key", "value").collect()))

    return run


def in_batch(spark, folder):
    found = number_lines(scan_lines(spark, str(folder))).select("file", "line_no", "value")
    return sorted(map(tuple, found.collect()))


def test_grown_files_give_each_line_once_with_its_number(spark, tmp_path, drain):
    logs, rnd = tmp_path / "logs", random.Random(2)
    (logs / "a b").mkdir(parents=True)
    names = ["x.log", "a b/ü+%20 ~.log", "a b/=y,[1].log"]
    for step in range(4):
        for name in names:
            with open(logs / name, "ab") as f:
                for _ in range(rnd.randint(0, 60)):
                    f.write(b"%d %s" % (rnd.randrange(999), b"x" * rnd.randrange(40)) + rnd.choice([b"\n", b"\n", b"\r\n", b"\r", b"\n\n"]))
                f.write(b"end\n")
        got = drain(logs, split_bytes=97, splits_per_file=1000)
        assert got == in_batch(spark, logs)
    assert len({f for f, _, _ in got}) == 3


def test_an_open_line_waits(tmp_path, drain):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("one\ntw")
    (logs / "_hidden.log").write_text("no\n")
    (logs / "old.log.gz").write_text("no\n")
    assert [r[1:] for r in drain(logs)] == [(1, "one")]
    with open(logs / "a.log", "a") as f:
        f.write("o\nthree")
    assert [r[1:] for r in drain(logs)] == [(1, "one"), (2, "two")]
    assert [r[1:] for r in drain(logs)] == [(1, "one"), (2, "two")]


def test_a_trigger_takes_some_splits_of_a_file(spark, tmp_path, drain):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"line {i}\n" for i in range(400)) + "y" * 500 + "\nlast\n")
    counts = [len(drain(logs, split_bytes=100, splits_per_file=4))]
    while len(counts) < 2 or counts[-1] > counts[-2]:
        counts.append(len(drain(logs, split_bytes=100, splits_per_file=4)))
    assert counts[0] < 60 and counts[-1] == 402 and drain(logs) == in_batch(spark, logs)


def test_lost_notes_are_counted_anew(spark, tmp_path, drain):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("1\n2\n3\n")
    drain(logs)
    for note in (tmp_path / "notes").iterdir():
        note.unlink()
    with open(logs / "a.log", "a") as f:
        f.write("4\n")
    assert [r[1:] for r in drain(logs)] == [(i, str(i)) for i in range(1, 5)]


def test_a_cut_file_is_an_error(tmp_path, drain):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("1\n2\n")
    drain(logs)
    (logs / "a.log").write_text("1\n")
    with pytest.raises(Exception, match="was cut"):
        drain(logs)


def test_ids_of_the_stream_are_those_of_the_import(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    extractor = registered()["flink_tasks"]
    for n in (3, 5):
        with open(logs / "flink-u-jobmanager-a.log", "a") as f:
            f.write("2019-02-03 04:05:06,000\tMap(1/4) switched to RUNNING \nnoise\n" * n)
        lines = growing.growing_lines(spark, str(logs), str(tmp_path / "notes"), split_bytes=50)
        run_extraction(lines, extractor, str(tmp_path / "sink"), str(tmp_path / "state")).awaitTermination()
    batch = number_lines(scan_lines(spark, str(logs))).withColumn("record_key", F.col("line_no")).select("file", "record_key", "value")
    ids = lambda df: sorted(r[0] for r in df.select(event_id()).collect())
    got = ids(spark.read.parquet(str(tmp_path / "sink")))
    assert got == ids(extractor.extract(batch)) and len(set(got)) == 8
