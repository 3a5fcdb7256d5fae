"""Run folders with names that mean something to Spark, line numbers, and ids that stay."""

import dataclasses
import gzip
import json

import pytest
from pyspark.sql import functions as F

from runlens.operators.extract.flink import FLINK_TASKS
from runlens.plans import etl
from runlens.sources import files
from runlens.sources.growing import plain_path, spark_uri
from runlens.sources.hidden import scan_hidden_lines
from runlens.sources.states import scan_run_states

STATE = {"command": "c", "runnerID": "flink-1.0", "runnerName": "flink", "runnerVersion": "1.0", "runExitCode": 0, "runTime": 10}
LINE = "2019-02-03 04:05:0{0},000\tMap(1/4) switched to {1} \n"
LOG = LINE.format(6, "RUNNING") + "noise\n" + LINE.format(7, "FINISHED") + LINE.format(7, "FINISHED")
NAME = "flink-u-jobmanager-h.log"


def run_folder(root, suite, run, names=(NAME,), log=LOG):
    folder = root / suite / run
    (folder / "logs/flink").mkdir(parents=True)
    (folder / "state.json").write_text(json.dumps(STATE))
    for name in names:
        (folder / "logs/flink" / name).write_text(log)


def test_names_mean_what_they_say(spark, tmp_path, rows):
    run_folder(tmp_path, "a=b", "x=y.run01")
    run_folder(tmp_path, "b", "x=y.run01")
    run_folder(tmp_path, "s{1},[2]*", "e.run01", ["flink-u-jobmanager-h[1].log"])
    (tmp_path / "b" / "x=y.run01" / "logs" / "part-00000").write_text("one")
    (tmp_path / "b" / "x=y.run01" / "logs" / "part-00001").write_text("two")
    found = etl.read_suites(spark, str(tmp_path))
    assert rows(found.events.groupBy("suite").count()) == [("a=b", 3), ("b", 3), ("s{1},[2]*", 3)]
    assert found.rejects.isEmpty()
    parts = files.scan_files(spark, str(tmp_path)).where("file_name like 'part-%'")
    assert rows(parts, "file_name", "n_parts") == [("part-00000", 1), ("part-00001", 1)]
    one = etl.read_suites(spark, str(tmp_path), ["s{1},[2]*"])
    assert rows(one.events.groupBy("suite").count()) == [("s{1},[2]*", 3)]


def hidden_tree(root):
    run_folder(root, "s", "_e.run01")
    run_folder(root, "s", "e.run01", [NAME, ".x y.log", "_x.log"])
    run_folder(root, "_t", "f.run01")
    (root / "s" / "e.run01" / "logs" / "flink" / ".z.log.gz").write_bytes(gzip.compress(LOG.encode()))
    (root / "s" / "e.run01" / "logs" / "flink" / "_empty.log").write_text("")


#: Takes logs whose names Spark's readers do not open.
ANY_LOG = dataclasses.replace(FLINK_TASKS, patterns=(r".+\.log", r".+\.log\.gz"))


def test_hidden_names_are_read(spark, tmp_path, rows):
    hidden_tree(tmp_path)
    found = etl.read_suites(spark, str(tmp_path))
    assert rows(found.events.groupBy("suite").count()) == [("_t", 3), ("s", 6)]
    assert found.rejects.isEmpty()
    listed = files.scan_files(spark, str(tmp_path), ["s"])
    assert rows(listed.where("rel like '%.log%'"), "rel", "bytes") == sorted(
        [
            ("s/_e.run01/logs/flink/" + NAME, len(LOG)),
            *[("s/e.run01/logs/flink/" + n, len(LOG)) for n in (NAME, ".x y.log", "_x.log")],
            ("s/e.run01/logs/flink/.z.log.gz", len(gzip.compress(LOG.encode()))),
            ("s/e.run01/logs/flink/_empty.log", 0),
        ],
        key=repr,
    )
    assert files.scan_files(spark, str(tmp_path), ["_t"]).count() == 2
    own = etl.read_suites(spark, str(tmp_path), ["s"], {"flink_tasks": ANY_LOG})
    # one reading of each log, hidden or not
    assert own.events.count() == 15 and own.rejects.isEmpty()
    assert own.events.select("id").distinct().count() == 15


def test_hidden_names_of_unknown_file_systems_are_rejects(spark, tmp_path, rows, monkeypatch):
    hidden_tree(tmp_path)
    for module in (etl, files):
        monkeypatch.setattr(module, "readable", lambda *_: False)
    found = etl.read_suites(spark, str(tmp_path), ["s"])
    assert {r["reason"] for r in found.rejects.collect()} == {"hidden name, not read"}
    assert found.events.count() == 3


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_hidden_files_in_splits(spark, tmp_path, rows, end):
    """The same lines and numbers as those of an open file, however small the splits."""
    lines = [f"line {i} " + "x" * (i % 37) for i in range(300)]
    lines[20] = lines[-2] = ""
    (tmp_path / "s").mkdir()
    for name in (".log", "log"):
        (tmp_path / "s" / name).write_text(end.join(lines), newline="")
    listed = files.scan_files(spark, str(tmp_path))
    open_, hidden = (listed.where(F.col("file_name") == n) for n in ("log", ".log"))
    plain = files.number_lines(files.scan_lines(spark, str(tmp_path / "s" / "log")))
    for size in (64, 1000, 1 << 20):
        read = files.number_lines(scan_hidden_lines(hidden.select("source", "bytes"), str(tmp_path), size))
        assert rows(read, "line_no", "value") == rows(plain, "line_no", "value")
    assert rows(open_, "bytes") == rows(hidden, "bytes")


@pytest.mark.parametrize("root", ["/data", "file:///data", "file:/data"])
def test_names_of_files_by_scheme(root):
    for path in ("/data/a b/%41+é=1.log", "/data/_x/[1].log"):
        assert plain_path(spark_uri(path, root), root) == path
    assert spark_uri("bucket/a b/x", "s3://bucket/a b") == "s3://bucket/a%20b/x"
    assert spark_uri("/a/x", "hdfs://host:8020/a") == "hdfs://host:8020/a/x"


def test_an_absent_root_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no folder"):
        scan_run_states(spark, str(tmp_path / "nowhere"))


@pytest.fixture
def small_splits(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_stay_whatever_the_splits_and_the_other_runs(spark, tmp_path, small_splits, rows):
    lines = "".join(LINE.format(i % 10, "RUNNING") + "noise\n" * (i % 3) for i in range(300))
    run_folder(tmp_path, "s", "e.run01", log=lines)

    def ids():
        events = etl.read_suites(spark, str(tmp_path), ["s"]).events
        return rows(events.where(F.col("experiment_run_id") == first), "id")

    first = etl.read_suites(spark, str(tmp_path)).runs.first()["id"]
    before = ids()
    assert len(set(before)) == 300
    small_splits("2k")
    assert ids() == before
    run_folder(tmp_path, "s", "a.run01", log=lines * 2)
    run_folder(tmp_path, "s", "z.run01", log=lines)
    assert ids() == before


def test_line_numbers_and_appended_lines(spark, tmp_path, small_splits, rows):
    one, two = tmp_path / "one.log", tmp_path / "two.log"
    one.write_text("".join(f"line {i}\n" for i in range(1, 201)))
    small_splits("256")
    numbered = files.number_lines(files.scan_lines(spark, str(tmp_path)))
    assert rows(numbered, "line_no", "value") == sorted(((i, f"line {i}") for i in range(1, 201)), key=repr)
    new, offsets = files.appended_lines(spark, str(tmp_path), None)
    assert new.count() == 200
    with one.open("a") as f:
        f.write("more\nand more\n")
    two.write_text("fresh\n")
    new, offsets = files.appended_lines(spark, str(tmp_path), offsets)
    assert rows(new, "line_no", "value") == [(1, "fresh"), (201, "more"), (202, "and more")]
    new, offsets = files.appended_lines(spark, str(tmp_path), offsets)
    assert new.isEmpty() and rows(offsets, "n_lines") == [(1,), (202,)]
