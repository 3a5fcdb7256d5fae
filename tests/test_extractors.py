import json

import pytest
from pyspark.sql import functions as F

from runlens.operators.extract import Extractor, accepted, register_extractor, registered, rejected, route_files
from runlens.operators.extract import base
from runlens.operators.extract.dstat import extract_samples, header_names
from runlens.operators.extract.flink import extract_task_states
from runlens.operators.extract.spark_tasks import extract_task_ends


def lines(spark, *values, file="f"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(values)], "file string, record_key bigint, value string")


def events(df, *columns):
    shown = accepted(df).withColumn("ms", F.unix_millis("v_timestamp"))
    return [tuple(r) for r in shown.orderBy("record_key", "ms", "name").select(*columns).collect()]


def test_older_log_lines(spark):
    chain = "CHAIN Source (at a.B$.main(C.scala:1) (x.TextFormat)) -> Combine(SUM(1))"
    got = extract_task_states(lines(
        spark,
        f"2019-02-03 04:05:06,000\t{chain}(1/40) switched to SCHEDULED ",
        "2019-02-03 04:05:13,123\tSink (Csv (path: hdfs://h:1/out, delimiter: ,))(3/75) switched to DEPLOYING ",
        "2019-02-03 04:05:13,123\tSink(3/75) switched to FAILED ",
        "2019-02-03 04:05:13,123\tSink(3/75) switched to CANCELED",
        "no clock\tSink(3/75) switched to RUNNING",
        "2019-02-03 04:05:14,000\tMap(9/9) switched to FINISHED",
        "2019-13-03 04:05:14,000\tMap(9/9) switched to FINISHED",
        "2019-02-03 04:05:14,000\tMap(99999999999/9) switched to RUNNING",
    ))
    assert events(got, "ms", "name", "task", "task_instance") == [
        (1549166706000, "state_change_scheduled", chain, 1),
        (1549166713123, "state_change_deploying", "Sink (Csv (path: hdfs://h:1/out, delimiter: ,))", 3),
        (1549166714000, "state_change_finished", "Map", 9),
    ]
    assert [r.reject_reason for r in rejected(got).orderBy("record_key").collect()] == [
        "bad timestamp", "task number out of range"
    ]


def test_newer_log_lines(spark):
    head = "2020-06-07 08:09:10,250 INFO  org.x.Graph        - "
    got = extract_task_states(lines(
        spark,
        head + "Map (a) -> Combine (b) (1/4) (3a95) switched from CREATED to SCHEDULED",
        head + "Map (a) (1/4) (3a95) switched from CREATED to SCHEDULED ",
        head + "first - second (2/4) (id7) switched from X to RUNNING",
        head + "Map (a) (1/4) (3a95) switched from RUNNING to FAILED",
    ))
    assert events(got, "ms", "name", "task", "task_instance") == [
        (1591517350250, "state_change_scheduled", "3a95 (Map (a) -> Combine (b))", 1),
        (1591517350250, "state_change_running", "id7 (second)", 2),
    ]


def task_end(**changes):
    info = {
        "Task ID": 41, "Index": 7, "Attempt": 0, "Launch Time": 1500000001234, "Executor ID": "3", "Host": "10.0.0.1",
        "Locality": "PROCESS_LOCAL", "Speculative": False, "Finish Time": 1500000005678, "Failed": False, "Accumulables": [],
    }
    event = {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Stage Attempt ID": 0, "Task Type": "ResultTask"}
    for k, v in changes.items():
        target, key = (info, k.replace("_", " ")) if k.replace("_", " ") in info else (event, k.replace("_", " "))
        target[key] = v
    event["Task Info"] = info
    return json.dumps({k: v for k, v in event.items() if v != "drop"})


def test_spark_task_ends(spark):
    got = extract_task_ends(lines(
        spark, task_end(), task_end(Failed=True), task_end(Event="SparkListenerJobEnd"), task_end(Stage_ID="drop"),
        "{broken", task_end(Index=None), '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Stage Attempt ID":0}',
    ))
    assert events(got, "name", "task", "task_instance", "v_long", "host", "ms") == [
        ("state_change_running", "stage-1#0", 41, 7, None, 1500000001234),
        ("state_change_finished", "stage-1#0", 41, 7, None, 1500000005678),
    ]
    assert [(r.record_key, r.reject_reason) for r in rejected(got).orderBy("record_key").collect()] == [
        (4, "malformed json"), (5, "incomplete task info"), (6, "incomplete task info"),
    ]


BANNER = [
    '"Dstat 0.7.2 CSV output"', '"Author:","A B <a@b.c>",,,,"URL:","http://x.y/"',
    '"Host:","h-11",,,,"User:","u"', '"Cmdline:","dstat --epoch",,,,"Date:","31 May 2016"', "",
]
FILE = "logs/dstat/dstat-user-node7.csv"


def test_dstat_samples(spark):
    got = extract_samples(lines(
        spark, *BANNER, '"epoch","total cpu usage",,"memory usage",', '"epoch","usr","sys","used","buff"',
        "1464692877.500,0.25,1.5,100.0,3", "1464692878.000,1,2", "1464692879,1,2,3,4", "1464692880.000,1,x,3,4", "", file=FILE,
    ))
    assert events(got, "ms", "name", "host", "v_double") == [
        (1464692877500, "dstat_memory_usage:buff", "node7", 3.0),
        (1464692877500, "dstat_memory_usage:used", "node7", 100.0),
        (1464692877500, "dstat_total_cpu_usage:sys", "node7", 1.5),
        (1464692877500, "dstat_total_cpu_usage:usr", "node7", 0.25),
        (1464692878000, "dstat_total_cpu_usage:sys", "node7", 2.0),
        (1464692878000, "dstat_total_cpu_usage:usr", "node7", 1.0),
        (1464692880000, "dstat_memory_usage:buff", "node7", 4.0),
        (1464692880000, "dstat_memory_usage:used", "node7", 3.0),
        (1464692880000, "dstat_total_cpu_usage:usr", "node7", 1.0),
    ]
    assert [r.reject_reason for r in rejected(got).orderBy("record_key").collect()] == ["bad epoch", "not a number"]


def test_dstat_repeated_names_take_the_last_value_the_row_has(spark):
    got = extract_samples(lines(spark, '"epoch","g",', '"epoch","c","c"', "1.0,5,6", "2.0,7", file=FILE))
    assert events(got, "ms", "name", "v_double") == [(1000, "dstat_g:c", 6.0), (2000, "dstat_g:c", 7.0)]


def test_dstat_without_header_or_clock(spark):
    got = extract_samples(lines(spark, "1.0,5", file="dstat-u-a.csv").unionByName(
        lines(spark, '"g","h"', '"c","d"', "1.0,5", file="dstat-u-b.csv")
    ))
    assert sorted((r.file, r.reject_reason) for r in rejected(got).collect()) == [
        ("dstat-u-a.csv", "no header"), ("dstat-u-b.csv", "no epoch column")
    ]


def test_header_names(spark):
    cells = {',"a b",,"c"': ["a_b", "a_b", "c"], '"x",,': ["x", "x", "x"], "plain": ["plain"]}
    for line, want in cells.items():
        assert spark.range(1).select(header_names(F.lit(line))).first()[0] == want


def test_routing_and_registration(spark):
    own = Extractor("own", "logs/flink", (r".*\.log",), "line", lambda lines: lines)
    rel = ["logs/flink/flink-u-jobmanager-h.log", "logs/spark/app-1-2", "other/app-1-2", "logs/dstat/dstat-u-h.csv.gz"]
    files = spark.createDataFrame([(r, r.split("/")[-1]) for r in rel], "rel string, file_name string")
    register_extractor(own)
    try:
        got = route_files(files, registered().values())
        assert sorted((r.rel, r.extractor, r.n_readers, r.n_extractors) for r in got.collect()) == [
            ("logs/flink/flink-u-jobmanager-h.log", "flink_tasks", 1, 2),
            ("logs/flink/flink-u-jobmanager-h.log", "own", 1, 2),
            ("logs/spark/app-1-2", "spark_tasks", 1, 1),
        ]
    finally:
        del base._REGISTRY["own"]


@pytest.mark.parametrize("shuffles", [1, 8])
def test_results_do_not_depend_on_shuffle_partitions(spark, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        got = extract_samples(lines(spark, '"epoch","g"', '"epoch","c"', *[f"{i}.0,{i}" for i in range(50)], file=FILE))
        assert [v for (v,) in events(got, "v_double")] == [float(i) for i in range(50)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
