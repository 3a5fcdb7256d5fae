import json
import os

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.identity import experiment_id, run_id
from runlens.plans import etl
from runlens.plans.analytics import register_sql, registered_queries, relations_of, run_query
from runlens.sources.event_csv import read_event_csv, write_event_csv
from runlens.sources.store import ConstraintError, ResultsStore


@pytest.fixture
def store(spark, tmp_path):
    s = ResultsStore(spark, str(tmp_path / "store"))
    s.create()
    return s


def systems(spark, *ids):
    return spark.createDataFrame([(i, "flink", "0.9") for i in ids], schemas.SYSTEM)


def experiments(spark, suite, *names, system="s1"):
    df = spark.createDataFrame([(n, suite, system) for n in names], "name string, suite string, system string")
    return df.select(experiment_id(F.col("name"), F.col("suite")).alias("id"), "name", "suite", "system")


def runs(spark, exps, numbers, exit=0, time=5):
    many = exps.select(F.col("id").alias("experiment_id"), "suite", F.explode(F.array(*[F.lit(n) for n in numbers])).alias("run"))
    return many.select(
        run_id(F.col("experiment_id"), F.col("run")).alias("id"), "experiment_id", "run", F.lit(exit).alias("exit"),
        F.lit(time).cast("bigint").alias("time"), "suite",
    )


def events(spark, run_rows, n=4):
    shapes = run_rows.select(F.col("id").alias("experiment_run_id"), "suite", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    kind = F.col("i") % 4
    return shapes.select(
        F.xxhash64("experiment_run_id", "i").alias("id"), "experiment_run_id",
        F.element_at(F.array(*map(F.lit, ["MEMORY_USED", "TASK_CREATED", "TASK_STATUS_CHANGE", "TASK_EXIT"])), kind + 1).alias("name"),
        F.lit(None).cast("string").alias("host"),
        F.when(kind == 1, F.repeat(F.lit("long task, \"x\"\n"), 200)).alias("task"),
        F.when(kind > 0, F.col("i")).alias("task_instance"),
        F.when(kind == 3, F.lit(42).cast("bigint")).alias("v_long"),
        F.when(kind == 0, F.col("i") + 5.0).alias("v_double"),
        F.when(kind == 1, F.timestamp_millis(F.lit(1500000001234).cast("bigint"))).alias("v_timestamp"),
        F.when(kind == 2, "RUNNING").alias("v_string"), "suite",
    )


def fill(spark, store, suite="s", names=("a", "b")):
    e = experiments(spark, suite, *names)
    r = runs(spark, e, [1, 2])
    store.append("system", systems(spark, "s1"))
    store.append("experiment", e)
    store.append("experiment_run", r)
    store.append("experiment_event", events(spark, r))
    return e, r


def counts(store):
    return [store.read(n).count() for n in ("system", "experiment", "experiment_run", "experiment_event")]


def test_create_fill_and_drop(spark, store):
    store.create()
    assert counts(store) == [0, 0, 0, 0]
    fill(spark, store)
    assert counts(store) == [1, 2, 4, 16]
    assert all(v.isEmpty() for v in store.violations().values())
    widest = store.read("experiment_event").agg(F.max(F.length("task"))).first()[0]
    assert widest == 1024
    store.drop()
    assert not store.exists("system")


def test_update_by_key(spark, store, rows):
    e, r = fill(spark, store)
    store.append("system", systems(spark, "s2"))
    store.update("experiment", e.withColumn("system", F.lit("s2")))
    assert {x.system for x in store.read("experiment").collect()} == {"s2"}
    store.update("experiment_run", r.where("run = 1").withColumn("time", F.lit(42).cast("bigint")))
    assert rows(store.read("experiment_run").select("run", "time").distinct()) == [(1, 42), (2, 5)]
    store.update("system", systems(spark, "s1").withColumn("version", F.lit("1.0")))
    assert rows(store.read("system"), "id", "version") == [("s1", "1.0"), ("s2", "0.9")]
    assert counts(store) == [2, 2, 4, 16]
    with pytest.raises(NotImplementedError):
        store.update("experiment_event", store.read("experiment_event"))


def test_insert_missing_compares_whole_rows(spark, store):
    store.append("system", systems(spark, "s1"))
    store.insert_missing("system", systems(spark, "s1", "s2"))
    store.insert_missing("system", systems(spark, "s1", "s2", "s2"))
    assert store.read("system").count() == 2
    store.insert_missing("system", systems(spark, "s1").withColumn("version", F.lit("other")))
    assert store.violations()["system.unique"].count() == 1


def test_deletes_follow_the_references(spark, store):
    e, r = fill(spark, store)
    fill(spark, store, suite="other", names=("c",))
    with pytest.raises(ConstraintError):
        store.delete("system", systems(spark, "s1"))
    store.delete("experiment_run", r.where("run = 2"))
    assert counts(store)[1:] == [3, 4, 16]
    store.delete("experiment", e)
    assert counts(store)[1:] == [1, 2, 8]
    assert store.read("experiment_run").select("suite").distinct().count() == 1
    store.delete("experiment", store.read("experiment"))
    assert counts(store)[1:] == [0, 0, 0]
    store.delete("system", systems(spark, "s1"))
    assert store.read("system").isEmpty()


def test_violations_are_found(spark, store):
    e, r = fill(spark, store)
    store.append("experiment_run", runs(spark, experiments(spark, "s", "ghost"), [1]))
    store.append("experiment", e.limit(1))
    found = store.violations()
    assert found["experiment_run.references"].count() == 1
    assert found["experiment.unique"].count() == 1
    assert found["experiment_event.references"].isEmpty()


def test_event_csv_keeps_every_value(spark, store, tmp_path, rows):
    _, r = fill(spark, store)
    written = events(spark, r).select(*schemas.EVENT_COLUMNS)
    odd = written.limit(1).withColumns({
        "id": F.lit(1).cast("bigint"), "host": F.lit('a"b,c'), "v_string": F.lit("two\nlines, \\ and \"quotes\""),
    })
    both = written.unionByName(odd)
    path = str(tmp_path / "events")
    write_event_csv(both, path)
    assert rows(read_event_csv(spark, path)) == rows(both)
    text = "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert "2017-07-14 02:40:01.234" in text


# -- import of plain run folders ----------------------------------------------------------------


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def state(**changes):
    base = {"command": "c", "runnerID": "flink-1.0", "runnerName": "flink", "runnerVersion": "1.0", "runExitCode": 0, "runTime": 10}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "drop"}, indent=1)


@pytest.fixture
def results(tmp_path):
    root = tmp_path / "results"
    log = "2019-02-03 04:05:06,000\tMap(1/4) switched to RUNNING \nnoise\n2019-02-03 04:05:07,000\tMap(1/4) switched to FINISHED \n"
    for name in ("wc.run01", "wc.run02"):
        write(root / "suite.a" / name / "state.json", state())
        write(root / "suite.a" / name / "logs/flink/flink-1/flink-u-jobmanager-h.log", log)
    write(root / "suite.a" / "wc.run03" / "state.json", state(runExitCode=None, plnExitCode=0))
    write(root / "suite.a" / "wc.run03" / "logs/flink/flink-1/flink-u-jobmanager-h.log", log)
    write(root / "suite.a" / "aa-unnamed" / "state.json", state())
    write(root / "suite.a" / "wc.run04" / "state.json", state(command="drop"))
    write(root / "suite.a" / "wc.run05" / "state.json", "{nonsense")
    write(root / "suite.a" / "datagen.words" / "run.out", "no state here")
    write(root / "suite.b" / "x+y z.run01" / "state.json", state(runnerID="spark-2", runnerName="spark", runnerVersion="2"))
    write(root / "suite.b" / "x+y z.run01" / "logs/dstat/dstat-u-n1.csv", '"epoch","cpu"\n"epoch","usr"\n1.5,0.5\n2.5,oops\n')
    return root


def test_import_of_run_folders(spark, store, results, rows):
    found = etl.import_suites(spark, str(results), store)
    assert rows(store.read("system"), "id") == [("flink-1.0",), ("spark-2",)]
    assert rows(store.read("experiment"), "name", "suite", "system") == [
        ("wc", "suite.a", "flink-1.0"), ("x+y z", "suite.b", "spark-2")
    ]
    assert rows(store.read("experiment_run"), "suite", "run", "exit", "time") == [
        ("suite.a", 1, 0, 10), ("suite.a", 2, 0, 10), ("suite.a", 3, -1, 10), ("suite.a", 4, 0, 10), ("suite.b", 1, 0, 10)
    ]
    # a state without run number sorts first and must not shift the others; run 3 failed
    per_run = store.read("experiment_event").join(
        store.read("experiment_run").select(F.col("id").alias("experiment_run_id"), "run"), "experiment_run_id"
    )
    assert rows(per_run.groupBy("suite", "run").count()) == [("suite.a", 1, 2), ("suite.a", 2, 2), ("suite.b", 1, 1)]
    assert rows(found.rejects, "name", "reason") == [
        ("aa-unnamed", "no run number in name"), ("wc.run04", "no command (kept)"), ("wc.run05", "malformed json"),
        ("x+y z.run01", "not a number"),
    ]
    assert all(v.isEmpty() for v in store.violations().values())


def test_import_twice_is_import_once(spark, store, results, rows):
    etl.import_suites(spark, str(results), store)
    names = ("system", "experiment", "experiment_run", "experiment_event")
    first = {n: rows(store.read(n)) for n in names}
    etl.import_suites(spark, str(results), store)
    assert {n: rows(store.read(n)) for n in names} == first


def test_refresh_leaves_other_suites_and_experiments_alone(spark, store, results):
    fill(spark, store, suite="suite.a", names=("kept",))
    fill(spark, store, suite="elsewhere", names=("also-kept",))
    etl.import_suites(spark, str(results), store)
    assert store.read("experiment").where("name in ('kept', 'also-kept')").count() == 2
    assert store.read("experiment_event").where("suite = 'elsewhere'").count() == 8


def test_queries_over_the_store(spark, store, rows):
    e = experiments(spark, "s", "three", "four")
    three = runs(spark, e.where("name = 'three'"), [1, 2, 3]).withColumn("time", F.element_at(F.array(*map(F.lit, [1, 9, 5])), F.col("run")).cast("bigint"))
    four = runs(spark, e.where("name = 'four'"), [1, 2, 3, 4]).withColumn("time", (F.col("run") * 10).cast("bigint"))
    store.append("experiment", e)
    store.append("experiment_run", three.unionByName(four))
    relations = relations_of(store)
    assert [tuple(r) for r in run_query("runtimes_for_suite", relations, suite="s").collect()] == [
        ("s", "four", 10, 40, 50), ("s", "three", 1, 9, 5)
    ]
    assert rows(run_query("median_runtime", relations), "name", "median") == [("four", 25.0), ("three", 5.0)]
    summary = {r.name: r for r in run_query("runtime_summary", relations).collect()}
    assert (str(summary["four"].average), summary["four"].median, summary["four"].number_of_runs) == ("0.03", 0.025, 4)
    assert run_query("run_details", relations).count() == 7
    register_sql("slow_runs", "SELECT id FROM experiment_run WHERE time >= :least")
    assert "slow_runs" in registered_queries()
    assert run_query("slow_runs", relations, least=9).count() == 5


def test_import_without_states(spark, store, tmp_path):
    (tmp_path / "empty" / "suite").mkdir(parents=True)
    (tmp_path / "empty" / "suite" / "note.txt").write_text("x")
    found = etl.import_suites(spark, str(tmp_path / "empty"), store)
    assert counts(store) == [0, 0, 0, 0] and found.rejects.isEmpty()


def test_states_are_the_only_files_opened(spark, results):
    from runlens.sources.states import scan_run_states

    states, rejects = scan_run_states(spark, str(results))
    assert {f.rsplit("/", 1)[-1] for f in states.inputFiles()} == {"state.json"}
    assert states.count() == 6 and rejects.count() == 2


def test_import_of_one_suite(spark, store, results, rows):
    etl.import_suites(spark, str(results), store, ["suite.b"])
    assert rows(store.read("experiment"), "suite") == [("suite.b",)]
    assert store.read("experiment_event").count() == 1
    with pytest.raises(ValueError):
        etl.import_suites(spark, str(results), store, ["suite.c"])
