"""Commits of the store: all or nothing, each row written once, keys checked before the switch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from runlens.sources.store import PARENT_FIRST, ConflictError, ConstraintError, ResultsStore
from test_store import counts, events, experiments, fill, runs, store, systems  # noqa: F401


def everything(store, rows):  # noqa: F811
    return {n: rows(store.read(n)) for n in PARENT_FIRST}


def again(spark, suite="s", names=("a", "b"), time=9):
    e = experiments(spark, suite, *names)
    r = runs(spark, e, [1, 2, 3], time=time)
    return systems(spark, "s1"), e, r, events(spark, r)


@pytest.mark.parametrize("step, times", [("_write", 3), ("_check", 1), ("_switch", 1)])
def test_a_refresh_that_dies_changes_nothing(spark, store, rows, monkeypatch, step, times):  # noqa: F811
    fill(spark, store)
    before, versions = everything(store, rows), store.versions()
    whole, calls = getattr(ResultsStore, step), []

    def dies(self, *args):
        calls.append(step)
        if len(calls) == times or step == "_switch":
            raise OSError("gone")
        return whole(self, *args)

    with monkeypatch.context() as m:
        m.setattr(ResultsStore, step, dies)
        with pytest.raises(OSError):
            store.refresh_suites(*again(spark))
    assert everything(store, rows) == before and store.versions() == versions
    store.refresh_suites(*again(spark))
    assert counts(store) == [1, 2, 6, 24] and {r.time for r in store.read("experiment_run").collect()} == {9}
    assert store.versions() == [*versions, versions[-1] + 1]


def test_a_refresh_writes_new_rows_once_and_no_others(spark, store):  # noqa: F811
    fill(spark, store, names=("a", "b", "stays"))
    store.refresh_suites(*again(spark))
    _, snapshot = store._current()
    for name, new in (("experiment", 2), ("experiment_run", 6), ("experiment_event", 24)):
        commit, part = snapshot[name]["data"][-1]
        assert spark.read.parquet(store._folder(name, commit, part)).count() == new
        assert len(snapshot[name]["data"]) == 2
    assert counts(store) == [1, 3, 8, 32]
    assert snapshot["system"]["data"][0][0] < commit


def test_a_refresh_checks_all_relations(spark, store, rows):  # noqa: F811
    fill(spark, store, names=("a", "stays"))
    before = everything(store, rows)
    s, e, r, v = again(spark, names=("a",))
    stays = store.read("experiment_run").where("run = 1").join(store.read("experiment").where("name = 'stays'").select(F.col("id").alias("experiment_id")), "experiment_id")
    bad = {
        "experiment_run: id taken": (s, e, r.unionByName(stays.select(*r.columns).withColumn("experiment_id", F.lit(e.first().id))), v),
        "experiment_event: repeated": (s, e, r, v.unionByName(v.limit(1))),
        "experiment: no system": (s, e.withColumn("system", F.lit("s9")), r, v),
        "system: id taken": (s.withColumn("version", F.lit("other")), e, r, v),
    }
    for message, parts in bad.items():
        with pytest.raises(ConstraintError, match=message):
            store.refresh_suites(*parts)
        assert everything(store, rows) == before


def test_compaction_and_old_snapshots(spark, store, rows):  # noqa: F811
    e, r = fill(spark, store)
    first = store.versions()[-1]
    store.delete("experiment_run", r.where("run = 2"))
    store.update("experiment", e.limit(1).withColumn("name", F.lit("renamed")))
    store.refresh_suites(*again(spark, names=("c",)))
    now, old = everything(store, rows), rows(store.read("experiment_run", first))
    store.compact()
    assert everything(store, rows) == now and rows(store.read("experiment_run", first)) == old and len(old) == 4
    _, snapshot = store._current()
    assert all(not entry["gone"] and len(entry["data"]) == 1 for entry in snapshot.values())
    last = store.versions()[-1]
    store.compact()
    assert store.versions()[-1] == last
    store.vacuum()
    assert store.versions() == [last] and everything(store, rows) == now
    left = [d for d in os.listdir(store.root) if "-gone-" in d and any(os.listdir(f"{store.root}/{d}/{c}") for c in os.listdir(f"{store.root}/{d}"))]
    assert not left
    store.append("system", systems(spark, "s7"))
    assert counts(store)[0] == 2


def test_one_of_two_commits_fails(spark, store):  # noqa: F811
    version, snapshot = store._current()
    store.append("system", systems(spark, "s1"))
    with pytest.raises(ConflictError):
        store._switch(version + 1, snapshot)
    assert counts(store)[0] == 1
    names = os.listdir(f"{store.root}/_snapshots")
    assert not [n for n in names if n.startswith(f".{version + 1:08d}-")]
    with open(f"{store.root}/_snapshots/{version + 1:08d}.json") as f:
        assert set(json.load(f)) == set(PARENT_FIRST)


def test_deletes_are_broadcast_and_suites_pruned(spark, store):  # noqa: F811
    e, _ = fill(spark, store)
    fill(spark, store, suite="other", names=("c",))
    store.delete("experiment", e.limit(1))
    plan = store.read("experiment_event").where("suite = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "PartitionFilters: [isnotnull(suite" in plan
