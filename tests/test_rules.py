"""Keys that are kept, templates that are judged, sides that are measured, buckets that stay."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import aggregates, design
from runlens.operators import relational as rel
from runlens.plans.analytics import run_query
from runlens.session import broadcast_if_small, measure
from runlens.sources.store import ConstraintError, ResultsStore


def test_repeated_update_keys_raise(spark):
    current = spark.createDataFrame([(1, "a")], "id bigint, v string")
    with pytest.raises(ConstraintError):
        rel.update_by_key(current, spark.createDataFrame([(1, "b"), (1, "c")], "id bigint, v string"))


def test_inserts_keep_keys_nulls_and_references(spark, tmp_path):
    store = ResultsStore(spark, str(tmp_path / "store"))
    store.create()
    system = spark.createDataFrame([("s1", "s", "1")], "id string, name string, version string")
    store.insert("system", system)
    for bad in (system, system.union(system).withColumn("id", F.lit("s2")), system.withColumn("id", F.lit(None).cast("string")),
                system.withColumns({"id": F.lit("s3"), "name": F.lit(None).cast("string")})):
        with pytest.raises(ConstraintError):
            store.insert("system", bad)
    orphan = spark.createDataFrame([(1, "e", "suite", "other")], "id int, name string, suite string, system string")
    with pytest.raises(ConstraintError):
        store.insert("experiment", orphan)
    assert store.read("system").count() == 1 and store.read("experiment").isEmpty()


def test_templates_are_judged_before_they_are_filled(spark, rows):
    prototypes = spark.createDataFrame([(1, "run ${x}"), (2, "run __x__ __y__"), (3, None)], "id int, t string")
    good, bad = design.expand(prototypes, {"x": ["__q__", "b"]}, "t")
    assert rows(good, "id", "experiment") == [(1, "run __q__"), (1, "run b")]
    assert rows(bad, "id") == [(2,), (2,), (3,), (3,)]


def test_many_points_unfold_in_steps(spark):
    good, _ = design.expand(spark.createDataFrame([("a",)], "t string"), {"x": list(range(60)), "y": list(range(50))}, "t")
    assert good.select("point").distinct().count() == good.count() == 3000


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(4).select("id", F.expr("repeat('x', 1000)").alias("v"), F.array(F.expr("repeat('y', 500)")).alias("a"))
    n, size = measure(wide)
    assert n == 4 and 6000 < size < 8000
    hinted = broadcast_if_small(wide)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(wide, max_bytes=1000)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_reduce_does_not_depend_on_row_order(spark, rows):
    pairs = spark.range(4000).select((F.col("id") % 7).alias("k"), (F.col("id") % 101).alias("v"))
    want = rows(pairs.groupBy("k").agg(F.max("v")))
    for order in ("k", "v"):
        assert rows(aggregates.reduce_per_key(pairs.orderBy(order), "k", "v", max)) == want


def test_one_name_under_two_ids_is_one_row(spark):
    experiment = spark.createDataFrame([(1, "e", "s", "x"), (2, "e", "s", "x")], "id int, name string, suite string, system string")
    run = spark.createDataFrame([(1, 1, 1, 0, 10), (2, 1, 2, 0, 20), (3, 2, 1, 0, 60)], "id int, experiment_id int, run int, exit int, time bigint")
    relations = {"experiment": experiment, "experiment_run": run}
    (row,) = run_query("runtime_summary", relations).collect()
    assert (row["median"], row.number_of_runs) == (0.02, 3)
    assert [r["median"] for r in run_query("median_runtime", relations).collect()] == [20.0]


def test_tier_members(spark, rows):
    items = spark.range(1, 12)
    found = design.tier_members(items, "id", 2)
    assert rows(found.groupBy("tier").count()) == [("all", 11), ("top002", 2), ("top004", 4), ("top008", 8)]


def test_the_runs_are_scanned_once(spark, monkeypatch):
    """Figures of all experiments come from one pass over the runs, and few jobs."""
    from runlens.plans import analytics

    read, whole = [], analytics.counted_values
    monkeypatch.setattr(analytics, "counted_values", lambda df, *a: read.append(df) or whole(df, *a))
    experiment = spark.createDataFrame([(1, "e", "s", "x")], "id int, name string, suite string, system string")
    run = spark.createDataFrame([(i, 1, i, 0, i * i) for i in range(9)], "id int, experiment_id int, run int, exit int, time bigint")
    relations = {"experiment": experiment, "experiment_run": run}
    for name, column, want in (("runtime_summary", "median", 0.016), ("median_runtime", "median", 16.0)):
        found = run_query(name, relations)
        # the runs are not in the plan of the result: it reads the counts that were written
        assert len(read) == 1 and "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.first()[column] == want
        read.clear()
