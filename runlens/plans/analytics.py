"""Result queries over the stored relations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from runlens.operators.aggregates import MAX_GROUP, counted_values, median_of_counts
from runlens.session import broadcast_if_small, cut_lineage, key_side
from runlens.sources.store import PARENT_FIRST, ResultsStore

QueryFn = Callable[..., DataFrame]
_QUERIES: dict[str, QueryFn] = {}


def register_query(name: str, fn: QueryFn | None = None):
    """Add a named result query ``fn(relations, **params)``; usable as a decorator."""
    if fn is None:
        return lambda f: register_query(name, f)
    _QUERIES[name] = fn
    return fn


def register_sql(name: str, text: str) -> QueryFn:
    """Add a query given as SQL over the relation names, with ``:name`` parameters."""

    def run(relations: dict[str, DataFrame], **params: Any) -> DataFrame:
        return run_sql(text, relations, **params)

    return register_query(name, run)


def registered_queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def run_query(name: str, relations: dict[str, DataFrame], **params: Any) -> DataFrame:
    return _QUERIES[name](relations, **params)


def _times_per_experiment(runs: DataFrame) -> DataFrame:
    """Run times folded per experiment before anything is joined: a hot experiment is one row."""
    return runs.groupBy("experiment_id").agg(
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.sum("time").alias("sum_time"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def _folded(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Times per (suite, name)."""
    times = _times_per_experiment(runs)
    joined = experiments.join(times, experiments.id == times.experiment_id)
    return joined.groupBy("suite", "name").agg(
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
        F.sum("sum_time").alias("sum_time"), F.sum("n_runs").alias("n_runs"),
    )


def _counted_times(relations: dict[str, DataFrame]) -> DataFrame:
    """(suite, name, time, n): run times are counted per experiment id before anything is joined, in one pass over the runs."""
    counted = counted_values(relations["experiment_run"].select("experiment_id", "time"), ["experiment_id"], "time")
    named = relations["experiment"].select("id", "suite", "name")
    joined = counted.join(named, counted.experiment_id == named.id)
    # ids are folded again: a (suite, name) may have several
    return joined.groupBy("suite", "name", "time").agg(F.sum("n").alias("n"))


@register_query("runtimes_for_suite")
def runtimes_for_suite(relations: dict[str, DataFrame], suite: str) -> DataFrame:
    """Shortest, longest and "median" run time per experiment of a suite.

    The median is sum - min - max, right for exactly three runs. Failed runs count. The suite
    predicate reaches the experiment scan and, in a store, prunes the partitions of the runs.
    """
    chosen, runs = relations["experiment"].where(F.col("suite") == suite), relations["experiment_run"]
    if "suite" in runs.columns:  # stored runs are partitioned by it
        runs = runs.where(F.col("suite") == suite)
    else:
        wanted = key_side(chosen.select(F.col("id").alias("experiment_id")))
        runs = runs.join(wanted, "experiment_id", "left_semi")
    return _folded(runs, chosen).select(
        "suite", "name", "min_time", "max_time",
        (F.col("sum_time") - F.col("min_time") - F.col("max_time")).alias("median_time"),
    ).orderBy("suite", "name")


@register_query("median_runtime")
def median_runtime(relations: dict[str, DataFrame]) -> DataFrame:
    """True median run time (ms) per experiment, which is a (suite, name), whatever ids it has. Reads the runs once."""
    return median_of_counts(cut_lineage(_counted_times(relations)), ["suite", "name"], "time")


@register_query("runtime_summary")
def runtime_summary(relations: dict[str, DataFrame]) -> DataFrame:
    """Average, median, longest and shortest run time in seconds and the number of runs.

    The runs are read once; all figures come from the counts of their times.
    """
    times, by = cut_lineage(_counted_times(relations)), ["suite", "name"]
    folds = [
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.sum(F.col("time") * F.col("n")).alias("sum_time"),
        F.sum("n").alias("n_runs"),
    ]
    largest = times.groupBy(*by).agg(F.count(F.lit(1)).alias("values")).agg(F.max("values")).first()[0] or 0
    if largest <= MAX_GROUP:
        joined = times.groupBy(*by).agg(*folds, F.percentile("time", 0.5, F.col("n")).alias("median"))
    else:
        joined = times.groupBy(*by).agg(*folds).join(median_of_counts(times, by, "time"), by)
    seconds = F.lit(1000.0)
    average = F.round(F.col("sum_time") / F.col("n_runs") / seconds, 2).cast("decimal(18,2)")
    return joined.select(
        "name", "suite", average.alias("average"), (F.col("median") / seconds).alias("median"),
        (F.col("max_time") / seconds).alias("max"), (F.col("min_time") / seconds).alias("min"),
        F.col("n_runs").alias("number_of_runs"),
    ).orderBy("name", "suite")


@register_query("run_details")
def run_details(relations: dict[str, DataFrame]) -> DataFrame:
    """Every run with the name and suite of its experiment, unordered.

    Experiments are counted first: while they can be broadcast, runs are not shuffled.
    """
    named = broadcast_if_small(relations["experiment"].select("id", "name", "suite"))
    e, r = named.alias("e"), relations["experiment_run"].alias("r")
    return r.join(e, F.col("e.id") == F.col("r.experiment_id")).select(
        "e.name", "e.suite", F.col("r.time").alias("runtime"), "r.run"
    )


def relations_of(store: ResultsStore) -> dict[str, DataFrame]:
    """The four relations of a results store."""
    return {name: store.read(name) for name in PARENT_FIRST}


def run_sql(text: str, relations: dict[str, DataFrame], **params: Any) -> DataFrame:
    """Ad-hoc SQL over the relations, registered as temporary views."""
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    return next(iter(relations.values())).sparkSession.sql(text, args=params or None)
