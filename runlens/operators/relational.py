"""Keyed maintenance of relations.

What comes in (new rows, updates, victims) is usually small next to what is stored. Its size is
checked first: small sides are broadcast, so stored relations are streamed and never shuffled; large
ones go through shuffle joins, where AQE splits hot keys.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runlens.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, cut_lineage, key_side, measure


class ConstraintError(ValueError):
    """A key, null or reference rule of a relation does not hold."""


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """Raise if a key is null or occurs more than once. Runs a job."""
    found = [r[0] for r in duplicate_keys(df, [key]).select(key).take(5)]
    if found:
        raise ConstraintError(f"{what}: repeated or null {key}, e.g. {found}")


def _equal(left: str, right: str, columns: Sequence[str]) -> Column:
    tests = [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns]
    return functools.reduce(Column.__and__, tests)


def append(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.unionByName(new)


def missing_rows(current: DataFrame, new: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct rows of ``new`` that ``current`` does not hold, comparing whole rows; null equals null.

    Few new rows are broadcast against the stored ones. Many are grouped together with them, which
    folds copies on either side before the shuffle.
    """
    columns = current.columns
    fresh = cut_lineage(new.select(*columns).distinct())
    n, size = measure(fresh)
    if n <= max_rows and size <= BROADCAST_BYTES:
        cond = _equal("c", "n", columns)
        known = current.alias("c").join(F.broadcast(fresh).alias("n"), cond, "left_semi").distinct()
        return fresh.alias("n").join(known.alias("c"), cond, "left_anti")
    both = fresh.withColumn("__stored", F.lit(0)).unionByName(current.withColumn("__stored", F.lit(1)))
    return both.groupBy(*columns).agg(F.max("__stored").alias("__s")).where(F.col("__s") == 0).select(*columns)


def insert_missing(current: DataFrame, new: DataFrame) -> DataFrame:
    return append(current, missing_rows(current, new))


def update_by_key(current: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a matching key take every non-key column from ``updates``.

    A key that is updated twice, or null, raises ``ConstraintError``. Runs jobs.
    """
    others = [c for c in current.columns if c != key]
    changes = cut_lineage(updates.select(key, *others, F.lit(True).alias("__hit")))
    require_unique(changes, key, "updates")
    marked = broadcast_if_small(changes)
    joined = current.alias("c").join(marked.alias("u"), F.col(f"c.{key}") == F.col(f"u.{key}"), "left")
    hit = F.col("u.__hit")
    cells = {c: F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in others}
    return joined.select(*[cells.get(c, F.col(f"c.{c}")) for c in current.columns])


def delete_by_key(current: DataFrame, victims: DataFrame, key: str = "id") -> DataFrame:
    return current.join(key_side(victims.select(key)), key, "left_anti").select(*current.columns)


def cascade(
    experiments: DataFrame, runs: DataFrame, events: DataFrame, victims: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Survivors of the three relations after deleting ``victims`` (experiment ids) with their children."""
    gone = key_side(victims.select(F.col("id").alias("experiment_id")))
    dead_runs = key_side(runs.join(gone, "experiment_id", "left_semi").select(F.col("id").alias("experiment_run_id")))
    return (
        experiments.join(gone, experiments.id == gone.experiment_id, "left_anti"),
        runs.join(gone, "experiment_id", "left_anti").select(*runs.columns),
        events.join(dead_runs, "experiment_run_id", "left_anti").select(*events.columns),
    )


def restrict_violations(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that may not go because a child still refers to them, with the number of children."""
    counts = children.groupBy(F.col(child_key).alias("__p")).agg(F.count(F.lit(1)).alias("n_children"))
    joined = parents.join(counts, F.col(parent_key) == F.col("__p"))
    return joined.select(F.col(parent_key), "n_children")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (or are null), with their counts."""
    null_key = functools.reduce(Column.__or__, [F.col(k).isNull() for k in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null_key)


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n) of the not-null columns that hold nulls; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]
    return counts.select(F.inline(F.array(*pairs))).where(F.col("n") > 0)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Missing parent values with the number of rows that name them.

    Children are counted per key before the join, so a hot missing parent is one row by then.
    """
    counts = children.groupBy(child_key).agg(F.count(F.lit(1)).alias("n"))
    known = parents.select(F.col(parent_key).alias("__p"))
    return counts.join(known, F.col(child_key) == F.col("__p"), "left_anti")
