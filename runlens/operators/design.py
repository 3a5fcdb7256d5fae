"""Relations used to design experiments: parameter grids, tiers, plans."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runlens.functions.text import cut_template, fill_template, unknown_keys
from runlens.operators.ordering import by_key, by_range, position_within
from runlens.session import cut_lineage


# A list up to this length is numbered in one task.
SINGLE_TASK_ROWS = 100_000
# Grid points that a prototype unfolds at a time.
POINTS_AT_ONCE = 1024

ValueList = Sequence[Any] | DataFrame
"""Values of one parameter: given outright, or as an (index, value) table from ``indexed_values``."""


def indexed_values(df: DataFrame, column: str) -> DataFrame:
    """(index, value): the distinct values of a column, numbered from 0 in order. Runs jobs."""
    values = cut_lineage(df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct())
    n = values.count()
    if n <= SINGLE_TASK_ROWS:
        return values.select((F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("index"), "value")
    placed = position_within(by_range(values, ["value"], rows=n), [], ["value"], "__p")
    return placed.select((F.col("__p") - 1).alias("index"), "value")


def _sizes(parameters: Mapping[str, ValueList]) -> dict[str, int]:
    sizes = {n: v.count() if isinstance(v, DataFrame) else len(v) for n, v in parameters.items()}
    if not sizes or 0 in sizes.values():
        raise ValueError(f"every parameter needs values: {sizes}")
    return sizes


def _attach(points: DataFrame, name: str, values: ValueList, at: Column) -> DataFrame:
    """Value number ``at`` of a list: an array access, or an equi-join on the index of its table."""
    if not isinstance(values, DataFrame):
        return points.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int")))
    side = values.select(F.col("index").alias("__i"), F.col("value").alias(name))
    return points.withColumn("__at", at).join(side, F.col("__at") == F.col("__i")).drop("__at", "__i")


def _attach_crossed(points: DataFrame, parameters: Mapping[str, ValueList], sizes: Mapping[str, int]) -> DataFrame:
    """Read ``point`` as a mixed-radix number, first parameter slowest: no table is multiplied."""
    stride = math.prod(sizes.values())
    for name, values in parameters.items():
        stride //= sizes[name]
        points = _attach(points, name, values, F.floor(F.col("point") / stride) % sizes[name])
    return points


def grid_crossed(spark: SparkSession, parameters: Mapping[str, ValueList]) -> DataFrame:
    """(point, one column per parameter): all combinations."""
    sizes = _sizes(parameters)
    points = spark.range(math.prod(sizes.values())).withColumnRenamed("id", "point")
    return _attach_crossed(points, parameters, sizes)


def grid_simple(spark: SparkSession, name: str, values: ValueList) -> DataFrame:
    """One parameter, one row per value."""
    return grid_crossed(spark, {name: values})


def grid_zipped(spark: SparkSession, parameters: Mapping[str, ValueList]) -> DataFrame:
    """Value lists side by side; they must be of one length."""
    sizes = _sizes(parameters)
    if len(set(sizes.values())) != 1:
        raise ValueError(f"zipped parameters need value lists of one length: {sizes}")
    points = spark.range(next(iter(sizes.values()))).withColumnRenamed("id", "point")
    for name, values in parameters.items():
        points = _attach(points, name, values, F.col("point"))
    return points


def expand_flagged(
    prototypes: DataFrame, parameters: Mapping[str, ValueList], template: str, out: str = "experiment", flag: str = "rejected"
) -> DataFrame:
    """Every prototype at every crossed grid point, ``__key__`` and ``${key}`` filled in, and whether it is a reject.

    A template is judged by the keys it names, before any value is put in; a null template is a reject too. Both that and
    the cutting of the template are done once per prototype. Grid points unfold in two steps, so no row ever holds a list of all of them.
    """
    sizes = _sizes(parameters)
    total = math.prod(sizes.values())
    unsound = F.col(template).isNull() | (F.size(unknown_keys(F.col(template), {p: F.col(p) for p in parameters})) > 0)
    judged = prototypes.select("*", unsound.alias(flag), cut_template(F.col(template), list(parameters)).alias("__cut"))
    # steps keep the list that one row unfolds short, whatever the number of points
    steps = judged.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // POINTS_AT_ONCE).cast("long"))).alias("__step"))
    first = F.col("__step") * POINTS_AT_ONCE
    last = F.least(first + POINTS_AT_ONCE, F.lit(total).cast("long")) - 1
    points = steps.select("*", F.explode(F.sequence(first, last)).alias("point")).drop("__step")
    flat = _attach_crossed(points, parameters, sizes)
    return flat.withColumn(out, fill_template(F.col("__cut"), [F.col(p) for p in parameters])).drop("__cut")


def expand(
    prototypes: DataFrame, parameters: Mapping[str, ValueList], template: str, out: str = "experiment"
) -> tuple[DataFrame, DataFrame]:
    """(experiments, rejects) of ``expand_flagged``. A frame that takes both in is better made from that one."""
    flagged = expand_flagged(prototypes, parameters, template, out, "__rejected")
    return flagged.where(~F.col("__rejected")).drop("__rejected"), flagged.where("__rejected").drop("__rejected")


def tier_sizes(total: int, unit: int) -> list[int]:
    """unit, 2*unit, 4*unit ... up to ``total``."""
    sizes, k = [], unit
    while k <= total:
        sizes.append(k)
        k *= 2
    return sizes


def scaleout_tiers(items: DataFrame, key: str, unit: int, parallelism: Column, memory: Column) -> DataFrame:
    """(tier, hosts, parallelism, memory) for all items and for the first unit * 2**i by key.

    Item of rank r belongs to every tier k >= r. Ranks are summed per smallest tier first (few
    rows), then accumulated over the tiers, instead of joining items to tiers.
    """
    ranked = position_within(by_key(items, key), [], [key], "rank")
    over = F.ceil(F.col("rank") / unit)
    # smallest i with unit * 2**i >= rank, as a number of binary digits
    level = F.when(over <= 1, 0).otherwise(F.length(F.bin(over - 1)))
    per_level = ranked.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(parallelism).alias("p"), F.sum(memory).alias("m")
    )
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # log2(items) rows
    sums = per_level.select(
        "level", F.sum("n").over(upto).alias("hosts"), F.sum("p").over(upto).alias("parallelism"),
        F.sum("m").over(upto).alias("memory"),
    )
    size = F.lit(unit) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    named = sums.where(F.col("hosts") == size).select(
        F.format_string("top%03d", size).alias("tier"),
        "hosts", "parallelism", "memory",
    )
    whole = per_level.agg(F.sum("n").alias("hosts"), F.sum("p").alias("parallelism"), F.sum("m").alias("memory"))
    return whole.select(F.lit("all").alias("tier"), "hosts", "parallelism", "memory").unionByName(named)


def tier_members(items: DataFrame, key: str, unit: int) -> DataFrame:
    """(tier, key, rank) of the items in the first unit * 2**i by key, for every tier that is full, and in ``all``.

    An item unfolds the tiers it is in, from the smallest that holds its rank up to the largest full one.
    """
    ranked = position_within(by_key(items.select(key), key), [], [key], "rank")
    total = items.count()
    full = len(tier_sizes(total, unit))
    over = F.ceil(F.col("rank") / unit)
    level = F.when(over <= 1, 0).otherwise(F.length(F.bin(over - 1)))
    levels = F.when(level < full, F.sequence(level.cast("int"), F.lit(full - 1))).otherwise(F.array().cast("array<int>"))
    size = F.lit(unit) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__level"))
    inside = ranked.select(key, "rank", F.explode(levels).alias("__level"))
    return inside.select(F.format_string("top%03d", size).alias("tier"), key, "rank").unionByName(
        ranked.select(F.lit("all").alias("tier"), key, "rank")
    )


def pending_runs(
    experiments: DataFrame, runs: DataFrame, keys: Sequence[str], planned: str = "runs", force: bool = False
) -> DataFrame:
    """Runs 1 .. planned per experiment that have not succeeded yet; all of them when forced."""
    plan = F.when(F.col(planned) >= 1, F.sequence(F.lit(1), F.col(planned)))
    wanted = experiments.select(*keys, F.explode(plan).alias("run"))
    if force:
        return wanted
    # repeated runs fold before the shuffle, which then serves the join as well
    done = runs.where(F.col("exit") == 0).select(*keys, "run").distinct()
    return wanted.join(done, [*keys, "run"], "left_anti")
