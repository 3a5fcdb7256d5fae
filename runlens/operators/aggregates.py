"""Aggregations: every one combines before it shuffles and keeps bounded state per group."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.session import broadcast_if_small, cut_lineage

# Bars of the histograms that narrow a median down.
BUCKETS = 4_096
SALTS = 64
# Distinct values of a group that one task may hold.
MAX_GROUP = 1_000_000
# Distinct keys a combining task may hold before it hands its rows on.
COMBINE_ROWS = 100_000


def word_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, n): lower-cased words split on non-word characters.

    Same tokens as ``functions.word_tokens``, kept as a generator plus filter so that the whole map
    side is one generated stage: a token is empty only at either end of the split, the first one
    counts when anything follows it, the last one never does.
    """
    text = F.lower(F.col(line))
    tokens = lines.select(F.posexplode(F.split(text, r"\W+")).alias("at", "word"), F.col(line).alias("__line"))
    leading = (F.col("at") == 0) & ((F.col("__line") == "") | F.col("__line").rlike(r"\w"))
    return (
        tokens.where((F.col("word") != "") | leading)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def max_length_per_key(pairs: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Longest value length per key; lengths are projected first, so no string is shuffled."""
    lengths = pairs.select(F.col(key), F.length(value).alias("len"))
    return lengths.groupBy(key).agg(F.max("len").alias("max_len"))


def max_value_per_key(pairs: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Lexicographically largest value per key.

    A string buffer rules out the fixed-width hash table, so Spark plans a combining sort
    aggregation here where ``max_length_per_key`` gets a hash aggregation.
    """
    return pairs.groupBy(key).agg(F.max(value).alias("max_value"))


def reduce_per_key(
    df: DataFrame, key: str, value: str, fn: Callable[[Any, Any], Any], salts: int = SALTS
) -> DataFrame:
    """Fold the values of each key with an associative, commutative Python function.

    Combines inside every task, then in ``salts`` buckets per key, then per key: the last step sees
    one row per bucket, whatever the number of rows of its key. Each step streams Arrow batches; the
    last one reads them in key order and holds a single key across batches.
    """
    pairs = df.select(key, value)
    schema = pairs.schema

    def fold(batch, held: dict) -> dict:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[k] = fn(held[k], v) if k in held else v
        return held

    def to_batch(held: dict, like: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(part, type=field.type) for part, field in zip((held.keys(), held.values()), like)]
        return pa.RecordBatch.from_arrays(columns, schema=like)

    def combine(batches):
        held, like = {}, None
        for batch in batches:
            like = batch.schema
            held = fold(batch, held)
            if len(held) > COMBINE_ROWS:
                yield to_batch(held, like)
                held = {}
        if held:
            yield to_batch(held, like)

    def finish(batches):
        held, like = {}, None
        for batch in batches:
            like = batch.schema
            held = fold(batch, held)
            if held:
                # later batches can only go on with the last key
                last = next(reversed(held))
                rest = held.pop(last)
                if held:
                    yield to_batch(held, like)
                held = {last: rest}
        if held:
            yield to_batch(held, like)

    partial = pairs.mapInArrow(combine, schema)
    # the bucket follows from the value: a task that is done again deals its rows as before
    salted = partial.withColumn("__salt", F.pmod(F.xxhash64(F.col(value)), F.lit(salts)))
    buckets = salted.repartition(key, "__salt").select(key, value).mapInArrow(combine, schema)
    return buckets.repartition(key).sortWithinPartitions(key).mapInArrow(finish, schema)


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value occurs, as a table. Combines before it shuffles; the one pass over the rows.

    Nulls do not count. Runs a job.
    """
    rows = df.where(F.col(value).isNotNull())
    return cut_lineage(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counted")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", max_group: int = MAX_GROUP
) -> DataFrame:
    """Exact median (mean of the two middle values) per group; nulls do not count. Runs jobs.

    Rows are read once, to count their values.
    """
    return median_of_counts(counted_values(df, keys, value), keys, value, out, max_group)


def median_of_counts(
    counted: DataFrame, keys: Sequence[str], value: str, out: str = "median", max_group: int = MAX_GROUP
) -> DataFrame:
    """Median per group of values that occur ``n`` times.

    The built-in percentile holds the distinct values of a group in one task, so it gets the groups of at most
    ``max_group`` of them; those of others are narrowed down by histograms. Runs a job to find the latter.
    """
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_group).select(*keys)
    hot = cut_lineage(sizes)
    if hot.isEmpty():
        return _plain_median(counted, keys, value, out)
    side, cond = broadcast_if_small(hot).alias("s"), _same_keys(keys)
    cold_rows = counted.alias("r").join(side, cond, "left_anti")
    hot_rows = counted.alias("r").join(side, cond, "left_semi")
    return _plain_median(cold_rows, keys, value, out).unionByName(_narrowed_median(hot_rows, keys, value, out))


def _same_keys(keys: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])


def _plain_median(counted: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return counted.groupBy(*keys).agg(F.percentile(value, 0.5, F.col("n")).alias(out))


def _narrowed_median(counted: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Median of groups with many distinct values: a histogram of ``BUCKETS`` between bounds that enclose the middle, until the
    middle ranks are found.

    Where both middle ranks fall into one bucket, its least and largest value are the next bounds; else they are the last value of
    one bucket and the first of the next. Groups are few, and have one row per bucket.
    """
    rank = lambda x: F.floor((F.sum("n") + x) / 2)
    open_ = counted.groupBy(*keys).agg(
        F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"), F.lit(0).cast("long").alias("__below"),
        rank(1).alias("__r1"), rank(2).alias("__r2"),
    )
    bounds, done = ["__lo", "__hi", "__below", "__r1", "__r2"], []
    while True:
        open_ = cut_lineage(open_, "bounds")
        done.append(open_.where("__lo = __hi").select(*keys, F.col("__lo").alias(out)))
        left = open_.where("__lo < __hi")
        if left.isEmpty():
            break
        v = F.col(f"r.{value}").cast("double")
        near = counted.alias("r").join(broadcast_if_small(left).alias("s"), _same_keys(keys)).where(v.between(F.col("__lo"), F.col("__hi")))
        # halves first: the difference of two doubles can overflow
        place = (v / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
        bucket = F.least(F.floor(place * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
        placed = near.select(*[F.col(f"r.{k}") for k in keys], *bounds, v.alias("__v"), "n", bucket.alias("__bucket"))
        bars = placed.groupBy(*keys, *bounds, "__bucket").agg(F.sum("n").alias("__n"), F.min("__v").alias("__first"), F.max("__v").alias("__last"))
        upto = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = bars.withColumn("__upto", F.col("__below") + F.sum("__n").over(upto))
        of = lambda r, x: F.min_by(x, F.when(F.col("__upto") >= F.col(r), F.col("__bucket")))
        found = summed.groupBy(*keys, "__r1", "__r2").agg(
            of("__r1", F.struct("__bucket", "__first", "__last", (F.col("__upto") - F.col("__n")).alias("below"))).alias("__a"),
            of("__r2", F.struct("__bucket", "__first", "__last")).alias("__z"),
        )
        found = cut_lineage(found, "middle")
        apart = F.col("__a.__bucket") < F.col("__z.__bucket")
        done.append(found.where(apart).select(*keys, ((F.col("__a.__last") + F.col("__z.__first")) / 2).alias(out)))
        open_ = found.where(~apart).select(
            *keys, F.col("__a.__first").alias("__lo"), F.col("__a.__last").alias("__hi"), F.col("__a.below").alias("__below"), "__r1", "__r2"
        )
    return functools.reduce(DataFrame.unionByName, done)


def per_group_stats(events: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of emissions and mean value per group."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("emissions"), F.avg(value).alias("avg_records"))


def marker_counts(lines: DataFrame, markers: Sequence[str], file: str = "file", line: str = "value") -> DataFrame:
    """Lines per (file, marker) that contain the marker; one pass, one counter per marker."""
    counters = [F.count_if(F.col(line).contains(m)).alias(f"__m{i}") for i, m in enumerate(markers)]
    counts = lines.groupBy(file).agg(*counters)
    pairs = [F.struct(F.lit(m).alias("marker"), F.col(f"__m{i}").alias("n")) for i, m in enumerate(markers)]
    return counts.select(file, F.inline(F.array(*pairs))).where(F.col("n") > 0)
