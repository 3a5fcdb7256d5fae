"""Mixing sources to target weights by weighted fair queueing, in built-in functions only.

Every document gets a place in its source's shuffled order. The virtual finish time of its k-th copy is
the words of the source up to and including it, divided by the source's target. Served in
order of finish time, all sources fill up at the speed of their targets; the queue is cut where the
total budget is used up.

Defined cases: null text has size 0. A null source is a source of its own and comes last. Sources without
words get the target 0. Rows that agree in id and size may stand in either order, which changes
nothing one can see. Null ids are allowed. An empty table gives an empty result.

No source is sorted in one task: the shuffled order is cut into chunks by hash prefix, and chunk totals
carry the sums across. The global order is range-partitioned; only partition totals meet in one place.
One task sees a row per source, and one per range partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.llm.common import WORD, row_key, table
from runlens.session import broadcast_if_small

CHUNK_ROWS = 20_000
RANGE_ROWS = 1_000_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, none above ``most`` times its size.

    Sources are weighed by rank in code-point order, the weights repeating. Filling up to a common level is
    what resharing an excess again and again ends in: with sources sorted by the level at which they are
    full, those before the first one that the level does not fill are full.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sources.withColumn("weight", weigh)
        .withColumns({"most": F.col("source_size") * F.lit(float(most))})
        .withColumns({"full_at": F.col("most") / F.col("weight")})
        .withColumns(
            {
                "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
                "full_before": F.coalesce(F.sum("most").over(by_level), F.lit(0.0)),
                "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)),
            }
        )
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    )
    # the level of the first source that it does not fill; the largest level if all are full
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    target = F.when(level.isNull() | (F.col("full_at") <= level), F.col("most")).otherwise(F.col("weight") * level)
    return placed.select("source", "source_size", target.alias("target"))


def _shuffled(seed: str, text: str, id_column: str) -> Column:
    """Place in the shuffled order of a source. The text counts as well: rows without an id, or of one id, are spread too."""
    name, body = F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(body.cast("binary"))).cast("binary"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    copies: int = 2,
    seed: str = "mix",
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """The row's key, its id (as ``doc_id``), source, size, source_size, target, copies taken and taken words. Runs jobs."""
    sizes = table(
        docs.select(
            row_key(id_column, text).alias("key"),
            F.col(id_column).alias("doc_id"),
            "source",
            word_count(text).alias("size"),
            _shuffled(seed, text, id_column).alias("shuffled"),
        ),
        "sizes",
    )
    timed = table(_finish_times(sizes, weights, share, float(copies)), "finish-times")
    last = _last_served(timed, copies, share)
    served = sum(
        (F.when(_ticket(k) <= F.col("last"), 1).otherwise(0) for k in range(1, copies)),
        F.when(_ticket(0) <= F.col("last"), 1).otherwise(0),
    )
    # one row, or a null if nothing is taken
    taken = timed.join(F.broadcast(last)).withColumn("copies", F.coalesce(served, F.lit(0)).cast("int"))
    return taken.select(
        "key", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Runs jobs.

    Rows that agree in id, text and source are one document, which is taken as often as they are together.
    """
    taken = table(mix(docs, text=text, id_column=id_column, **how).where("copies > 0"), "mix")
    # a struct is never null, so a null source meets itself
    place = F.struct("key", "source").alias("__place")
    copies = taken.groupBy(place).agg(F.sum("copies").cast("int").alias("__copies"))
    placed = docs.withColumn("__place", F.struct(row_key(id_column, text).alias("key"), F.col("source").alias("source")))
    met = placed.dropDuplicates(["__place"]).join(copies.hint("shuffle_hash"), "__place")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def _finish_times(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    n = sizes.count()
    digits = 0
    while n > CHUNK_ROWS * 16**digits:
        digits += 1
    chunked = sizes.withColumn("chunk", F.substring("shuffled", 1, digits))
    # one struct, never null, so that rows and totals meet on one key
    part = F.struct("source", "chunk").alias("part")
    inside = Window.partitionBy("part").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunked.select(part, "key", "doc_id", "size", "shuffled").withColumn("words", F.sum("size").over(inside))
    totals = chunked.groupBy(part).agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("part.source").orderBy("part.chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    wide = source_targets(sizes, weights, share, most).select(F.struct("source").alias("named"), "source_size", "target")
    placed = rows.join(before, "part").withColumn("named", F.struct(F.col("part.source").alias("source")))
    joined = placed.join(broadcast_if_small(table(wide, "targets")), "named")
    words = (F.col("words") + F.col("before")).alias("words")
    return joined.select("key", "doc_id", F.col("named.source").alias("source"), "size", "shuffled", "source_size", "target", words)


def _ticket(k: int) -> Column:
    """Place of the k-th copy in the global queue; null if the source has no target."""
    finish = (F.col("words") + F.lit(k) * F.col("source_size")) / F.col("target")
    return F.when(
        F.col("target") > 0,
        F.struct(
            finish.alias("finish"),
            F.col("source").isNull().alias("no_source"),
            F.col("source").alias("source"),
            F.col("words").alias("words"),
            F.col("shuffled").alias("shuffled"),
            F.lit(k).alias("copy"),
        ),
    )


def _last_served(timed: DataFrame, copies: int, share: float) -> DataFrame:
    """One row, ``last``: the last ticket up to which all documents together stay within the budget."""
    queue = timed.select("size", F.explode(F.array(*[_ticket(k) for k in range(copies)])).alias("ticket"))
    queue = queue.where(F.col("ticket").isNotNull())
    spark = timed.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), timed.count() * copies // RANGE_ROWS)
    ranged = table(queue.repartitionByRange(n, "ticket").withColumn("part", F.spark_partition_id()), "queue")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("ticket").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(before), "part")
    budget = timed.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    fits = F.col("before") + F.col("upto") <= F.col("budget")
    return running.join(F.broadcast(budget)).agg(F.max(F.when(fits, F.col("ticket"))).alias("last"))
