"""Order-dependent operators that never put a whole group into one task.

A plain window over a hot group sorts that group in a single task. Here rows are first cut into
chunks that follow the order, chunks are numbered on their own, and the (few) chunk totals carry the
offsets across. ``by_key`` cuts on a unique integral key, while that comes out even; ``by_range`` takes any
columns, range-partitions on them and writes the result, so that a row's chunk can not change later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from runlens.session import cut_lineage

CHUNK = "__chunk"
# Rows per chunk when cutting on a unique key.
CHUNK_ROWS = 1 << 20


# Chunks of keys may be this many times as full as evenly spread keys would make them.
UNEVEN = 4


def by_key(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Chunk by ranges of a unique integral key.

    The width is chosen so that evenly spread keys come to ``CHUNK_ROWS`` rows per chunk, and the fullest chunk is
    measured: keys that cluster are cut by ``by_range`` instead, on quantiles. Takes jobs over the key column.
    """
    if width is None:
        low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        width = max(1, (high - low + 1) * CHUNK_ROWS // n) if n else 1
        if n > UNEVEN * CHUNK_ROWS:
            counted = df.groupBy(F.expr(f"`{key}` div {width}")).agg(F.count(F.lit(1)).alias("n"))
            if counted.agg(F.max("n")).first()[0] > UNEVEN * CHUNK_ROWS:
                return by_range(df, [key], rows=n)
    return df.withColumn(CHUNK, F.expr(f"`{key}` div {width}"))


def by_range(df: DataFrame, order: Sequence[str], parts: int | None = None, rows: int | None = None) -> DataFrame:
    """Chunk by range of ``order``, which must be unique to be cut evenly. Runs a job.

    With ``rows``, the number of rows, there are as many chunks as keep each near ``CHUNK_ROWS``.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if rows is None else max(1, -(-rows // CHUNK_ROWS))
    ranged = df.repartitionByRange(parts, *order).withColumn(CHUNK, F.spark_partition_id().cast("long"))
    return cut_lineage(ranged)


def position_within(chunked: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position of each row inside its group, following ``order``.

    Chunk and group travel as one struct, which is never null even if a group is: the ranking and the
    join to the chunk offsets then share one shuffle and one sort of the rows.
    """
    columns = [c for c in chunked.columns if c != CHUNK]
    rest = [c for c in columns if c not in groups]
    part = F.struct(CHUNK, *groups).alias("__part")
    rows = chunked.select(part, *rest)
    local = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long"))
    totals = chunked.select(part).groupBy("__part").agg(F.count(F.lit(1)).alias("__total"))
    group = [F.col(f"__part.`{g}`") for g in groups]
    before = Window.partitionBy(*group).orderBy(F.col(f"__part.{CHUNK}")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    joined = local.join(offsets, "__part")
    named = {g: F.col(f"__part.`{g}`").alias(g) for g in groups}
    return joined.select(*[named.get(c, F.col(f"`{c}`")) for c in columns], (F.col("__n") + F.col("__before")).alias(out))


def previous_value(chunked: DataFrame, value: str, order: Sequence[str], out: str = "prev") -> DataFrame:
    """Value of the preceding row in the global order; adds ``out`` and ``is_first``."""
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    rows = chunked.withColumns({out: F.lag(value).over(inside), "__row": F.row_number().over(inside)})
    # last value of each chunk, handed on to the next chunk that has rows
    last = chunked.groupBy(CHUNK).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__last"))
    chunks = Window.orderBy(CHUNK)
    carried = last.select(
        CHUNK,
        F.lag("__last.__v").over(chunks).alias("__carry"),
        (F.row_number().over(chunks) == 1).alias("__first_chunk"),
    )
    head = F.col("__row") == 1
    return rows.join(carried, CHUNK).select(
        *[c for c in chunked.columns if c != CHUNK],
        F.when(head, F.col("__carry")).otherwise(F.col(out)).alias(out),
        (head & F.col("__first_chunk")).alias("is_first"),
    )


def collapse_consecutive(chunked: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """First row of every stretch of equal ``value``s in the global order."""
    rows = previous_value(chunked, value, order, "__prev")
    changed = F.col("is_first") | ~F.col(value).eqNullSafe(F.col("__prev"))
    return rows.where(changed).drop("__prev", "is_first")


def forward_fill(df: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Replace empty values by the nearest earlier non-empty one of the group; leading empties go.

    For header rows: a group is one header, so its size is the number of columns of a file.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(w)
    return df.withColumn(out, filled).where(F.col(out).isNotNull())
