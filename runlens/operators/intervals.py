"""What lies inside intervals of time, and pairing of begin and end events.

``within_intervals`` sums points up per interval without making a row per point and interval. Points of one time are folded first.
Time is cut into chunks of about as many folded rows each, by quantiles. An interval goes to the chunks of its start and its end; the chunks
in between are points of a smaller problem of the same kind, with the chunk's number for the time. In a task, sums are differences of running
sums, and extremes come from tables of 1, 2, 4, ... neighbours. So an interval that lies in one chunk has one row per value of ``keys``
from the start, and others three at most that are summed up. A chunk with many intervals is several tasks' work, each with its points.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runlens.operators.ordering import by_range, position_within
from runlens.session import cut_lineage

#: Folded rows of a chunk, and rows that one task's share of its intervals comes to at most.
ROWS_PER_CHUNK = 1 << 19
ROWS_PER_TASK = 1 << 20
_PARTS = ("n", "total", "low", "high")
# Totals are added up in tasks as three whole numbers: of 10^18, of 10^6 and of millionths.
_LIMBS = ("t2", "t1", "t0")
_BASE = 10**12


def _folded(value: Column) -> list[Column]:
    """Totals are decimal: sums do not depend on the order of rows."""
    return [F.count(value).alias("n"), F.sum(value.cast("decimal(28,6)")).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")]


def _refolded() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]


def _limbs() -> list[Column]:
    rest = "total % 1000000000000000000"
    return [F.expr(x).cast("long").alias(n) for x, n in zip((
        "total div 1000000000000000000", f"({rest}) div 1000000", f"(({rest}) % 1000000) * 1000000"
    ), _LIMBS)]


def _total() -> Column:
    parts = [F.col(n).cast("decimal(20,0)") * F.lit(Decimal(x)) for n, x in zip(_LIMBS, ("1000000000000000000", "1000000", "0.000001"))]
    return functools.reduce(Column.__add__, parts).cast("decimal(38,6)").alias("total")


def _extremes(values: np.ndarray, pick: np.ufunc, first: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Of values [first, until), which are never empty: two stretches of the largest power of two that fits."""
    level = np.frexp((until - first).astype(float))[1] - 1
    out, table = np.empty(len(first), values.dtype), values
    for k in range(level.max(initial=-1) + 1):
        at = np.flatnonzero(level == k)
        out[at] = pick(table[first[at]], table[until[at] - (1 << k)])
        table = pick(table[: -(1 << k)], table[1 << k :])
    return out


def _summed(keys: int):
    """Of the intervals and the points of a chunk, the parts of every interval and value of the keys that holds points."""
    names = [f"k{i}" for i in range(keys)]

    def combine(spans: pa.Table, points: pa.Table) -> pa.Table:
        group = np.zeros(points.num_rows, np.int64)
        for k in names:
            codes = points.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            group = np.unique(group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True)[1]
        order = np.lexsort((points.column("at").to_numpy(), group))
        column = {c: points.column(c).to_numpy()[order] for c in ("at", "n", *_LIMBS, "low", "high")}
        run = {c: np.concatenate(([0], np.cumsum(column[c]))) for c in ("n", *_LIMBS)}
        lo, hi = (spans.column(c).to_numpy() for c in ("lo", "hi"))
        cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)) if len(order) else np.zeros(1, int)
        who, of, parts = [], [], {c: [] for c in ("n", *_LIMBS, "low", "high")}
        for begin, stop in zip(cuts, cuts[1:]):
            first, until = np.searchsorted(column["at"][begin:stop], lo, "left"), np.searchsorted(column["at"][begin:stop], hi, "right")
            some = np.flatnonzero(until > first)
            first, until = first[some], until[some]
            for c, total in run.items():
                parts[c].append(total[begin + until] - total[begin + first])
            parts["low"].append(_extremes(column["low"][begin:stop], np.fmin, first, until))
            parts["high"].append(_extremes(column["high"][begin:stop], np.maximum, first, until))
            who.append(some)
            of.append(np.full(len(some), order[begin]))
        empty = [np.zeros(0, np.int64)]
        out = {c: np.concatenate(v) if v else column[c][:0] for c, v in parts.items()}
        for small, large in (("t0", "t1"), ("t1", "t2")):
            carried = out[small] // _BASE
            out[small], out[large] = out[small] - carried * _BASE, out[large] + carried
        ids = spans.select(["id"]).take(pa.array(np.concatenate(who or empty)))
        named = points.select(names).take(pa.array(np.concatenate(of or empty)))
        values = [pa.array(v, points.schema.field(c).type) for c, v in out.items()]
        return pa.Table.from_arrays([*ids.columns, *named.columns, *values], names=["id", *names, *out])

    return combine


def _within(points: DataFrame, spans: DataFrame, keys: int, width: int | None, most: int | None = None) -> DataFrame:
    """id, keys and parts of the ``spans`` (id, lo, hi) over folded ``points``, both tables of their own. Runs jobs."""
    groups = [f"k{i}" for i in range(keys)]
    rows, n_groups = points.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*groups) if groups else F.lit(0))).first()
    n = -(-rows // ROWS_PER_CHUNK) if most is None else min(most, -(-rows // ROWS_PER_CHUNK))
    if width:
        chunk = lambda c: F.floor(F.col(c) / width)
    elif n > 1:
        bounds = sorted(set(points.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10 * n)).first()[0]))
        chunk = lambda c: F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(c))).cast("long")
    else:
        chunk = lambda c: F.lit(0).cast("long")
    placed = spans.select("id", "lo", "hi", chunk("lo").alias("first"), chunk("hi").alias("last"))
    pieces = placed.withColumn("chunk", F.explode(F.array_distinct(F.array("first", "last"))))
    # a chunk is dealt over as many tasks as its intervals fill
    share = max(64, ROWS_PER_TASK // max(n_groups, 1))
    if width or n > 1:
        parts = F.broadcast(cut_lineage(pieces.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts")), "parts"))
        with_parts = lambda df: df.join(parts, "chunk")
    else:
        only = F.lit(max(1, -(-spans.count() // share)))
        with_parts = lambda df: df.withColumn("parts", only)
    asked = with_parts(pieces).select("id", "lo", "hi", "chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    folded = points.withColumn("chunk", chunk("at"))
    dealt = with_parts(folded).select(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *groups, "at", "n", *_limbs(), "low", "high"
    )
    kinds = dict(points.dtypes)
    schema = ", ".join([f"id {dict(spans.dtypes)['id']}", *[f"`{g}` {kinds[g]}" for g in groups], "n bigint", *[f"{x} bigint" for x in _LIMBS], f"low {kinds['low']}, high {kinds['high']}"])
    found = asked.groupBy("chunk", "part").cogroup(dealt.groupBy("chunk", "part")).applyInArrow(_summed(keys), schema)
    found = found.select("id", *groups, "n", _total(), "low", "high")
    if not width and n <= 1:
        return found
    between = cut_lineage(placed.where("last - first > 1").select("id", (F.col("first") + 1).alias("lo"), (F.col("last") - 1).alias("hi")), "between")
    if not between.isEmpty():
        sums = cut_lineage(folded.groupBy(F.col("chunk").alias("at"), *groups).agg(*_refolded()), "chunks")
        chunks = sums.agg(F.count_distinct("at")).first()[0]
        found = found.unionByName(_within(sums, between, keys, None, max(1, chunks // 2)))
    return found.groupBy("id", *groups).agg(*_refolded())


def within_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, value: str, start: str, end: str, width: int | None = None
) -> DataFrame:
    """n, total (decimal), low and high of ``value`` per interval row and value of ``keys``; both ends of an interval count.

    ``at``, ``start`` and ``end`` are integers of one unit. Intervals are told apart by all their columns; equal
    rows are one interval. Nulls in times or values lie in no interval; an interval that ends before it starts holds nothing.
    ``width`` cuts time into chunks of so many units instead of by quantiles. Runs jobs.
    """
    groups = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    held = points.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    folded = held.groupBy(*groups, F.col(at).cast("long").alias("at")).agg(*_folded(F.col(value)))
    asked = intervals.where(F.col(start) <= F.col(end)).distinct().select(
        F.struct(*intervals.columns).alias("id"), F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")
    )
    found = _within(cut_lineage(folded, "folded"), cut_lineage(asked, "spans"), len(keys), width)
    return found.select("id.*", *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *_PARTS)


def pair_attempts(
    events: DataFrame, groups: Sequence[str], name: str, begin: str, end: str, order: Sequence[str], at: str
) -> DataFrame:
    """``groups``, attempt (from 1), started and ended: the kth ``begin`` event of a group with its kth ``end`` event.

    Events that are missing at the end leave a null. ``order`` has to be unique within a group and name. Groups of any size are
    numbered in chunks. Runs a job.
    """
    kept = events.where(F.col(name).isin(begin, end)).select(*groups, name, *[c for c in order if c != at], at)
    numbered = position_within(by_range(kept, order), [*groups, name], order, "attempt")
    which = lambda n: F.max(F.when(F.col(name) == n, F.col(at)))
    return numbered.groupBy(*groups, "attempt").agg(which(begin).alias("started"), which(end).alias("ended"))
