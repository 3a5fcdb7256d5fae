"""Sums within intervals, pairing of events, windows of a stream, against plain counting."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runlens.operators import intervals
from runlens.operators.intervals import pair_attempts, within_intervals
from runlens.streaming.windows import dropped_rows, newest_totals, stream_totals, window_totals


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_sums_within_intervals(spark, width):
    rnd = random.Random(4)
    points = [(rnd.choice("ab"), rnd.randint(-300, 900), rnd.choice([rnd.randint(0, 9) / 4, None])) for _ in range(600)]
    points += [("a", 50, 1.0)] * 300 + [("b", None, 1.0)]
    spans = [(i, s, s + rnd.choice([0, 3, 40, 700, -1])) for i, s in enumerate(rnd.randint(-400, 900) for _ in range(60))] + [(99, None, 5), (7, 7, 7), (7, 7, 7)]
    p = spark.createDataFrame(points, "host string, t bigint, v double")
    got = within_intervals(p, spark.createDataFrame(spans, "run int, s bigint, e bigint"), ["host"], "t", "v", "s", "e", width)
    want = set()
    for run, s, e in set(spans):
        for host in "ab":
            inside = [v for h, t, v in points if h == host and t is not None and v is not None and s is not None and s <= t <= e]
            if inside:
                want.add((run, s, e, host, len(inside), Decimal(str(sum(inside))), min(inside), max(inside)))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_no_loop_over_points_and_intervals(spark):
    points = spark.range(1000).select(F.lit("h").alias("host"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    spans = spark.range(50).select("id", F.col("id").alias("s"), (F.col("id") + 500).alias("e"))
    found = within_intervals(points, spans, ["host"], "t", "v", "s", "e")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.n for r in found.collect()} == {501}
    assert within_intervals(points.limit(0), spans, ["host"], "t", "v", "s", "e").isEmpty()
    assert within_intervals(points, spans.limit(0), ["host"], "t", "v", "s", "e").isEmpty()


def test_rows_of_intervals_do_not_grow_with_the_points(spark, monkeypatch):
    """What is shuffled per interval is some rows for each host, however many points it covers; large values add up exactly."""
    monkeypatch.setattr(intervals, "ROWS_PER_CHUNK", 500)
    monkeypatch.setattr(intervals, "ROWS_PER_TASK", 100)
    made = []
    whole = intervals._within

    def watched(points, spans, *rest):
        made.append((points.count(), spans.count()))
        return whole(points, spans, *rest)

    monkeypatch.setattr(intervals, "_within", watched)
    points = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "a").alias("host"), (F.col("id") % 10_000).alias("t"), (F.col("id") * 1e17 - 1e20 + 0.25).alias("v")
    )
    spans = spark.range(300).select("id", F.col("id").alias("s"), (F.col("id") * 30 + 5).alias("e"))
    got = {tuple(r) for r in within_intervals(points, spans, ["host"], "t", "v", "s", "e").collect()}
    want = spans.join(points, F.col("t").between(F.col("s"), F.col("e"))).groupBy(*(spans[c] for c in spans.columns), "host").agg(
        F.count("v"), F.sum(F.col("v").cast("decimal(28,6)")), F.min("v"), F.max("v")
    )
    assert got == {tuple(r) for r in want.collect()} and len(got) == 600
    assert made[0] == (10_000, 300) and all(p <= 100 and s <= 300 for p, s in made[1:])


def test_retries_and_missing_ends(spark, rows):
    moves = [
        ("t1", "start", 1, 10), ("t1", "end", 2, 15), ("t1", "start", 3, 20), ("t1", "end", 4, 29), ("t1", "start", 5, 30),
        ("t2", "end", 6, 7), (None, "start", 7, 1), ("t1", "other", 8, 16), ("t2", "end", 9, 8), ("t2", "start", 10, 8),
    ]
    events = spark.createDataFrame(moves, "task string, name string, id bigint, at bigint")
    got = pair_attempts(events, ["task"], "name", "start", "end", ["at", "id"], "at")
    assert rows(got) == sorted(
        [("t1", 1, 10, 15), ("t1", 2, 20, 29), ("t1", 3, 30, None), ("t2", 1, 8, 7), ("t2", 2, None, 8), (None, 1, 1, None)], key=repr
    )


def test_windows_and_late_samples(spark, tmp_path, rows):
    """The watermark of a later micro-batch closes a window; what comes for it then is dropped and counted."""
    schema = "host string, at timestamp, v double"
    folder, sink, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[("00:01", 1.0), ("00:09", 2.0)], [("00:02", 4.0), ("01:30", 1.0)], [("00:03", 8.0), ("01:20", 0.5)]]
    late = []
    for batch in batches:
        spark.createDataFrame([("h", t, v) for t, v in batch], "host string, at string, v double").select(
            "host", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("at"), "v"
        ).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = stream_totals(stream, ["host"], "at", "v", "10 minutes", "30 minutes", sink, state)
        query.awaitTermination()
        late.append(dropped_rows(query))
    got = newest_totals(spark.read.parquet(sink), ["host"])
    shown = rows(got.select(F.date_format("window_start", "HH:mm").alias("w"), "n", F.col("total").cast("double"), "low", "high"))
    assert shown == [("00:00", 3, 7.0, 1.0, 4.0), ("01:20", 1, 0.5, 0.5, 0.5), ("01:30", 1, 1.0, 1.0, 1.0)]
    assert late == [0, 0, 1]
    batch = window_totals(spark.read.schema(schema).parquet(folder), ["host"], "at", "v", "10 minutes")
    assert {r.n for r in batch.collect()} == {4, 1}
