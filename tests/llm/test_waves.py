"""Waves of wide vectors in the cover-tree search."""

import random

from pyspark import SparkContext

from runlens.llm import cover_tree


def test_waves_are_bounded_by_bytes_and_leave_no_broadcast(spark, monkeypatch):
    rnd = random.Random(4)
    vectors = [(i % 40, [float(rnd.randint(-9, 9)) for _ in range(32)]) for i in range(160)]
    frame = spark.createDataFrame(vectors, "id bigint, v array<double>")
    want = sorted(map(tuple, cover_tree.top_k(frame, frame, k=3).collect()))
    sent, gone = [], []
    real = SparkContext.broadcast

    def watched(self, value):
        made = real(self, value)
        destroy = made.destroy
        made.destroy = lambda *a: (gone.append(made), destroy(*a))
        sent.append((made, value))
        return made

    monkeypatch.setattr(SparkContext, "broadcast", watched)
    monkeypatch.setattr(cover_tree, "WAVE_BYTES", 40 * 32 * 8)
    found = cover_tree.top_k(frame, frame, k=3)
    assert len(sent) == 4 and max(value[1].nbytes for _, value in sent) < 2 * 40 * 32 * 8
    assert gone == [made for made, _ in sent]
    assert sorted(map(tuple, found.collect())) == want
