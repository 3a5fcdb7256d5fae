"""Averages per window of event time, in batch and as a stream.

Rule for late samples: a stream keeps a window open until the watermark, the newest time of earlier micro-batches less
``delay``, has passed its end. A sample of a closed window is dropped and counted by Spark as a row dropped by the watermark
(``dropped_rows``). As long as none is late, the stream's totals are those of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.intervals import _folded


def window_totals(samples: DataFrame, groups: list[str], at: str, value: str, width: str) -> DataFrame:
    """``groups``, window_start, n, total (decimal), low, high; windows begin at multiples of ``width`` since 1970."""
    window = F.window(at, width)
    return samples.groupBy(*groups, window.alias("__w")).agg(*_folded(F.col(value))).select(
        *groups, F.col("__w.start").alias("window_start"), "n", "total", "low", "high"
    )


def average() -> Column:
    return F.col("total").cast("double") / F.col("n")


def stream_totals(
    samples: DataFrame, groups: list[str], at: str, value: str, width: str, delay: str, sink: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start the totals of a stream of samples; each micro-batch writes the windows it changed. Without a trigger, of what is there."""
    totals = window_totals(samples.withWatermark(at, delay), groups, at, value, width)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = totals.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def newest_totals(written: DataFrame, groups: list[str]) -> DataFrame:
    """The last totals of every window, of what ``stream_totals`` has written."""
    parts = ["n", "total", "low", "high"]
    newest = F.max_by(F.struct(*parts), "batch").alias("__t")
    return written.groupBy(*groups, "window_start").agg(newest).select(*groups, "window_start", *[f"__t.{p}" for p in parts])


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late, over the micro-batches this query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
