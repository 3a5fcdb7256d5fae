"""Resource samples as a stream whose header rows may come in an earlier, or a later, micro-batch than the samples.

The state of a file holds its two header rows once they were seen, and until then its samples. The header is that of the batch
extractor, the first two quoted lines that are no banner, by line number. So that a file with most
of the lines is not one task's, samples are dealt over ``SALTS`` states per file, and header rows, a handful, are given to
all of them. A file that shows no header for ``timeout`` gives its samples up as rejects ("no header"), so that state is bounded by what
arrives in that time; samples that come later wait anew.

The state pairs lines only. What samples mean is worked out by the batch extractor's expressions, on each
micro-batch of paired lines; a batch that is redone replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlens.operators.extract.dstat import is_header_row, is_sample, parse_headers, sample_events
from runlens.session import broadcast_if_small

SALTS = 16
TIMEOUT_MS = 3_600_000
#: ``groups`` and ``columns`` are set in one row per state and batch; in rows of samples they are null.
PAIRED = "file string, record_key bigint, value string, groups string, columns string"
_STATE = "head_at array<bigint>, heads array<string>, held_at array<bigint>, held array<string>"


def _pair(timeout: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file = key[0]
        head_at, heads, held_at, held = (list(x) for x in state.get) if state.exists else ([], [], [], [])

        def rows(at, values, groups=None, columns=None) -> pd.DataFrame:
            n = len(at)
            return pd.DataFrame({"file": [file] * n, "record_key": at, "value": values, "groups": [groups] * n, "columns": [columns] * n})

        if state.hasTimedOut:
            state.remove()
            yield rows(held_at, held)
            return
        ready, told = len(heads) == 2, False
        for frame in frames:
            first = frame[frame["is_header"]]
            if len(first) and not ready:
                both = sorted([*zip(head_at, heads), *zip(first["record_key"].tolist(), first["value"])])[:2]
                head_at, heads = [a for a, _ in both], [v for _, v in both]
            data = frame[~frame["is_header"]]
            if ready and len(data):
                if not told:
                    yield rows([-1], [""], *heads)
                    told = True
                yield rows(data["record_key"].tolist(), data["value"].tolist())
            else:
                held_at += data["record_key"].tolist()
                held += data["value"].tolist()
        # header rows of one batch may come in any order: they count when the batch is through
        if held and len(heads) == 2:
            yield rows([-1], [""], *heads)
            yield rows(held_at, held)
            held_at, held = [], []
        state.update((head_at, heads, held_at, held))
        if len(heads) < 2 and held:
            state.setTimeoutDuration(timeout)

    return step


def paired_lines(lines: DataFrame, timeout_ms: int = TIMEOUT_MS, salts: int = SALTS) -> DataFrame:
    """Stream of samples whose header is known or given up, with a row of both header rows for each state that has some.

    ``lines`` is a stream of (file, record_key, value), ``record_key`` being the line number.
    """
    value, header = F.col("value"), is_header_row(F.col("value"))
    dealt = F.when(header, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array((F.col("record_key") % salts).cast("int")))
    keyed = lines.where(header | is_sample(value)).select(
        "file", "record_key", "value", header.alias("is_header"), F.explode(dealt).alias("salt")
    )
    return keyed.groupBy("file", "salt").applyInPandasWithState(
        _pair(timeout_ms), PAIRED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def extract_paired(paired: DataFrame) -> DataFrame:
    """Events and rejects of a batch of paired lines. Runs a job to size the headers."""
    headers = paired.where(F.col("groups").isNotNull()).groupBy("file").agg(F.first("groups").alias("groups"), F.first("columns").alias("columns"))
    samples = paired.where(F.col("groups").isNull()).select("file", "record_key", "value")
    return sample_events(samples, broadcast_if_small(parse_headers(headers)))


def run_samples(
    lines: DataFrame, sink: str, checkpoint: str, timeout_ms: int = TIMEOUT_MS, salts: int = SALTS, trigger: dict | None = None
) -> StreamingQuery:
    """Start the extraction of a stream of sample lines into ``sink``; without a trigger, of what is there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # paired once, for the headers and for the samples
        try:
            extract_paired(held).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            held.unpersist()

    writer = paired_lines(lines, timeout_ms, salts).writeStream.outputMode("append").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
