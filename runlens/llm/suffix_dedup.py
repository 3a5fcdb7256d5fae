"""Exact repeated-substring removal with sharded suffix arrays.

Every byte is removed that a string of ``length`` bytes covers which also starts somewhere else in the corpus,
same document included. Strings never cross documents and are judged on the input.

A suffix array of the whole corpus would not fit anywhere, so it is built in shards that are
exact by themselves. Each window of ``length`` bytes is assigned to the smallest hash of a 32-byte string inside it, its anchor.
Equal windows have equal anchors, so no repeat crosses anchors. Consecutive windows of one anchor form a segment:

1. documents are scanned for segments: anchor, place, and a hash of the segment's bytes;
2. anchors met once are done; where all segments of an anchor are equal, all their windows repeat;
3. of the other anchors each different segment goes, once, to a shard, whose suffix array (induced sorting) and common
   prefixes in text order tell which windows repeat;
4. an anchor with more than ``GROUP_SEGMENTS`` different segments would fill a shard: its windows are counted by
   a 128-bit hash instead, which combines before it shuffles;
5. the spans found meet their documents again, and the bytes are cut.

Defined cases: null text is empty. Texts shorter than ``length`` keep everything. Repeated rows repeat each other, so they lose
all of a text that is long enough. Kept bytes may end inside a character, so they come as binary. An
empty table gives an empty result. Other columns pass through; those called like an output are replaced.

A run of one byte is shortened to twice ``length`` before all this, as sorting takes a pass per byte of it. That changes no verdict: what
lies inside the run repeats before and after, all of the run goes, and a string that reaches beyond it holds less than ``length`` of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runlens.llm.common import row_key, table, text_bytes
from runlens.llm.induced_sorting import repeated_starts, suffix_array

ANCHOR_BYTES = 32
SHARD_BYTES = 1 << 20
GROUP_SEGMENTS = 2048
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_strings(raw: np.ndarray, span: int) -> np.ndarray:
    """Hash of the ``span`` bytes (a power of two) from every start: two halves make a whole."""
    h, n, m = raw.astype(np.uint64) + np.uint64(1), 1, _ODD
    while n < span:
        h = h[:-n] * np.uint64(m) + h[n:]
        n, m = 2 * n, m * m % 2**64
    return _mixed(h)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def squeezed(body: bytes, length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text whose runs of one byte are no longer than twice ``length``, where longer ones began, and by how much they were cut."""
    raw, none = np.frombuffer(body, np.uint8), np.empty(0, np.int64)
    # a run that long holds all of some aligned block; most blocks are ruled out by three of their bytes
    blocks = raw[: len(raw) // length * length].reshape(-1, length)
    even = np.flatnonzero((blocks[:, 0] == blocks[:, length // 2]) & (blocks[:, 0] == blocks[:, -1]))
    if not len(even) or not (blocks[even] == blocks[even, :1]).all(1).any():
        return body, none, none
    edges = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]])
    long = np.flatnonzero(np.diff(edges) > 2 * length)
    starts, ends = edges[long], edges[long + 1]
    if not len(starts):
        return body, none, none
    cuts = zip(np.concatenate([[0], ends]).tolist(), [*(starts + 2 * length).tolist(), len(raw)], strict=True)
    return b"".join(body[a:b] for a, b in cuts), starts, ends - starts - 2 * length


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, content hash, first window, number of windows, and whether the anchor may occur twice inside.

    The last is true for all segments of an anchor whose bytes occur twice in the text.
    """
    if len(text) < length:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32), none.astype(bool)
    hashes = _byte_strings(np.frombuffer(text, np.uint8), ANCHOR_BYTES)
    anchors = _smallest(hashes, length - ANCHOR_BYTES + 1)
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    count = np.diff(np.append(first, len(anchors)))
    anchor = anchors[first]
    low = np.sort(hashes[hashes <= anchor.max()])
    twice = np.isin(anchor, low[1:][low[1:] == low[:-1]])
    body = memoryview(text)
    content = [xxhash.xxh3_64_intdigest(body[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    return (
        anchor.view(np.int64), np.array(content, np.uint64).view(np.int64), first.astype(np.int32), count.astype(np.int32), twice
    )


_SEGMENT = "anchor bigint, content bigint, a bigint, b bigint, first int, count int, twice boolean"


def _find_segments(bodies: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [segments(squeezed(x, length)[0], length) for x in batch.column(1).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                a, b = (batch.column(0).field(i).take(owner) for i in (0, 1))
                anchor, content, first, count, twice = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [anchor, content, a, b, first, count, twice], names=["anchor", "content", "a", "b", "first", "count", "twice"]
                )

    return bodies.mapInArrow(run, _SEGMENT)


def _cut_out(bodies: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, whole, k, a, b, first, count of ``wanted`` with the segment's bytes."""
    lists = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("anchor", "whole", "k", "first", "count")).alias("list"))
    lists = lists.select(F.struct("a", "b").alias("key"), "list")
    met = bodies.join(lists.hint("shuffle_hash"), "key").dropDuplicates(["key"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("body")
            short = pa.array([squeezed(x, length)[0] for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, "body", short)

    met = met.mapInArrow(squeeze, met.schema)
    each = met.select("key.a", "key.b", "body", F.explode("list").alias("s")).select("a", "b", "body", "s.*")
    return each.select(
        "a", "b", "anchor", "whole", "k", "first", "count",
        F.substring("body", F.col("first") + 1, F.col("count") + (length - 1)).alias("bytes"),
    )


def _shard_spans(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Windows of one shard that repeat, as spans; segments that are repeated as a whole are known and left out."""
    raw = b"\0".join(rows["bytes"]) + b"\0" * 8
    sizes = rows["bytes"].map(len).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.frombuffer(raw, np.uint8).astype(np.uint16) + 2
    valid = np.zeros(len(raw) + 1, np.int8)
    valid[starts] += 1
    valid[starts + rows["count"].to_numpy()] -= 1
    symbols[(starts + sizes)] = 1
    symbols[len(raw) - 8 :] = 1
    valid = np.cumsum(valid[:-1]) > 0
    marks = repeated_starts(raw, suffix_array(symbols, length), valid, length)
    out = []
    for i in np.flatnonzero(~rows["whole"].to_numpy()):
        own = marks[starts[i] : starts[i] + rows["count"].iloc[i]].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        a, b, first = rows["a"].iloc[i], rows["b"].iloc[i], rows["first"].iloc[i]
        out += [(a, b, first + s, e - s) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return pd.DataFrame(out, columns=["a", "b", "first", "count"])


def _hot_windows(rows: DataFrame, length: int) -> DataFrame:
    """Two hashes of every window of the segments, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                body = memoryview(x["bytes"])
                hashes = [xxhash.xxh3_128_intdigest(body[i : i + length]) for i in range(x["count"])]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(h & (2**64 - 1)) - 2**63 for h in hashes], pa.int64()),
                        pa.array([(h >> 64) - 2**63 for h in hashes], pa.int64()),
                        pa.array([x["a"]] * n, pa.int64()),
                        pa.array([x["b"]] * n, pa.int64()),
                        pa.array(range(x["first"], x["first"] + n), pa.int32()),
                        pa.array([x["whole"]] * n, pa.bool_()),
                    ],
                    names=["low", "high", "a", "b", "first", "whole"],
                )

    return rows.select("a", "b", "first", "count", "whole", "bytes").mapInArrow(
        run, "low bigint, high bigint, a bigint, b bigint, first int, whole boolean"
    )


def repeated_spans(docs: DataFrame, text: str, id_column: str, length: int, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """a, b (the row key), first and count of runs of windows that repeat. Runs jobs."""
    bodies = docs.select(row_key(id_column, text).alias("key"), text_bytes(text).alias("body"))
    long = bodies.where(F.octet_length("body") >= length)
    found = table(_find_segments(long, length), "segments")
    by_anchor = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("content") == F.max("content")).alias("equal"), F.max("twice").alias("twice")
    )
    shared = table(by_anchor.where("n > 1 or twice").select("anchor", (F.col("equal") & ~F.col("twice")).alias("equal")), "anchors")
    here = table(found.join(shared, "anchor"), "shared-segments")
    spans = here.where("equal").select("a", "b", "first", "count")

    # where segments of an anchor differ: each different one, and whether there are several of it
    mixed = here.where("not equal")
    one = mixed.groupBy("anchor", "content").agg(
        (F.count(F.lit(1)) > 1).alias("whole"), F.min(F.struct("a", "b", "first", "count")).alias("v")
    )
    one = table(one, "different")
    copies = mixed.join(one.where("whole").select("anchor", "content"), ["anchor", "content"])
    spans = spans.unionByName(copies.select("a", "b", "first", "count"))
    groups = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"))
    wanted = one.select("anchor", "whole", "v.*").join(groups, "anchor")
    # a lone segment that is there several times has nothing left to find
    wanted = wanted.where("k > 1 or not whole")
    cut = table(_cut_out(long, wanted, length), "segment-bytes")

    small = cut.where(F.col("k") <= group_segments)
    size = small.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = small.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "anchor"), F.lit(shards)))
    in_shards = dealt.groupBy("shard").applyInPandas(lambda rows: _shard_spans(rows, length), "a bigint, b bigint, first int, count int")

    windows = table(_hot_windows(cut.where(F.col("k") > group_segments), length), "windows")
    several = windows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", "high")
    hot = windows.where("not whole").join(several, ["low", "high"]).select("a", "b", "first", F.lit(1).alias("count"))
    return table(spans.unionByName(in_shards).unionByName(hot), "spans")


def remove_repeats(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 200, group_segments: int = GROUP_SEGMENTS
) -> DataFrame:
    """All columns of ``docs``, and n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary). Runs jobs."""
    if length < ANCHOR_BYTES:
        raise ValueError(f"strings must have {ANCHOR_BYTES} bytes or more")
    spans = repeated_spans(docs, text, id_column, length, group_segments)
    lists = spans.groupBy("a", "b").agg(F.collect_set(F.struct("first", "count")).alias("spans"))
    lists = lists.select(F.struct("a", "b").alias("key"), "spans")
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    columns = [c for c in docs.columns if c not in new]
    named = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
        row_key(id_column, text).alias("key"), text_bytes(text).alias("body"),
    )
    joined = named.join(lists.hint("shuffle_hash"), "key", "left").drop("key")
    rest = [f for f in joined.schema.fields if f.name not in ("body", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            rows = [_cut(b, s, length) for b, s in zip(batch.column(at("body")).to_pylist(), batch.column(at("spans")).to_pylist(), strict=True)]
            n_bytes, n_removed, n_spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(at(f.name)) for f in rest]
                + [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=[f.name for f in rest] + list(new),
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *new)


def _cut(body: bytes, spans: list[dict] | None, length: int) -> tuple[int, int, int, bytes]:
    if not spans:
        return len(body), 0, 0, body
    short, _, excess = squeezed(body, length)
    depth = np.zeros(len(short) + 1, np.int64)
    first = np.array([s["first"] for s in spans])
    np.add.at(depth, first, 1)
    np.add.at(depth, first + np.array([s["count"] for s in spans]) + length - 1, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(short, np.uint8)[~gone].tobytes()
    # all of a shortened run is gone
    return len(body), int(gone.sum() + excess.sum()), runs, kept
