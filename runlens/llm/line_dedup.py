"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. A key of
``min_chars`` code points or more that occurs in ``min_docs`` documents or more loses all its lines.

Only hashes (128 bits) travel: every document sends one row per distinct key with the positions it
stands at. Counting combines before it shuffles, so a line that all documents share costs one row
per task. The hashes over the threshold meet those rows in a plain equi-join, which AQE splits where a
key is hot; the positions to drop then meet the texts on the row key.

Defined cases: null and empty text is one empty line, which is never dropped as its key has no
characters. A document is a row: repeated rows count as often as they are there. A document that
loses all lines has the empty text. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runlens.llm.common import ASCII_SPACE, giving_back, row_key, table, text_bytes

_KEY = "__key"


def _keyed(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Positions of every key that is long enough."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(ASCII_SPACE)
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(at)
    return found


def explode_lines(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """One row per document and distinct key: the document's key, two hashes and the positions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, low, high, places = [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for line, at in _keyed(body, min_chars).items():
                    h = xxhash.xxh3_128_intdigest(line)
                    owner.append(i)
                    low.append((h & _MASK) - _HALF)
                    high.append((h >> 64) - _HALF)
                    places.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=[_KEY, "low", "high", "places"],
            )

    schema = f"{_KEY} struct<a:bigint,b:bigint>, low bigint, high bigint, places array<int>"
    return docs.select(F.col(key).alias(_KEY), text_bytes(text).alias("body")).mapInArrow(giving_back(rows), schema)


_MASK = (1 << 64) - 1
_HALF = 1 << 63


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First column text, last column positions to drop: the kept text and two counts take their place."""
    for batch in batches:
        names = batch.schema.names
        kept, n_lines, n_dropped = [], [], []
        bodies, drops = batch.column(names.index("__body")).to_pylist(), batch.column(names.index("__drop")).to_pylist()
        for body, drop in zip(bodies, drops, strict=True):
            if drop:
                gone, lines = set(drop), body.split(b"\n")
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            else:
                kept.append(body)
                n_lines.append(body.count(b"\n") + 1)
                n_dropped.append(0)
        rest = [i for i, n in enumerate(names) if n not in ("__body", "__drop")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[names[i] for i in rest] + ["__kept", "__n_lines", "__n_dropped"],
        )


def frequent_lines(exploded: DataFrame, min_docs: int) -> DataFrame:
    counts = exploded.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.where(F.col("n_docs") >= min_docs)


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All columns of ``docs`` with the text replaced, and ``n_lines``, ``n_dropped``. Runs jobs.

    Columns of the input that are called n_lines or n_dropped are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    named = {c: f"c{i}" for i, c in enumerate(others)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], text_bytes(text).alias("__body"),
                        row_key(id_column, text).alias(_KEY))
    lines = table(explode_lines(docs.select(text, row_key(id_column, text).alias(_KEY)), text, _KEY, min_chars), "lines")
    hot = table(frequent_lines(lines, min_docs), "frequent-lines").select("low", "high")
    drops = (
        lines.join(hot, ["low", "high"])
        .groupBy(_KEY)
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__drop"))
    )
    joined = keyed.join(drops.hint("shuffle_hash"), _KEY, "left").drop(_KEY)
    fields = [f for f in joined.schema.fields if f.name not in ("__body", "__drop")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "__kept string, __n_lines bigint, __n_dropped bigint"
    done = joined.mapInArrow(giving_back(_reassemble), schema)
    order = {**{c: F.col(n).alias(c) for c, n in named.items()}, text: F.col("__kept").alias(text)}
    return done.select(
        *[order[c] for c in docs.columns if c in order], F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped")
    )
