"""Token ids as ORC files that are read by stripe and pruned by document id.

Texts are encoded where they are read, dealt by ranges of the id, sorted and written: one column of ids per
document as an integer list, which ORC run-length encodes, with a row index every ``INDEX_ROWS``
documents and a Bloom filter on the id. Files and stripes then hold disjoint, ascending ranges of ids, so
reading some documents touches only the stripes whose minimum, maximum and filter allow them.

``start`` (ids of all documents before) is stored as the position inside the file plus, in a small side
table, the total of the files before: no file has to wait for another one.

White space separates the units of the tokenizer (see ``WordEncoder``), so each worker keeps the ids of the first
``CACHED_WORDS`` words it meets, the frequent ones among them, and hands other words to the library.

Defined cases: null and empty texts have the end id alone. Null ids come first; rows of equal id are ordered by
their ids, repeated rows are repeated documents. An empty table gives no files and an empty result. Further columns are not read.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from runlens.llm.common import shuffle_files_dropped, text_bytes

CACHED_WORDS = 1_000_000
WORDS_AT_ONCE = 256
LONGEST_CACHED = 200
INDEX_ROWS = 1_000
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": str(INDEX_ROWS),
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of a text, word by word, for tokenizers in which a blank never joins two words.

    That holds for a tokenizer whose normaliser maps white space to one blank and whose splitter drops it:
    composition and lower-casing do not reach across a blank. Words end at ASCII white space only; what else
    counts as white space is left to the library. ``check`` compares with the library on a whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if text.isascii() and b"<|" not in text:  # combining marks and special tokens tell cases apart
            text = text.lower()
        words, known = text.split(), self.known
        found = list(map(known.get, words))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            new = self._new_ids(list({words[i] for i in gaps}))
            if len(known) < CACHED_WORDS:
                known.update((w, x) for w, x in new.items() if len(w) <= LONGEST_CACHED)
            for i in gaps:
                found[i] = new[words[i]]
        return b"".join(found)

    def _new_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word; some hundred words are one text for the library, cut by character offsets."""
        out = {}
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = [w.decode("utf-8", "replace") for w in words[at : at + WORDS_AT_ONCE]]
            coded = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = array("I", coded.ids)
            starts = [a for a, _ in coded.offsets]
            end = low = 0
            for raw, word in zip(words[at : at + WORDS_AT_ONCE], part, strict=True):
                end += len(word) + 1
                high = bisect_left(starts, end, low)
                out[raw] = ids[low:high].tobytes()
                low = high
        return out

    def check(self, text: str) -> bool:
        return list(array("I", self.encode(text.encode()))) == self.library.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> WordEncoder:
    """One per Python worker, as tasks follow each other in it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_texts(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, text: str = "text", id_column: str = "doc_id", cuts: list[int] | None = None
) -> DataFrame:
    """doc_id and ids (array<int>); with ``cuts`` also ``file``, how many of these ascending ids are below the document's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        bounds = None if cuts is None else np.array(cuts, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [encode(x) + end for x in part.column(1).to_pylist()]
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                columns = {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)}
                if bounds is not None:  # nulls come first, in the first file
                    ids = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    columns["file"] = pa.array(np.searchsorted(bounds, ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    body = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text).alias("body"))
    return body.mapInArrow(rows, "doc_id bigint, ids array<int>" + ("" if cuts is None else ", file int"))


def _bounds(ids: DataFrame, files: int) -> list[int]:
    """Ids at which files end, from a quantile sketch over all ids; at most ``files`` of them."""
    cuts = ids.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 100 * files)).first()[0] if files > 1 else []
    return sorted(set(cuts or []))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, text: str = "text", id_column: str = "doc_id", files: int | None = None) -> None:
    """Write ``path``/tokens (ORC, one file per range of ids) and ``path``/files (ids per file). Runs jobs.

    Ranges come from the ids alone, so texts are read once and encoded once. What is there is replaced, so a job that was cut
    short can be done again.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _bounds(docs.select(F.col(id_column).cast("long").alias("doc_id")), n)
    encoded = encode_texts(docs, tokenizer_path, end_id, text, id_column, cuts)
    dealt = encoded.repartitionById(len(cuts) + 1, "file")
    inside = Window.partitionBy("file").orderBy("doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum(F.size("ids").cast("long")).over(inside), F.lit(0)))
    with shuffle_files_dropped(spark):
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**ORC).partitionBy("file").orc(f"{path}/tokens")
    totals = read_tokens(spark, path).groupBy("file").agg(F.max(F.col("at") + F.size("ids")).alias("n_ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    before.coalesce(1).write.mode("overwrite").orc(f"{path}/files")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, at (ids before it in its file), file. Filters on doc_id reach the stripes."""
    return spark.read.schema("doc_id bigint, ids array<int>, at bigint, file int").orc(f"{path}/tokens")


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_tokens`` gives, and ``start``: the ids of all documents before."""
    files = spark.read.schema("file int, before bigint").orc(f"{path}/files")
    # one row per file that was written, a few thousand at most
    return read_tokens(spark, path).join(F.broadcast(files), "file").withColumn("start", F.col("before") + F.col("at"))
