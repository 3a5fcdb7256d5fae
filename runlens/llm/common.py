"""What the operators of this subpackage share: row keys, intermediate tables, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.session import cut_lineage

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\r\x0b\x0c"

#: Drop the shuffle files of a query when it has ended, not when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder, read back, and free the shuffle files it took. Runs a job."""
    with shuffle_files_dropped(df.sparkSession):
        return cut_lineage(df, label)


def give_back() -> None:
    """Return the memory that this worker's allocators hold and do not use; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on the batches of a task; what it took is given back at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """128 bits that stand for a document in intermediate tables.

    Made of the id and the text, so it is the same in every scan. Ids that are null or not unique do
    no harm: rows share a key only if id and text are equal, and then share their results too.
    """
    whole = [F.col(id_column), F.col(text)]
    return F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b"))


def text_bytes(text: str = "text") -> Column:
    """The whole text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
