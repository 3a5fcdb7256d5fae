"""Sums of large files: a tree of MD5 over fixed blocks.

A plain MD5 takes a file from front to end and so is one task's work (``files.checksum_files``, for small files). Here a file is cut into
blocks of fixed size, which tasks read and sum up on their own. The sums of ``fan`` neighbouring nodes, written one after the
other as text, are summed up again, until one is left. The result depends on the content, the block size and the fan-out alone, not on
tasks or splits. A file of one block has the plain MD5. Empty files have no row, as Spark does not list them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.session import cut_lineage
from runlens.sources.files import decode_path
from runlens.sources.growing import file_system

BLOCK_BYTES = 8 << 20
FAN = 256


def file_blocks(spark: SparkSession, paths: str | Sequence[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, bytes, block) of all blocks of all files; files are only listed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    files = listed.select(decode_path(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    last = F.floor((F.col("bytes") - 1) / block_bytes)
    return files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))


def block_sums(blocks: DataFrame, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """``file_blocks`` with ``md5`` of each block. Blocks are dealt over tasks, so one large file is many tasks' work."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sums = batch.column(0).to_pylist(), []
            for path, block in zip(paths, batch.column(2).to_pylist()):
                fs, plain = file_system(path)
                with fs.open_input_file(plain) as f:
                    sums.append(hashlib.md5(f.read_at(block_bytes, block * block_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=["path", "bytes", "block", "md5"])

    dealt = blocks.repartition(parts, "path", "block") if parts else blocks.repartition("path", "block")
    return dealt.mapInArrow(rows, "path string, bytes bigint, block bigint, md5 string")


def tree_checksums(
    spark: SparkSession, paths: str | Sequence[str], block_bytes: int = BLOCK_BYTES, fan: int = FAN, parts: int | None = None
) -> DataFrame:
    """(path, bytes, n_blocks, md5) of files of any size. Runs jobs."""
    sums = cut_lineage(block_sums(file_blocks(spark, paths, block_bytes), block_bytes, parts), "block-sums")
    left = (sums.agg(F.max("block")).first()[0] or 0) + 1
    blocks = F.floor((F.col("bytes") - 1) / block_bytes) + 1
    nodes = sums.select("path", "bytes", blocks.alias("n_blocks"), blocks.alias("left"), F.col("block").alias("node"), "md5")
    while left > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "md5"))), lambda x: x["md5"])
        above = nodes.groupBy("path", "bytes", "n_blocks", "left", F.floor(F.col("node") / fan).alias("node")).agg(children.alias("sums"))
        # a file that has come to one node stays as it is
        up = F.when(F.col("left") > 1, F.md5(F.array_join("sums", "").cast("binary"))).otherwise(F.col("sums")[0])
        nodes = above.select("path", "bytes", "n_blocks", F.ceil(F.col("left") / fan).alias("left"), "node", up.alias("md5"))
        left = -(-left // fan)
    return nodes.select("path", "bytes", "n_blocks", "md5")
