"""Files that Spark's readers pass over, as a part of their path below the root starts with ``_`` or ``.``.

They are listed in tasks: one level below the root by suite, the rest by run folder. Spark does read a file below a hidden
folder if it is asked for it by name; one whose own name is hidden is read here, in splits like any other. pyarrow's file
systems do both (local, HDFS, object stores); ``readable`` says whether they know the one of the root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.sources.growing import COMPRESSED, SPLIT_BYTES, blocks, file_system, line_start, plain_path, spark_uri

_LISTED = "path string, source string, folder boolean, length bigint, modified timestamp"
_ARROW = pa.schema([
    ("path", pa.string()), ("source", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")),
])


def qualified(spark: SparkSession, root: str) -> str:
    """The root with its scheme, as the session's default file system has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def readable(spark: SparkSession, root: str) -> bool:
    try:
        file_system(qualified(spark, root))
    except (OSError, ValueError):  # pyarrow's errors for schemes and hosts that it does not know
        return False
    return True


def has_hidden_name(source: Column) -> Column:
    """Whether the last part of a path is a name that Spark's readers do not open."""
    return F.substring_index(source, "/", -1).rlike("^[_.]")


def hidden_files(spark: SparkSession, root: str, suites: Sequence[str] | None = None) -> DataFrame:
    """(source, length, modified) of the hidden regular files in the suite folders below the root, of all or some suites.

    ``source`` is what ``_metadata.file_path`` says of such a file. The driver lists the root alone.
    """
    root = qualified(spark, root)
    fs, top = file_system(root)
    names = [f"{top}/{s}" for s in suites] if suites is not None else [
        f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.type == pafs.FileType.Directory
    ]
    tasks = spark.sparkContext.defaultParallelism

    def listing(recursive: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, top = file_system(root)
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    found = [
                        (f.path, spark_uri(f.path, root), f.type == pafs.FileType.Directory, f.size or 0, None if f.mtime_ns is None else f.mtime_ns // 1000)
                        for f in fs.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True))
                        if (f.type == pafs.FileType.Directory and not recursive) or (f.is_file and _is_hidden(f.path[len(top) :]))
                    ]
                    columns = zip(*found, strict=True) if found else [[]] * len(_ARROW)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        return run

    tops = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), tasks)), "path")
    level = tops.mapInArrow(listing(False), _LISTED)
    below = level.where("folder").select("path").repartition(4 * tasks, "path").mapInArrow(listing(True), _LISTED)
    return level.where("not folder").unionByName(below).select("source", "length", "modified")


def _is_hidden(below: str) -> bool:
    return any(part[:1] in ("_", ".") for part in below.split("/") if part)


def scan_hidden_lines(files: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of files (source, bytes) as ``scan_lines`` gives them, whatever the files are called.

    ``record_key`` is the byte at which the split begins plus the line's place in it. A compressed file is one split.
    """
    spark = files.sparkSession
    root = qualified(spark, root)
    whole = F.lower("source").rlike(f"({'|'.join(c.replace('.', '[.]') for c in COMPRESSED)})$")
    step = F.when(whole, F.greatest("bytes", F.lit(1))).otherwise(F.lit(split_bytes))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)
    splits = files.select("source", "bytes", whole.alias("whole"), F.explode(begins).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                place = 0
                for found in _split_lines(fs, plain_path(row["source"], root), row["bytes"], row["whole"], row["at"], split_bytes):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["source"]] * n, pa.string()), pa.array([row["source"].rsplit("/", 1)[-1]] * n, pa.string()),
                            pa.array([row["at"]] * n, pa.int64()), pa.array(range(row["at"] + place, row["at"] + place + n), pa.int64()),
                            pa.array([x.decode("utf-8", "replace") for x in found], pa.string()),
                        ],
                        names=["file", "part", "block", "record_key", "value"],
                    )
                    place += n

    dealt = splits.repartition(4 * spark.sparkContext.defaultParallelism, "source", "at")
    return dealt.mapInArrow(run, "file string, part string, block bigint, record_key bigint, value string")


def _split_lines(fs: pafs.FileSystem, path: str, size: int, whole: bool, at: int, split_bytes: int) -> Iterator[list[bytes]]:
    """Lines that begin in a split, some blocks at a time; line ends are LF, CR LF, or CR alone."""
    if whole:
        with fs.open_input_stream(path, compression="detect") as file:
            yield from _lines(iter(lambda: file.read(split_bytes), b""))
        return
    with fs.open_input_file(path) as file:
        begin = line_start(file, at, 0, size)
        stop = size if at + split_bytes >= size else line_start(file, at + split_bytes, 0, size)
        yield from _lines(blocks(file, begin, stop))


def _lines(parts: Iterator[bytes]) -> Iterator[list[bytes]]:
    rest = b""
    for part in parts:
        rest += part
        cut = max(rest.rfind(b"\n"), rest.rfind(b"\r", 0, len(rest) - 1)) + 1
        if cut:
            yield rest[:cut].splitlines()
            rest = rest[cut:]
    if rest:
        yield rest.splitlines()
