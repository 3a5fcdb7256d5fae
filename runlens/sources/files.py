"""Line, JSON and file-level scans with logical paths.

A "logical file" is a plain file. In a tree that this package wrote (``mark_tree``), it is what Spark writes in
its place: a folder of part files, possibly below ``column=value`` folders. There,
``results/suite=a/name=e.run01/sub=logs/.../part-0`` stands for ``results/a/e.run01/logs/...``. Names in
other trees mean what they say, whatever they look like.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runlens.session import broadcast_if_small, cut_lineage
from runlens.sources.hidden import hidden_files, readable


def decode_path(path: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded; '+' stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


TREE_MARK = "_runlens_tree"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def mark_tree(spark: SparkSession, root: str) -> None:
    """Note that the folders below ``root`` are laid out by Spark."""
    fs, target = _fs(spark, f"{root.rstrip('/')}/{TREE_MARK}")
    fs.create(target, True).close()


def is_marked_tree(spark: SparkSession, root: str) -> bool:
    fs, target = _fs(spark, f"{root.rstrip('/')}/{TREE_MARK}")
    return fs.exists(target)


def literal_path(path: Column) -> Column:
    """A path in which nothing is taken for a pattern."""
    return F.regexp_replace(path, r"([\\*?\[\]{},^])", r"\\$1")


def _literal(name: str) -> str:
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", name)


def source_of(file_path: Column, marked: bool) -> Column:
    """Encoded path of a physical file; in a marked tree, of the folder if it is a part file.

    Plain string functions only, as this runs once per line.
    """
    if not marked:
        return file_path
    last = F.substring_index(file_path, "/", -1)
    folder = F.left(file_path, F.length(file_path) - F.length(last) - 1)
    return F.when(last.startswith("part-"), folder).otherwise(file_path)


def logical_path(source: Column, marked: bool) -> Column:
    """Path of a source; in a marked tree, without the ``column=`` parts of partition folders."""
    if not marked:
        return decode_path(source)
    plain = F.regexp_replace(decode_path(source), r"/(?:[A-Za-z_]\w*)=", "/")
    return decode_path(plain)


def below(path: Column, root: str) -> Column:
    """Part of a logical path after ``root`` (given as in the read call)."""
    tail = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    return F.substring_index(path, tail + "/", -1)


def _text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, recursiveFileLookup=True)


#: Splits smaller than this are read several to a task.
TASK_BYTES = 32 << 20
_SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def _in_tasks(spark: SparkSession, scan: DataFrame) -> DataFrame:
    """Many small splits in few tasks; every split is still read on its own, one after the other."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SPLIT_BYTES))
    if size >= TASK_BYTES:
        return scan
    splits = scan.rdd.getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-splits * size // TASK_BYTES))
    return scan.coalesce(tasks) if tasks < splits else scan


def scan_lines(spark: SparkSession, paths: str | Sequence[str], marked: bool = False) -> DataFrame:
    """(file, part, block, record_key, value): one row per line; gzip and other codecs by extension.

    ``file`` is the source (see ``source_of``), ``part`` the physical file, ``block`` where the split begins in it.
    ``record_key`` follows the line order inside a split and is the same again when a lost task is redone;
    ``number_lines`` makes it a line number of the file.
    """
    lines = _text(spark, paths).select(
        source_of(F.col("_metadata.file_path"), marked).alias("file"),
        F.substring_index("_metadata.file_path", "/", -1).alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    return _in_tasks(spark, lines).select("file", "part", "block", F.monotonically_increasing_id().alias("record_key"), "value")


SPLIT = ("file", "part", "block")


def split_positions(lines: DataFrame) -> DataFrame:
    """(file, part, block, first, before): first key of every split and the lines of its file before it.

    One row per split. Splits of a file are few, so they are summed up in one place; lines are only counted.
    """
    counted = lines.groupBy(*SPLIT).agg(F.min("record_key").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*SPLIT, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Rows of ``scan_lines``, or what is left of them, with ``line_no`` from 1 in their file.

    Numbers do not depend on how files are split or packed into tasks. ``lines`` is scanned once more, to count.
    Runs jobs.
    """
    positions = broadcast_if_small(cut_lineage(split_positions(lines)))
    return with_line_numbers(lines, positions)


def with_line_numbers(rows: DataFrame, positions: DataFrame, *also: str) -> DataFrame:
    joined = rows.join(positions, [*SPLIT, *also])
    number = F.col("record_key") - F.col("first") + F.col("before") + 1
    return joined.select(*[rows[c] for c in rows.columns], number.alias("line_no"))


def appended_lines(spark: SparkSession, paths: str | Sequence[str], offsets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(lines not seen before, offsets to keep for the next call): files are only ever appended to.

    ``offsets`` (file, n_lines) is what the call before returned; without it, everything is new. Both results are
    tables of their own, so they agree even if a file grows meanwhile. Runs jobs.
    """
    numbered = cut_lineage(number_lines(scan_lines(spark, paths)).select("file", "line_no", "value"))
    known = file_line_counts(numbered)
    if offsets is None:
        return numbered, known
    gone = offsets.join(known, "file", "left_anti").select("file", "n_lines")
    return delta_lines(numbered, offsets), known.unionByName(gone)


def scan_json_lines(lines: DataFrame, schema, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of lines that hold one JSON object each."""
    parsed = lines.withColumn(
        "record", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    bad = F.col("record").isNull() | F.col(f"record.{corrupt}").isNotNull()
    rejects = parsed.where(bad).select("file", "record_key", "value", F.lit("malformed json").alias("reason"))
    return parsed.where(~bad), rejects


def suite_folders(root: str, suites: Sequence[str] | None = None) -> str:
    """Path pattern of the folders of all or some suites, in either layout."""
    root = _literal(root.rstrip("/"))
    if suites is None:
        return f"{root}/*"
    return f"{root}/{{{','.join(f'{_literal(s)},suite={_literal(s)}' for s in suites)}}}"


def path_exists(spark: SparkSession, pattern: str) -> bool:
    fs, path = _fs(spark, pattern)
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def hidden_names(spark: SparkSession, root: str, suites: Sequence[str] | None = None) -> list[str]:
    """Paths below the root whose names start with ``_`` or ``.``, for roots whose files ``hidden.readable`` can not open.

    Level by level inside the file system; only the names found come back.
    """
    folder, found = _literal(root.rstrip("/")) if suites is None else suite_folders(root, suites), []
    while path_exists(spark, f"{folder}/*"):
        fs, pattern = _fs(spark, f"{folder}/[_.]*")
        found += [status.getPath().toUri().getPath() for status in fs.globStatus(pattern) or ()]
        folder += "/*"
    return sorted(found)


def scan_files(spark: SparkSession, root: str, suites: Sequence[str] | None = None) -> DataFrame:
    """(source, path, rel, file_name, n_parts, bytes, modified) of all regular files below ``root``, hidden ones included.

    Only listing columns are read: the content column is pruned, so no file is opened. With
    ``suites``, only their folders are listed. In a marked tree, hidden files are Spark's own and stay out.
    """
    marked = is_marked_tree(spark, root)
    folder = _literal(root) if suites is None else suite_folders(root, suites)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = listed.select(
        source_of(F.col("_metadata.file_path"), marked).alias("source"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    if not marked and readable(spark, root):
        parts = parts.unionByName(hidden_files(spark, root, suites))
    files = parts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("length").alias("bytes"), F.max("modified").alias("modified")
    )
    located = files.withColumn("path", logical_path(F.col("source"), marked))
    return located.select(
        "source",
        "path",
        below(F.col("path"), root).alias("rel"),
        F.substring_index("path", "/", -1).alias("file_name"),
        "n_parts", "bytes", "modified",
    )


def file_line_counts(lines: DataFrame, file: str = "file") -> DataFrame:
    """Offset table: lines per file."""
    return lines.groupBy(file).agg(F.count(F.lit(1)).alias("n_lines"))


def delta_lines(numbered: DataFrame, offsets: DataFrame, file: str = "file", line_no: str = "line_no") -> DataFrame:
    """Lines after the recorded count of their file; all lines of files not recorded.

    Offsets are one row per file and broadcast unless there are very many; lines are then not
    shuffled. Runs jobs to size the offsets.
    """
    seen = offsets.select(F.col(file).alias("__file"), F.col("n_lines").alias("__seen"))
    known = broadcast_if_small(cut_lineage(seen))
    joined = numbered.join(known, F.col(file) == F.col("__file"), "left")
    return joined.where(F.col(line_no) > F.coalesce("__seen", F.lit(0))).drop("__file", "__seen")


def latest_file(files: DataFrame, group: Sequence[str], path: str = "path", modified: str = "modified") -> DataFrame:
    """Newest file per group; equal times resolve to the largest path."""
    newest = F.max(F.struct(F.col(modified), F.col(path)))
    return files.groupBy(*group).agg(newest.alias("__m")).select(
        *group, F.col(f"__m.{path}").alias(path), F.col(f"__m.{modified}").alias(modified)
    )


def changed_latest(before: DataFrame, after: DataFrame, group: Sequence[str], path: str = "path") -> DataFrame:
    """Groups whose newest file differs from the earlier snapshot (or is new)."""
    old = before.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(path).alias("__old"))
    cond = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    joined = after.join(old, cond, "left")
    return joined.where(~F.col(path).eqNullSafe(F.col("__old"))).select(*after.columns)


def checksum_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, md5) of whole physical files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return content.select(decode_path(F.col("path")).alias("path"), F.md5("content").alias("md5"))


def checksum_mismatches(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose MD5 differs from the expected one or is missing."""
    want = expected.select(F.col(key).alias("__k"), F.lower("md5").alias("expected"))
    return actual.join(want, F.col(key).eqNullSafe(F.col("__k")), "left").where(
        ~F.col("md5").eqNullSafe(F.col("expected"))
    ).select(key, "md5", "expected")
