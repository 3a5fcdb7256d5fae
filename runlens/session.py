"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(app_name: str = "runlens", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; on a cluster spark-submit supplies the session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: all instants are read and shown in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = sc.applicationId
        if app not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="runlens-")
        base = _LOCAL_FALLBACK[app]
    return base


def _work_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"runlens-{spark.sparkContext.applicationId}")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return os.path.join(_work_dir(spark), f"{label}-{uuid.uuid4().hex}")


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; frames built on them are lost."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write to the shared folder as Parquet and read back. Runs a job.

    Survives lost executors like a checkpoint does, is computed once, compressed, pruned by column
    when read, and its size is known to the optimizer. ``clean_up`` removes it.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What may be sent to every task: at most this many rows, and this many bytes of values.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def _width(column: str, kind: str) -> Column:
    """Bytes of a value; fixed-width ones count as eight."""
    c = F.col(f"`{column}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a frame. Runs a job."""
    width = sum((_width(c, t) for c, t in df.dtypes), F.lit(16))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return rows, size or 0


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if rows and bytes are within the bounds; above them the join shuffles. Runs a job.

    A plain count adds up per task. Counting behind a limit would send the limit's worth of rows of
    every task to a single one.
    """
    rows, size = measure(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def key_side(keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct rows of the small side of a semi or anti join, computed once.

    With few keys the other side is only streamed past them; with many, both sides shuffle. Runs jobs.
    """
    return broadcast_if_small(cut_lineage(keys.distinct()), max_rows)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than there are cores.

    A small file (or one of a single row group) is one task, however heavy the rows are. Large
    inputs have more splits than cores and are left alone: nothing is shuffled there. ``key`` should
    be unique; hashing it spares the sort that a round-robin shuffle needs to be repeatable.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
