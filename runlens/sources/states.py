"""Run-state files: one JSON object per run folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from runlens.schemas import RUN_STATE
from runlens.sources.files import is_marked_tree, logical_path, mark_tree, path_exists, source_of, suite_folders

STATE_FILE = "state.json"


def scan_run_states(
    spark: SparkSession, root: str, suites: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(states, rejects) of all suites below ``root``, or of the given ones.

    Suite and run name are the two folders above ``state.json``; folders without one do not show up.
    Unreadable objects go to the rejects, as does a note on every state without a command (the state
    itself is kept). Without a run time a state can not become a run, so it is rejected. A root that
    does not exist is an error.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        raise ValueError(f"no folder {root!r}")
    marked = is_marked_tree(spark, root)
    # suite/run/state.json, or the folders that write_run_states puts in their place; nothing else
    # below the root is listed or opened
    pattern = f"{suite_folders(root, suites)}/*/*{STATE_FILE}"
    if not path_exists(spark, pattern):
        return split_states(spark.createDataFrame([], T.StructType([*RUN_STATE, T.StructField("file", T.StringType())])))
    raw = (
        spark.read.schema(RUN_STATE)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true")
        .json(pattern)
        .select("*", logical_path(source_of(F.col("_metadata.file_path"), marked), marked).alias("file"))
        .where(F.col("file").endswith("/" + STATE_FILE))
    )
    return split_states(raw)


def split_states(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = F.split("file", "/")
    located = raw.select(
        "file",
        F.element_at(parts, -3).alias("suite"),
        F.element_at(parts, -2).alias("name"),
        *[c for c in RUN_STATE.fieldNames()],
    )
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "malformed json")
        .when(F.col("runnerID").isNull(), "no runner")
        .when(F.col("runTime").isNull(), "no run time")
    )
    checked = located.withColumn("reason", reason)
    states = checked.where(F.col("reason").isNull()).drop("reason", "_corrupt")
    notes = states.where(F.col("command").isNull()).withColumn("reason", F.lit("no command (kept)"))
    rejects = checked.where(F.col("reason").isNotNull())
    return states, rejects.select("file", "suite", "name", "reason").unionByName(
        notes.select("file", "suite", "name", "reason")
    )


def write_run_states(states: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One ``state.json`` folder per run, readable by ``scan_run_states``; nulls are kept."""
    (
        states.withColumn("file", F.lit(STATE_FILE))
        .write.mode(mode)
        .option("ignoreNullFields", "false")
        .partitionBy("suite", "name", "file")
        .json(root)
    )
    mark_tree(states.sparkSession, root)
