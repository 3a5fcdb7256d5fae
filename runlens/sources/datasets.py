"""Datasets that are made once and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def is_complete(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


def clear(spark: SparkSession, path: str) -> None:
    """Remove the output of an earlier run, if there is one."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def ensure_dataset(
    spark: SparkSession, path: str, generate: Callable[[SparkSession], DataFrame], fmt: str = "parquet"
) -> DataFrame:
    """Read the dataset at ``path``, generating it first unless a complete one is there.

    A partial output (no success marker) is replaced; one that fails half-way is taken away.
    """
    if not is_complete(spark, path):
        try:
            generate(spark).write.mode("overwrite").format(fmt).save(path)
        except Exception:
            clear(spark, path)
            raise
    return spark.read.format(fmt).load(path)


def copy_dataset(spark: SparkSession, src: str, dst: str, src_format: str, dst_format: str, schema=None) -> DataFrame:
    """Copy into the store, converting the format on the way."""
    reader = spark.read.format(src_format)
    reader = reader.schema(schema) if schema is not None else reader
    reader.load(src).write.mode("overwrite").format(dst_format).save(dst)
    written = spark.read.format(dst_format)
    return (written.schema(schema) if schema is not None else written).load(dst)
