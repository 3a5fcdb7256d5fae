"""The event interchange format: ten columns, comma, newline, double quote, null as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from runlens.functions.timestamps import CSV_FORMAT
from runlens.schemas import EVENT_COLUMNS, EXPERIMENT_EVENT, KEY_VALUE

_OPTIONS = {
    "sep": ",", "quote": '"', "escape": '"', "nullValue": "", "timestampFormat": CSV_FORMAT, "header": "false",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_event_csv(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    events.select(*EVENT_COLUMNS).write.mode(mode).options(**_OPTIONS, emptyValue='""').csv(path)


def read_event_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bulk import; values may span lines."""
    return spark.read.schema(EXPERIMENT_EVENT).options(**_OPTIONS, emptyValue="", multiLine="true").csv(path)


def read_key_values(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headerless (long, string) CSV."""
    return spark.read.schema(KEY_VALUE).csv(path, sep=",", quote='"', escape='"')
