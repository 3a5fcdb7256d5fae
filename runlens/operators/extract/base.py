"""Extractors: what files they want and how lines become events.

An extractor maps (file, record_key, value, *context) rows to event rows. Context columns (say
suite and run name) pass through. Lines it understands but can not convert come out with a
``reject_reason`` instead of vanishing; lines that are none of its business are filtered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runlens.schemas import MAX_HOST, MAX_STRING, MAX_TASK

LINE_COLUMNS = ("file", "record_key", "value")
# Event attributes an extractor may set, with their types.
ATTRIBUTES = {
    "name": "string", "host": "string", "task": "string", "task_instance": "int", "v_long": "bigint",
    "v_double": "double", "v_timestamp": "timestamp", "v_string": "string",
}


@dataclass(frozen=True)
class Extractor:
    name: str
    prefix: str
    patterns: tuple[str, ...]
    reader: str
    extract: Callable[[DataFrame], DataFrame]

    def wants(self, rel: Column, file_name: Column) -> Column:
        """Path below the run folder starts with the prefix and the file name matches fully."""
        full = "|".join(f"(?:{p})" for p in self.patterns)
        return rel.startswith(self.prefix) & file_name.rlike(f"^(?:{full})$")


_REGISTRY: dict[str, Extractor] = {}


def register_extractor(extractor: Extractor) -> Extractor:
    _REGISTRY[extractor.name] = extractor
    return extractor


def registered() -> dict[str, Extractor]:
    return dict(_REGISTRY)


def context_columns(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c not in LINE_COLUMNS]


def event_columns(**values: Column) -> list[Column]:
    """All event attributes in order; those not given are null."""
    return [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in ATTRIBUTES.items()]


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("reject_reason").isNotNull())


def clamp(events: DataFrame) -> DataFrame:
    """Cut host, task and string value to the stored widths."""
    return events.withColumns({
        "host": F.left("host", F.lit(MAX_HOST)),
        "task": F.left("task", F.lit(MAX_TASK)),
        "v_string": F.left("v_string", F.lit(MAX_STRING)),
    })


def event_id() -> Column:
    """Same id on every import of the same record, without a shared counter."""
    return F.xxhash64("extractor", "file", "record_key", "name")


def to_event_rows(events: DataFrame, run_id: Column, *context: str) -> DataFrame:
    """Rows of the stored event relation, followed by context columns."""
    return clamp(events).select(
        event_id().alias("id"), run_id.cast("int").alias("experiment_run_id"), *ATTRIBUTES, *context
    )


def route_files(files: DataFrame, extractors: Iterable[Extractor]) -> DataFrame:
    """One row per (file, extractor that wants it), with the number of readers and extractors.

    The route list is a handful of predicates, so it is written into the projection: no join.
    """
    routes = [
        F.when(e.wants(F.col("rel"), F.col("file_name")),
               F.struct(F.lit(e.name).alias("extractor"), F.lit(e.reader).alias("reader")))
        for e in extractors
    ]
    matched = files.withColumn("__routes", F.filter(F.array(*routes), lambda r: r.isNotNull()))
    return matched.select(
        *files.columns,
        F.size(F.array_distinct(F.transform("__routes", lambda r: r["reader"]))).alias("n_readers"),
        F.size("__routes").alias("n_extractors"),
        F.inline("__routes"),
    )


__all__ = [
    "ATTRIBUTES", "Extractor", "accepted", "clamp", "context_columns", "event_columns", "event_id",
    "register_extractor", "registered", "rejected", "route_files", "to_event_rows",
]
