"""Extractors as table functions for SQL: ``SELECT * FROM task_states(TABLE(lines))``.

A table function is handed rows one by one in Python, so it is for extractors that a user writes as plain
Python, and for ad-hoc SQL; the DataFrame form of an extractor stays inside generated code. The
result has the columns of the given lines (all but ``value``), whatever they are, then those of an event and ``reject_reason``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Row, SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from runlens.operators.extract.base import ATTRIBUTES
from runlens.operators.extract.flink import LINE_V1, LINE_V2

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def table_function(name: str, events: Callable[[str], Iterable[dict]]):
    """A table function of the rule ``events``: a line's text to event attributes, ``reject_reason`` among them if a line is bad."""

    class Extract:
        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not lines.isTable or "value" not in lines.dataType.fieldNames():
                raise ValueError(f"{name} takes a table with a column value")
            kept = [f for f in lines.dataType.fields if f.name != "value"]
            added = [T.StructField(n, _TYPES[t]) for n, t in ATTRIBUTES.items()]
            fixed = [T.StructField("extractor", T.StringType()), *added, T.StructField("reject_reason", T.StringType())]
            return AnalyzeResult(T.StructType([*kept, *fixed]))

        def eval(self, row: Row) -> Iterator[tuple]:
            kept = [v for k, v in row.asDict().items() if k != "value"]
            for found in events(row["value"] or ""):
                yield (*kept, name, *[found.get(n) for n in ATTRIBUTES], found.get("reject_reason"))

    Extract.__name__ = name
    return udtf(Extract)


_V1, _V2 = (re.compile(p, re.ASCII) for p in (LINE_V1, LINE_V2))
_LARGEST = (1 << 31) - 1


def task_states(line: str) -> Iterator[dict]:
    """The rule of the ``flink_tasks`` extractor for one line."""
    if " switched " not in line:
        return
    if found := _V1.fullmatch(line):
        clock, task, number, _, state = found.groups()
    elif found := _V2.fullmatch(line):
        clock, where, number, _, task_id, state = found.groups()
        task = f"{task_id} ({where})"
    else:
        return
    event = {"name": f"state_change_{state.lower()}", "task": task}
    try:
        event["v_timestamp"] = datetime.strptime(clock, "%Y-%m-%d %H:%M:%S,%f").replace(tzinfo=timezone.utc)
    except ValueError:
        event["reject_reason"] = "bad timestamp"
    if int(number) <= _LARGEST:
        event["task_instance"] = int(number)
    else:
        event.setdefault("reject_reason", "task number out of range")
    yield event


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("task_states", table_function("flink_tasks", task_states))
