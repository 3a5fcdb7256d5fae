"""Task state changes in job-manager logs, in the older and the newer line format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.functions.once import evaluated
from runlens.functions.timestamps import log_timestamp
from runlens.operators.extract.base import Extractor, context_columns, event_columns, register_extractor

# Log line formats. Of the newer one, the message starts after the last " - ".
CLOCK = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})"
STATES = "(SCHEDULED|DEPLOYING|RUNNING|FINISHED)"
LINE_V1 = rf"^{CLOCK}\t(.+)\((\d+)/(\d+)\) switched to {STATES}\W*$"
LINE_V2 = rf"^{CLOCK}.* -(?!.* - .) (.+) \((\d+)/(\d+)\) \((.+)\) switched from \w+ to {STATES}$"

# A matching line is rewritten to its parts in one go: clock, number, state, then the task.
_MARK = "\x01"
_PARTS_V1 = f"{_MARK}$1{_MARK}$3{_MARK}$5{_MARK}$2"
_PARTS_V2 = f"{_MARK}$1{_MARK}$3{_MARK}$6{_MARK}$5 ($2)"


def extract_task_states(lines: DataFrame) -> DataFrame:
    """One event per state change; other states and other lines give none."""
    keep = ["file", "record_key", *context_columns(lines)]
    value = F.col("value")
    # a substring test spares the regular expressions on the bulk of a log
    candidates = lines.where(value.contains(" switched ") & ~value.startswith(_MARK))
    v1 = F.when(F.substring(value, 24, 1) == "\t", F.regexp_replace(value, LINE_V1, _PARTS_V1)).otherwise(value)
    tried = evaluated(candidates, __v1=v1)
    v2 = F.when(F.col("__v1").startswith(_MARK), F.col("__v1")).otherwise(F.regexp_replace(value, LINE_V2, _PARTS_V2))
    parsed = evaluated(tried, __parts=v2).where(F.col("__parts").startswith(_MARK))
    parts = F.split("__parts", _MARK, 5)
    events = parsed.select(
        *keep,
        F.lit("flink_tasks").alias("extractor"),
        *event_columns(
            name=F.concat(F.lit("state_change_"), F.lower(parts[3])),
            task=parts[4],
            task_instance=parts[2].try_cast("int"),
            v_timestamp=log_timestamp(parts[1]),
        ),
    )
    reason = F.when(F.col("v_timestamp").isNull(), "bad timestamp").when(
        F.col("task_instance").isNull(), "task number out of range"
    )
    return evaluated(events, reject_reason=reason)


FLINK_TASKS = register_extractor(
    Extractor("flink_tasks", "logs/flink", (r"flink-.+-jobmanager-.+\.log",), "line", extract_task_states)
)
