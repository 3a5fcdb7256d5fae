"""Task start and end times in Spark event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.functions.once import evaluated
from runlens.operators.extract.base import Extractor, context_columns, event_columns, register_extractor
from runlens.schemas import LISTENER_EVENT, TASK_INFO

TASK_END = "SparkListenerTaskEnd"


def extract_task_ends(lines: DataFrame) -> DataFrame:
    """Two events per finished, not failed task: running at its launch, finished at its end.

    The host stays null. A line that is no JSON object, or a task end without complete task info,
    is rejected; a task end without stage or attempt number gives nothing.
    """
    keep = ["file", "record_key", *context_columns(lines)]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = evaluated(lines, r=F.from_json("value", LISTENER_EVENT, options)).select(*keep, "r")
    corrupt = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    staged = (
        (F.col("r.Event") == TASK_END)
        & F.col("r.`Stage ID`").isNotNull()
        & F.col("r.`Stage Attempt ID`").isNotNull()
    )
    info = F.col("r.`Task Info`")
    incomplete = F.lit(False)
    for field in TASK_INFO.fieldNames():
        incomplete = incomplete | info[field].isNull()
    reason = F.when(corrupt, "malformed json").when(incomplete, "incomplete task info")
    tagged = parsed.where(corrupt | staged).select(*keep, "r", reason.alias("reject_reason"))
    relevant = tagged.where(F.col("reject_reason").isNotNull() | ~info["Failed"])

    def change(state: str, at: str):
        return F.struct(F.lit(f"state_change_{state}").alias("s"), F.timestamp_millis(info[at]).alias("t"))

    none = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("timestamp").alias("t"))
    changes = F.when(F.col("reject_reason").isNotNull(), F.array(none)).otherwise(
        F.array(change("running", "Launch Time"), change("finished", "Finish Time"))
    )
    task = F.concat(
        F.lit("stage-"), F.col("r.`Stage ID`").cast("string"), F.lit("#"), F.col("r.`Stage Attempt ID`").cast("string")
    )
    flat = relevant.select("*", F.inline(changes))
    return flat.select(
        *keep,
        F.lit("spark_tasks").alias("extractor"),
        *event_columns(
            name=F.col("s"), task=task, task_instance=info["Task ID"], v_long=info["Index"], v_timestamp=F.col("t")
        ),
        "reject_reason",
    )


SPARK_TASKS = register_extractor(
    Extractor("spark_tasks", "logs/spark", (r"app-\d+-\d+",), "json", extract_task_ends)
)
