"""The four stored relations and the raw records they come from."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

SYSTEM = _schema(("id", S, False), ("name", S, False), ("version", S, False))

EXPERIMENT = _schema(("id", I, False), ("name", S, False), ("suite", S, False), ("system", S, False))

EXPERIMENT_RUN = _schema(
    ("id", I, False), ("experiment_id", I, False), ("run", I, False), ("exit", I, False), ("time", L, False)
)

EXPERIMENT_EVENT = _schema(
    ("id", L, False),
    ("experiment_run_id", I, False),
    ("name", S, False),
    ("host", S, True),
    ("task", S, True),
    ("task_instance", I, True),
    ("v_long", L, True),
    ("v_double", D, True),
    ("v_timestamp", TS, True),
    ("v_string", S, True),
)

EVENT_COLUMNS = EXPERIMENT_EVENT.fieldNames()

# Column widths of the stored relations.
MAX_HOST, MAX_TASK, MAX_STRING = 127, 1024, 1024

PRIMARY_KEYS = {"system": "id", "experiment": "id", "experiment_run": "id", "experiment_event": "id"}

# child relation -> (child column, parent relation, parent column, on delete)
FOREIGN_KEYS = {
    "experiment": ("system", "system", "id", "restrict"),
    "experiment_run": ("experiment_id", "experiment", "id", "cascade"),
    "experiment_event": ("experiment_run_id", "experiment_run", "id", "cascade"),
}

RELATIONS = {
    "system": SYSTEM,
    "experiment": EXPERIMENT,
    "experiment_run": EXPERIMENT_RUN,
    "experiment_event": EXPERIMENT_EVENT,
}

# Fields of a run's state file; suite and run name come from its folder.
RUN_STATE = _schema(
    ("command", S, True),
    ("runnerID", S, True),
    ("runnerName", S, True),
    ("runnerVersion", S, True),
    ("runExitCode", I, True),
    ("runTime", L, True),
    ("_corrupt", S, True),
)

# Fields of the task-info object in a Spark listener event.
TASK_INFO = _schema(
    ("Task ID", I, True),
    ("Index", I, True),
    ("Attempt", T.ShortType(), True),
    ("Executor ID", S, True),
    ("Host", S, True),
    ("Locality", S, True),
    ("Speculative", T.BooleanType(), True),
    ("Launch Time", L, True),
    ("Finish Time", L, True),
    ("Failed", T.BooleanType(), True),
)

LISTENER_EVENT = _schema(
    ("Event", S, True),
    ("Stage ID", L, True),
    ("Stage Attempt ID", L, True),
    ("Task Info", TASK_INFO, True),
    ("_corrupt", S, True),
)

KEY_VALUE = _schema(("k", L, True), ("v", S, True))
