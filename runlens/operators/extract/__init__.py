from runlens.operators.extract import dstat, flink, spark_tasks  # noqa: F401  (register themselves)
from runlens.operators.extract.base import (
    Extractor, accepted, register_extractor, registered, rejected, route_files, to_event_rows,
)

__all__ = [
    "Extractor", "accepted", "register_extractor", "registered", "rejected", "route_files", "to_event_rows",
]
