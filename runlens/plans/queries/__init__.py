from runlens.plans.queries import (  # noqa: F401
    datagen, derived, design, extraction, graph, results, scans, settings, store, streams, workloads,
)
