"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runlens.plans.adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


_CATALOG: dict[str, Query] = {}


def query(sql: str | None, name: str | None = None):
    """Register the decorated builder under its own name; ``sql`` is None where no SQL states it."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or build.__name__
        if key in _CATALOG:
            raise ValueError(f"query {key!r} is registered twice")
        _CATALOG[key] = Query(key, build, sql)
        return build

    return add


def catalog() -> dict[str, Query]:
    from runlens.plans import queries  # noqa: F401  (registers on import)

    return dict(_CATALOG)
