"""Keep the optimizer from computing an expensive column twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose later filters are not rewritten into their expressions.

    A filter on a projected column is pushed below the projection with the expression copied into
    it, which then runs once for the filter and once for the result. It does not move below a
    generator, and a generator of one element costs next to nothing.
    """
    if len(columns) == 1:
        ((name, value),) = columns.items()
        return df.select("*", F.explode(F.array(value)).alias(name))
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
