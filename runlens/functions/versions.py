"""Version strings ``d(.d)*(-suffix)?`` as sortable keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: version syntax.
VERSION = r"^(\d+(?:\.\d+)*)(-[a-zA-Z0-9_.-]+)?$"


def version_numbers(version: Column) -> Column:
    """Numeric components; null on bad syntax."""
    numbers = F.split(F.regexp_extract(version, VERSION, 1), r"\.")
    return F.when(version.rlike(VERSION), F.transform(numbers, lambda n: n.try_cast("int")))


def version_suffix(version: Column) -> Column:
    return F.when(version.rlike(VERSION), F.lower(F.regexp_extract(version, VERSION, 2)))


def version_key(version: Column) -> Column:
    """Sort key: components, shorter first, then snapshot < other suffix < stable."""
    suffix = version_suffix(version)
    rank = F.when(suffix == "-snapshot", 0).when(suffix == "", 2).otherwise(1)
    return F.struct(
        version_numbers(version).alias("numbers"), rank.alias("suffix_rank"), suffix.alias("suffix")
    )


def version_prefixes(version: Column) -> Column:
    """Numeric prefixes, longest first: 1.2.3 -> [1.2.3, 1.2, 1]."""
    numbers = F.transform(version_numbers(version), lambda n: n.cast("string"))
    sizes = F.sequence(F.size(numbers), F.lit(1), F.lit(-1))
    return F.transform(sizes, lambda n: F.array_join(F.slice(numbers, 1, n), "."))
