"""Tokens, run names and templates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Name formats.
RUN_NAME = r"^(.+)\.run(\d{2})$"
KEYS = r"__\S+?__|\$\{[^}\s]+\}"


def word_tokens(line: Column) -> Column:
    """Lower-cased tokens of a line, split on runs of non-word characters.

    Trailing empty tokens go, a leading one stays, and an empty line is one empty token.
    """
    parts = F.split(F.lower(line), r"\W+")
    no_words = (line != "") & ~line.rlike(r"\w")
    kept = F.filter(parts, lambda token, i: (i == 0) | (token != ""))
    return F.when(no_words, F.array().cast("array<string>")).otherwise(kept)


def format_run_name(experiment: Column, run: Column) -> Column:
    return F.format_string("%s.run%02d", experiment, run)


def parse_run_name(name: Column) -> Column:
    """(experiment, run) or null when the name has no two-digit run suffix."""
    parsed = F.struct(
        F.regexp_extract(name, RUN_NAME, 1).alias("experiment"),
        F.regexp_extract(name, RUN_NAME, 2).cast("int").alias("run"),
    )
    return F.when(name.rlike(RUN_NAME), parsed)


def template_keys(template: Column) -> Column:
    """Keys that a template names, as ``__key__`` or ``${key}``."""
    marked = F.regexp_extract_all(template, F.lit(KEYS), F.lit(0))
    return F.array_distinct(F.transform(marked, lambda m: F.regexp_replace(m, r"^(?:__|\$\{)|(?:__|\})$", "")))


def cut_template(template: Column, keys: Sequence[str]) -> Column:
    """(pieces, keys): a template cut at every mark of a known key, and the numbers of the keys between the pieces.

    Cut once, a template is filled as often as needed (``fill_template``).
    """
    known = "|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True))
    if not known:
        return F.struct(F.array(template).alias("pieces"), F.array().cast("array<int>").alias("keys"))
    mark = rf"__(?:{known})__|\$\{{(?:{known})\}}"
    marks = F.regexp_extract_all(template, F.lit(mark), F.lit(0))
    names = F.transform(marks, lambda m: F.regexp_replace(m, r"^(?:__|\$\{)|(?:__|\})$", ""))
    order = F.array(*[F.lit(k) for k in keys])
    numbers = F.transform(names, lambda n: (F.array_position(order, n) - 1).cast("int"))
    return F.struct(F.split(template, mark).alias("pieces"), numbers.alias("keys"))


def fill_template(cut: Column, values: Sequence[Column]) -> Column:
    """A cut template with its keys' values, in the order in which the keys were given; values are not searched for keys."""
    pieces, numbers = cut["pieces"], cut["keys"]
    if not values:
        return F.get(pieces, F.lit(0))
    given = F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    filled = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(given, F.get(numbers, i)), F.lit(""))))
    return F.array_join(filled, "")


def substitute(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace every ``__key__`` and ``${key}`` by its value, in one pass."""
    return fill_template(cut_template(template, list(values)), list(values.values()))


def unknown_keys(template: Column, values: Mapping[str, Column]) -> Column:
    """Keys that a template names and nothing fills."""
    return F.array_except(template_keys(template), F.array(*[F.lit(k) for k in values]).cast("array<string>"))
