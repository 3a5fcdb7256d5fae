"""Host resource samples: CSV with a banner, two header rows and numeric data rows.

The header of a file is found apart from its data: quoted lines that are no banner are the header
candidates, the first two in file order are column groups and column names. Data rows carry their
own clock, so they need no order at all and are joined to the header of their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.functions.once import evaluated
from runlens.functions.timestamps import dstat_epoch
from runlens.operators.extract.base import Extractor, context_columns, event_columns, register_extractor
from runlens.session import broadcast_if_small, cut_lineage

# Name of the clock column, file name and banner lines.
CLOCK = "epoch"
FILE_NAME = r"dstat-(\w+)-(.+)\.csv"
BANNER = (
    r'^(?:"Dstat ([0-9.]+) CSV output"|"Author:","(.+)",,,,"URL:","(.+)"'
    r'|"Host:","(.+)",,,,"User:","(.+)"|"Cmdline:","(.+)",,,,"Date:","(.+)")$'
)


def header_names(line: Column) -> Column:
    """Names of one header row; an empty one takes the nearest earlier name, leading empties go."""
    cells = F.split(F.when(F.trim(line).endswith(","), F.concat(line, F.lit('""'))).otherwise(line), ",")
    names = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), r"\W", "_"))

    def fill(acc: Column, name: Column) -> Column:
        filled = F.when(name == "", F.element_at(acc, -1)).otherwise(name)
        skip = (name == "") & (F.size(acc) == 0)
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(filled)))

    empty = F.array().cast("array<string>")
    return F.aggregate(names, empty, fill)


def column_names(groups: Column, columns: Column) -> Column:
    """``group:column``, or the group alone where both agree; cut to the shorter row."""
    n = F.least(F.size(groups), F.size(columns))
    pairs = F.arrays_zip(F.slice(groups, 1, n).alias("g"), F.slice(columns, 1, n).alias("c"))
    return F.transform(
        pairs, lambda p: F.when(p["g"] == p["c"], p["g"]).otherwise(F.concat(p["g"], F.lit(":"), p["c"]))
    )


def value_columns(names: Column) -> Column:
    """(c, i, again) of every column except the clock: name, index, index of its next namesake."""

    def entry(name: Column, i: Column) -> Column:
        later = F.array_position(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), name).cast("int")
        again = F.when(later > 0, i + later)
        return F.when(name != CLOCK, F.struct(name.alias("c"), i.alias("i"), again.alias("again")))

    return F.filter(F.transform(names, entry), lambda x: x.isNotNull())


def last_position(names: Column, name: str) -> Column:
    """1-based index of the last element that equals ``name``, 0 without one."""
    back = F.array_position(F.reverse(names), name).cast("int")
    return F.when(back > 0, F.size(names) - back + 1).otherwise(0)


def is_header_row(value: Column) -> Column:
    """Quoted lines that are no banner."""
    return value.startswith('"') & ~value.rlike(BANNER)


def is_sample(value: Column) -> Column:
    return (value != "") & ~value.startswith('"')


def parse_headers(rows: DataFrame) -> DataFrame:
    """(file, host, names, cols, clock_at) of (file, groups, columns), the two header rows of files."""
    split = evaluated(rows, g=header_names(F.col("groups")), c=header_names(F.col("columns")))
    named = evaluated(split, names=column_names(F.col("g"), F.col("c"))).where(F.size("names") > 0)
    host = F.regexp_extract(F.substring_index("file", "/", -1), f"(?:^|=){FILE_NAME}$", 2)
    return evaluated(named, cols=value_columns(F.col("names"))).select(
        "file", host.alias("host"), "names", "cols", last_position(F.col("names"), CLOCK).alias("clock_at")
    )


def headers(lines: DataFrame) -> DataFrame:
    """(file, host, names, cols, clock_at): one row per file that has both header rows.

    Keeping the first two rows of a ranking is done before the shuffle as well (group limit), so a
    file of quoted lines only does not end up in one task.
    """
    candidates = lines.where(is_header_row(F.col("value")))
    order = [c for c in ("part", "block", "record_key") if c in lines.columns]
    ranked = candidates.select(
        "file", "value",
        F.row_number().over(Window.partitionBy("file").orderBy(*order)).alias("n"),
    ).where(F.col("n") <= 2)
    rows = ranked.groupBy("file").agg(
        F.max(F.when(F.col("n") == 1, F.col("value"))).alias("groups"),
        F.max(F.when(F.col("n") == 2, F.col("value"))).alias("columns"),
    ).where(F.col("columns").isNotNull())
    return parse_headers(rows)


def extract_samples(lines: DataFrame) -> DataFrame:
    """One event per sample and column except the clock; on a repeated name the last column wins.

    Headers are looked up first, which runs a job; there is one per file, so they are broadcast unless
    there are very many files, and samples are not shuffled.
    """
    return sample_events(lines.where(is_sample(F.col("value"))), broadcast_if_small(cut_lineage(headers(lines))))


def sample_events(data: DataFrame, heads: DataFrame) -> DataFrame:
    """Events of samples by the header of their file; samples of a file without one are rejects.

    A row shorter than its header uses the columns it has. Names are looked at once per file; per
    row everything is plain arithmetic on indexes, which stays inside generated code.
    """
    keep = ["file", "record_key", *context_columns(data)]
    named = data.alias("d").join(heads.alias("h"), F.col("d.file") == F.col("h.file"), "left").select(*[F.col(f"d.{c}") for c in keep], "d.value", "h.names", "h.host", "h.cols", "h.clock_at")
    split = named.withColumn("cells", F.split("value", ",")).withColumn("n", F.size("cells"))
    whole = F.col("n") >= F.size("names")
    at = F.when(whole, F.col("clock_at")).otherwise(last_position(F.slice("names", F.lit(1), F.col("n")), CLOCK))
    placed = split.withColumn("clock_at", at)
    timed = placed.withColumn(
        "at", dstat_epoch(F.when(F.col("clock_at") > 0, F.try_element_at("cells", "clock_at")))
    )
    row_reason = (
        F.when(F.col("names").isNull(), "no header")
        .when(F.col("clock_at") == 0, "no epoch column")
        .when(F.col("at").isNull(), "bad epoch")
    )
    judged = timed.withColumn("row_reason", row_reason)
    none = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("again"))
    picked = F.when(F.col("row_reason").isNull(), F.col("cols")).otherwise(F.array(none))
    flat = evaluated(judged, picked=picked).select(
        *keep, "host", "at", "row_reason", "cells", "n", F.inline("picked")
    )
    # the last namesake that the row still has
    flat = flat.where((F.col("i") < F.col("n")) & (F.col("again").isNull() | (F.col("again") >= F.col("n"))))
    events = flat.select(
        *keep,
        F.lit("dstat").alias("extractor"),
        *event_columns(
            name=F.concat(F.lit("dstat_"), F.col("c")),
            host=F.col("host"),
            v_double=F.col("cells")[F.col("i")].try_cast("double"),
            v_timestamp=F.col("at"),
        ),
        "row_reason",
    )
    reason = F.coalesce("row_reason", F.when(F.col("v_double").isNull(), "not a number"))
    return evaluated(events, reject_reason=reason).drop("row_reason")


DSTAT = register_extractor(Extractor("dstat", "logs/dstat", (FILE_NAME,), "line", extract_samples))
