"""From run folders to the four relations."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.functions.identity import experiment_id, run_id
from runlens.functions.text import parse_run_name
from runlens.operators.extract import Extractor, accepted, registered, rejected, route_files, to_event_rows
from runlens.operators.extract.base import ATTRIBUTES
from runlens.session import broadcast_if_small, cut_lineage
from runlens.sources.files import (
    decode_path, hidden_names, is_marked_tree, literal_path, path_exists, scan_files, scan_lines, split_positions,
    suite_folders, with_line_numbers,
)
from runlens.sources.hidden import has_hidden_name, readable, scan_hidden_lines
from runlens.sources.states import scan_run_states
from runlens.sources.store import ResultsStore


@dataclass(frozen=True)
class Import:
    systems: DataFrame
    experiments: DataFrame
    runs: DataFrame
    events: DataFrame
    rejects: DataFrame


def systems_of(states: DataFrame) -> DataFrame:
    return states.select(
        F.col("runnerID").alias("id"), F.col("runnerName").alias("name"), F.col("runnerVersion").alias("version")
    ).distinct()


def named_states(states: DataFrame) -> DataFrame:
    """States with their parsed run name; null where the name has no run number."""
    return states.withColumn("run_name", parse_run_name(F.col("name")))


def experiments_of(states: DataFrame) -> DataFrame:
    """Distinct experiments of the states with a proper run name.

    An experiment whose runs name different runners would get two rows with one id; it keeps the
    first runner, and ``conflicting_experiments`` lists it.
    """
    named = named_states(states).where(F.col("run_name").isNotNull())
    name = F.col("run_name.experiment")
    one = named.groupBy(name.alias("name"), "suite").agg(F.min("runnerID").alias("system"))
    return one.select(experiment_id(F.col("name"), F.col("suite")).alias("id"), "name", "suite", "system")


def conflicting_experiments(states: DataFrame) -> DataFrame:
    named = named_states(states).where(F.col("run_name").isNotNull())
    counts = named.groupBy("suite", F.col("run_name.experiment").alias("name")).agg(
        F.min("runnerID").alias("__a"), F.max("runnerID").alias("__z")
    )
    return counts.where(F.col("__a") != F.col("__z")).select("suite", "name")


def runs_of(states: DataFrame) -> DataFrame:
    """Runs with their natural key (suite, experiment, run) next to the stored columns.

    Ids follow from the names, so no lookup is needed; a missing exit code is -1.
    """
    named = named_states(states).where(F.col("run_name").isNotNull())
    exp = experiment_id(F.col("run_name.experiment"), F.col("suite"))
    return named.select(
        run_id(exp, F.col("run_name.run")).alias("id"),
        exp.alias("experiment_id"),
        F.col("run_name.run").alias("run"),
        F.coalesce("runExitCode", F.lit(-1)).alias("exit"),
        F.col("runTime").alias("time"),
        "suite",
        F.col("run_name.experiment").alias("experiment"),
        F.col("name").alias("run_name"),
    )


def files_of_successful_runs(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files (rel = suite/run/...) of the runs that ended with exit code 0, rel cut to the run folder.

    A key join on (suite, run name): a state whose name does not parse shifts nothing.
    """
    parts = F.split("rel", "/")
    located = files.select(
        "source",
        "path",
        "bytes",
        parts[0].alias("suite"),
        F.try_element_at(parts, F.lit(2)).alias("run_name"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("rel"),
        "file_name",
    )
    good = runs.where(F.col("exit") == 0).select("suite", "run_name", F.col("id").alias("experiment_run_id"))
    return located.join(good, ["suite", "run_name"])


def extract_routed(
    spark: SparkSession, root: str, routed: DataFrame, extractors: dict[str, Extractor], marked: bool
) -> DataFrame | None:
    """Events and rejects of all routed files, with suite and run of their file; None without files.

    ``record_key`` is the line number in the file, whatever the splits, so ids made of it stay the same.

    The routed list steers which paths are opened at all, as Spark's own file listing would. Each
    extractor scans its files once, and a file's run is looked up after extraction, when few rows
    are left. Files with hidden names do not go through Spark's reader.
    """
    paths: dict[str, list[str]] = {}
    unseen: set[str] = set()
    hidden = has_hidden_name(F.col("source")) & F.lit(not marked)
    wanted = routed.select("extractor", F.when(~hidden, literal_path(decode_path(F.col("source")))).alias("p")).distinct()
    for row in wanted.toLocalIterator():
        if row["p"] is None:
            unseen.add(row["extractor"])
        else:
            paths.setdefault(row["extractor"], []).append(row["p"])
    if not paths and not unseen:
        return None
    scans = {n: scan_lines(spark, sorted(p), marked) for n, p in sorted(paths.items())}
    for n in sorted(unseen):
        files = routed.where(hidden & (F.col("extractor") == n)).select("source", "bytes")
        lines = scan_hidden_lines(files.distinct(), root)
        scans[n] = scans[n].unionByName(lines) if n in scans else lines
    rows = functools.reduce(DataFrame.unionByName, [extractors[n].extract(lines) for n, lines in scans.items()])
    splits = [split_positions(lines).withColumn("extractor", F.lit(n)) for n, lines in scans.items()]
    positions = broadcast_if_small(cut_lineage(functools.reduce(DataFrame.unionByName, splits)))
    numbered = with_line_numbers(rows, positions, "extractor")
    rows = numbered.withColumn("record_key", F.col("line_no")).drop("line_no", "part", "block")
    context = routed.select(F.col("source").alias("file"), "extractor", "suite", "run_name", "experiment_run_id")
    return rows.join(broadcast_if_small(context), ["file", "extractor"])


def routed_files(
    spark: SparkSession, root: str, runs: DataFrame, extractors: dict[str, Extractor],
    suites: Sequence[str] | None = None,
) -> DataFrame:
    """Files of successful runs with the extractors that want them; a small table, written once."""
    files = files_of_successful_runs(scan_files(spark, root, suites), runs)
    return cut_lineage(route_files(files, extractors.values()))


def extract_counts(
    spark: SparkSession, root: str, runs: DataFrame, extractors: dict[str, Extractor] | None = None
) -> DataFrame:
    """Number of events per suite and extractor."""
    extractors = extractors or registered()
    extracted = extract_routed(spark, root, routed_files(spark, root, runs, extractors), extractors, is_marked_tree(spark, root))
    if extracted is None:
        return spark.createDataFrame([], "suite string, extractor string, n bigint")
    return accepted(extracted).groupBy("suite", "extractor").agg(F.count(F.lit(1)).alias("n"))


def read_suites(
    spark: SparkSession, root: str, suites: Sequence[str] | None = None,
    extractors: dict[str, Extractor] | None = None,
) -> Import:
    """All relations of the run folders ``<root>/<suite>/<experiment>.runNN``, of all or some suites.

    Log lines are scanned once: the extraction is written and feeds both events and rejects.
    """
    extractors = extractors or registered()
    for suite in suites or ():
        if not path_exists(spark, suite_folders(root, [suite])):
            raise ValueError(f"no folder of suite {suite!r} below {root!r}")
    states, state_rejects = scan_run_states(spark, root, suites)
    states = cut_lineage(states)
    runs = runs_of(states)
    routed = routed_files(spark, root, runs, extractors, suites)
    unnamed = named_states(states).where(F.col("run_name").isNull())
    clashes = conflicting_experiments(states).select(
        F.lit(None).cast("string").alias("file"), "suite", "name", F.lit("several runners").alias("reason")
    )
    rejects = state_rejects.unionByName(
        unnamed.select("file", "suite", "name", F.lit("no run number in name").alias("reason"))
    ).unionByName(clashes)
    marked = is_marked_tree(spark, root)
    if not marked and not readable(spark, root) and (hidden := hidden_names(spark, root, suites)):
        below_root = [(p, *_suite_and_run(p, root), "hidden name, not read") for p in hidden]
        rejects = rejects.unionByName(spark.createDataFrame(below_root, "file string, suite string, name string, reason string"))
    extracted = extract_routed(spark, root, routed, extractors, marked)
    if extracted is None:
        columns = [*[f"{n} {t}" for n, t in ATTRIBUTES.items()]]
        schema = "id bigint, experiment_run_id int, " + ", ".join(columns) + ", suite string"
        events = spark.createDataFrame([], schema)
    else:
        extracted = cut_lineage(extracted, "extracted")
        events = to_event_rows(accepted(extracted), F.col("experiment_run_id"), "suite")
        rejects = rejects.unionByName(
            rejected(extracted).select("file", "suite", F.col("run_name").alias("name"), F.col("reject_reason").alias("reason"))
        )
    return Import(systems_of(states), experiments_of(states), runs, events, rejects)


def _suite_and_run(path: str, root: str) -> tuple[str | None, str | None]:
    tail = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    parts = path.split(tail + "/", 1)[-1].split("/")
    return parts[0], parts[1] if len(parts) > 1 else None


def import_suites(
    spark: SparkSession, root: str, store: ResultsStore, suites: Sequence[str] | None = None
) -> Import:
    """Read run folders and refresh their suites in the store."""
    found = read_suites(spark, root, suites)
    store.create()
    store.refresh_suites(found.systems, found.experiments, found.runs, found.events)
    return found
