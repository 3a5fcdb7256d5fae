"""The given tables seen as the relations and raw records of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.functions.timestamps import LOG_FORMAT
from runlens.session import prepare, spread, work_path
from runlens.sources.files import path_exists
from runlens.sources.states import write_run_states

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``tables.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# -- the four relations ----------------------------------------------------------------------


def system(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    version = F.concat(F.col("n_nationkey").cast("string"), F.lit(".0"))
    return joined.select(F.col("n_name").alias("id"), F.col("r_name").alias("name"), version.alias("version"))


def experiment(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("suite"),
        F.col("n_name").alias("system"),
    )


def experiment_run(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("experiment_id"),
        F.col("o_orderkey").alias("run"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("time"),
    )


def experiment_event(t: Tables) -> DataFrame:
    """One row per stream event; the run is the user."""
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("int").alias("experiment_run_id"),
        F.col("event_type").alias("name"),
        F.lit(None).cast("string").alias("host"),
        F.concat(F.lit("task, \""), F.col("event_type"), F.lit("\"")).alias("task"),
        F.when(F.col("event_type") != "view", F.col("user_id").cast("int")).alias("task_instance"),
        F.get_json_object("props", "$.k").cast("bigint").alias("v_long"),
        F.col("value").alias("v_double"),
        F.col("ts").cast("timestamp").alias("v_timestamp"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("v_string"),
    )


def relations(t: Tables) -> dict[str, DataFrame]:
    return {
        "system": system(t), "experiment": experiment(t), "experiment_run": experiment_run(t),
        "experiment_event": experiment_event(t),
    }


# -- raw lines -------------------------------------------------------------------------------

STATE_NAMES = ("SCHEDULED", "DEPLOYING", "RUNNING", "FINISHED", "FAILED")


def _state() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATE_NAMES]), (F.col("event_id") % 5 + 1).cast("int"))


def _lines(events: DataFrame, file: Column, value: Column, *context: Column) -> DataFrame:
    return events.select(file.alias("file"), F.col("event_id").alias("record_key"), value.alias("value"), *context)


def flink_v1_line() -> Column:
    return F.concat(
        F.date_format("ts", LOG_FORMAT), F.lit("\t"), F.col("event_type"), F.lit("("), F.col("user_id").cast("string"),
        F.lit("/200) switched to "), _state(), F.lit(" "),
    )


def flink_v2_line() -> Column:
    return F.concat(
        F.date_format("ts", LOG_FORMAT), F.lit(" INFO  graph.ExecutionGraph  - Map ("), F.col("event_type"),
        F.lit(") ("), F.col("user_id").cast("string"), F.lit("/200) ("), F.md5(F.col("event_id").cast("string")),
        F.lit(") switched from CREATED to "), _state(),
    )


def spark_json_line() -> Column:
    """A task end per event; sign-ups have no stage, errors failed, views are another event."""
    started = F.unix_millis(F.col("ts").cast("timestamp"))
    info = F.struct(
        (F.col("event_id") % 2_000_000_000).alias("Task ID"),
        (F.col("event_id") % 64).alias("Index"),
        F.lit(0).alias("Attempt"),
        F.lit("1").alias("Executor ID"),
        F.lit("node-1").alias("Host"),
        F.lit("ANY").alias("Locality"),
        F.lit(False).alias("Speculative"),
        started.alias("Launch Time"),
        (started + F.round(F.col("value") * 100).cast("bigint")).alias("Finish Time"),
        (F.col("event_type") == "error").alias("Failed"),
    )
    kind = F.when(F.col("event_type") == "view", "SparkListenerTaskStart").otherwise("SparkListenerTaskEnd")
    return F.to_json(F.struct(
        kind.alias("Event"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("Stage ID"),
        F.lit(0).alias("Stage Attempt ID"),
        info.alias("Task Info"),
    ))


DSTAT_BANNER = (
    '"Dstat 0.7.2 CSV output"\n"Author:","A B <a@b.c>",,,,"URL:","http://x.y/"\n'
    '"Host:","h",,,,"User:","u"\n"Cmdline:","dstat --epoch",,,,"Date:","31 May 2016"\n'
)
DSTAT_HEADER = ('"epoch","total cpu usage",,"memory usage",', '"epoch","usr","sys","used","buff"')


def dstat_line() -> Column:
    """Epoch with milliseconds, then four numbers."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    clock = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    cells = ["value", "user_id", "event_id"]
    return F.concat_ws(",", clock, *[F.col(c).cast("string") for c in cells], F.lit("0.5"))


def flink_lines(t: Tables, value: Column) -> DataFrame:
    return _lines(spread(t.events, "event_id"), F.concat(F.lit("jm-"), F.col("event_type")), value)


def spark_lines(t: Tables) -> DataFrame:
    return _lines(spread(t.events, "event_id"), F.concat(F.lit("app-"), F.col("event_type")), spark_json_line())


def dstat_lines(t: Tables) -> DataFrame:
    """One file per event type: both header rows, then its samples."""
    file = F.concat(F.lit("dstat-user-"), F.col("event_type"), F.lit(".csv"))
    files = t.events.select(file.alias("file")).distinct()
    rows = [F.struct(F.lit(i - 2).cast("bigint").alias("record_key"), F.lit(h).alias("value")) for i, h in enumerate(DSTAT_HEADER)]
    return files.select("file", F.inline(F.array(*rows))).unionByName(_lines(spread(t.events, "event_id"), file, dstat_line()))


def document_lines(t: Tables) -> DataFrame:
    """(doc_id, source, line_no, line): every line of every document, numbered from 1."""
    return spread(t.documents.select("doc_id", "source", "text"), "doc_id").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


# -- a tree of run folders --------------------------------------------------------------------

# Parallel writers per run folder: a folder that holds a third of the events is still spread.
WRITERS_PER_FOLDER = 16
# A writer sorts the lines of its events by folder, which are some hundred bytes each: so many events do not spill.
EVENTS_PER_WRITER = 100_000


def run_folders(t: Tables) -> DataFrame:
    """Events with the run folder they belong to: suite = event type, 4 experiments of 3 runs each.

    The last run of the last experiment has a name without run number.
    """
    ex, rn = F.col("user_id") % 4, F.floor(F.col("user_id") / 4) % 3 + 1
    name = F.when((ex == 3) & (rn == 3), "exp3.final").otherwise(
        F.concat(F.lit("exp"), ex.cast("string"), F.lit(".run0"), rn.cast("string"))
    )
    return t.events.select("*", F.col("event_type").alias("suite"), ex.alias("ex"), rn.alias("rn"), name.alias("name"))


def run_states(t: Tables) -> DataFrame:
    """State of each run folder, from its events."""
    ex, rn = F.col("ex"), F.col("rn")
    flink = ex % 2 == 0
    totals = run_folders(t).groupBy("suite", "name", "ex", "rn").agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("runTime")
    )
    return totals.select(
        "suite", "name",
        F.when(~((ex == 2) & (rn == 3)), F.concat(F.lit("job "), F.col("name"))).alias("command"),
        F.when(flink, "flink-1.0.3").otherwise("spark-1.6.0").alias("runnerID"),
        F.when(flink, "flink").otherwise("spark").alias("runnerName"),
        F.when(flink, "1.0.3").otherwise("1.6.0").alias("runnerVersion"),
        F.when((ex == 0) & (rn == 3), F.lit(None)).when((ex + rn) % 5 == 0, 1).otherwise(0).cast("int").alias("runExitCode"),
        "runTime",
    )


_TREES: dict[tuple[str, str], str] = {}


def results_tree(t: Tables) -> str:
    """Write run folders derived from the events below the shared folder; once per session and scale."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _TREES or not path_exists(t.spark, _TREES[key]):
        root = work_path(t.spark, "results")
        write_run_states(run_states(t), root)
        events = run_folders(t).withColumn("salt", F.col("event_id") % WRITERS_PER_FOLDER)
        writers = max(t.spark.sparkContext.defaultParallelism, -(-t.events.count() // EVENTS_PER_WRITER))
        spread = events.repartition(writers, "suite", "name", "salt")
        logs = {
            ("flink", "flink-u-jobmanager-h.log"): flink_v1_line(),
            ("spark", "app-1-1"): spark_json_line(),
            ("dstat", "dstat-u-node1.csv"): dstat_line(),
        }
        # one pass over the events writes all three logs
        kinds = [
            F.struct(F.lit(s).alias("system"), F.lit(f).alias("file"), v.alias("value")) for (s, f), v in logs.items()
        ]
        _write_log(spread.select("suite", "name", F.inline(F.array(*kinds))), root, "append")
        headers = run_folders(t).select("suite", "name").distinct().select(
            "suite", "name", F.lit("dstat").alias("system"), F.lit("dstat-u-node1.csv").alias("file"),
            F.lit(DSTAT_BANNER + "\n" + "\n".join(DSTAT_HEADER)).alias("value"),
        )
        _write_log(headers, root, "append")
        _TREES[key] = root
    return _TREES[key]


def _write_log(lines: DataFrame, root: str, mode: str) -> None:
    placed = lines.select("suite", "name", F.lit("logs").alias("sub"), "system", "file", "value")
    placed.write.mode(mode).partitionBy("suite", "name", "sub", "system", "file").text(root)


def stage_text(t: Tables, lines: DataFrame, label: str, by: Sequence[str] = (), compression: str = "none") -> str:
    """Write a ``value`` column as text files below the shared folder."""
    path = work_path(t.spark, label)
    writer = lines.write.option("compression", compression)
    (writer.partitionBy(*by) if by else writer).text(path)
    return path
