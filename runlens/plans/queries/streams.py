"""Streams over files that Spark derives from the tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.functions.timestamps import format_millis
from runlens.operators.extract import Extractor, accepted, registered
from runlens.operators.extract.base import event_id
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import work_path
from runlens.sources.files import number_lines, scan_lines, source_of
from runlens.sources.growing import growing_lines
from runlens.streaming.extract import line_stream, run_extraction
from runlens.streaming.samples import run_samples


def _drain(t: a.Tables, folder: str, extractor: Extractor, per_batch: bool, max_files: int | None = None) -> DataFrame:
    sink, checkpoint = work_path(t.spark, "stream-out"), work_path(t.spark, "stream-state")
    run_extraction(line_stream(t.spark, folder, max_files, marked=True), extractor, sink, checkpoint, per_batch).awaitTermination()
    return accepted(t.spark.read.parquet(sink))


@query(f"""SELECT 'state_change_' || lower({sql.STATE}) AS name, event_type AS task, CAST(user_id AS INTEGER) AS task_instance,
       {sql.CSV_TIME} AS at FROM events WHERE event_id % 5 < 4""")
def stream_extract(t: a.Tables) -> DataFrame:
    """Job-manager logs, one folder per event type, a few files per micro-batch."""
    lines = t.events.select("event_type", a.flink_v1_line().alias("value"))
    folder = a.stage_text(t, lines, "stream-in", by=["event_type"])
    events = _drain(t, folder, registered()["flink_tasks"], per_batch=False, max_files=4)
    return events.select("name", "task", "task_instance", format_millis(F.col("v_timestamp")).alias("at"))


@query(f"""SELECT name, event_type AS host, v AS v_double, at_ms FROM (
  SELECT event_type, {sql.MILLIS} AS at_ms,
         unnest(['dstat_total_cpu_usage:usr', 'dstat_total_cpu_usage:sys', 'dstat_memory_usage:used', 'dstat_memory_usage:buff']) AS name,
         unnest([value, CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS v
  FROM events)""")
def stream_extract_dstat(t: a.Tables) -> DataFrame:
    """Sample files, each with its own header."""
    lines = a.dstat_lines(t)
    header = lines.where(F.col("record_key") < 0).groupBy("file").agg(
        F.concat_ws("\n", F.max(F.when(F.col("record_key") == -2, F.col("value"))), F.max(F.when(F.col("record_key") == -1, F.col("value")))).alias("value")
    )
    data = lines.where(F.col("record_key") >= 0).select("file", "value")
    folder = a.stage_text(t, header.unionByName(data), "stream-in", by=["file"])
    events = _drain(t, folder, registered()["dstat"], per_batch=True)
    return events.select("name", "host", "v_double", F.unix_millis("v_timestamp").alias("at_ms"))


# Bytes of a file that one trigger takes at least in the queries below, and how many triggers the longest file is taken in then.
PIECE = 128 << 10
TRIGGERS = 8


def _piece_by_piece(t: a.Tables, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream over growing files again and again, from its checkpoint, until nothing is new.

    A trigger takes seconds, however little it reads; so longer files come in larger pieces, not in more triggers.
    """
    notes = work_path(t.spark, "line-notes")
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    piece = max(PIECE, (listed.agg(F.max("length")).first()[0] or 0) // TRIGGERS)
    while True:
        run = start(growing_lines(t.spark, folder, notes, split_bytes=piece // 4, splits_per_file=4))
        run.awaitTermination()
        if not sum(p["numInputRows"] for p in run.recentProgress):
            return


@query("""SELECT event_type AS kind, count(*) AS n, count(*) AS n_ids, count(*) AS n_in_batch
FROM events WHERE event_id % 5 < 4 GROUP BY event_type""")
def stream_appended_ids(t: a.Tables) -> DataFrame:
    """Event ids of a stream that takes files piece by piece, and how many of them a batch over the whole files gives."""
    extractor = registered()["flink_tasks"]
    folder = a.stage_text(t, t.events.select("event_type", a.flink_v1_line().alias("value")), "appended", by=["event_type"])
    sink, state = work_path(t.spark, "appended-out"), work_path(t.spark, "appended-state")
    _piece_by_piece(t, folder, lambda lines: run_extraction(lines, extractor, sink, state))
    kind = F.regexp_extract("file", "event_type=([^/]+)", 1).alias("kind")
    taken = accepted(t.spark.read.parquet(sink)).select(kind, event_id().alias("id")).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    lines = number_lines(scan_lines(t.spark, folder)).select("file", F.col("line_no").alias("record_key"), "value")
    batch = accepted(extractor.extract(lines)).select(event_id().alias("id")).distinct().withColumn("known", F.lit(1))
    return taken.join(batch, "id", "left").groupBy("kind").agg(
        F.sum("n").alias("n"), F.count("id").alias("n_ids"), F.count("known").alias("n_in_batch")
    )


@query(f"""SELECT name, event_type || '-' || (event_id // 20000) AS host, v AS v_double, at_ms FROM (
  SELECT event_type, event_id, {sql.MILLIS} AS at_ms,
         unnest(['dstat_total_cpu_usage:usr', 'dstat_total_cpu_usage:sys', 'dstat_memory_usage:used', 'dstat_memory_usage:buff']) AS name,
         unnest([value, CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS v
  FROM events)""")
def stream_dstat_batches(t: a.Tables) -> DataFrame:
    """Sample files that are taken piece by piece: only the first piece has the header. A file holds some thousand samples, one state each."""
    part = F.floor(F.col("event_id") / 20_000)
    file = F.concat(F.lit("dstat-user-"), F.col("event_type"), F.lit("-"), part.cast("string"), F.lit(".csv")).alias("file")
    samples = t.events.select(file, F.col("event_id").alias("at"), a.dstat_line().alias("value"))
    heads = [F.struct(F.lit(i - 2).cast("bigint").alias("at"), F.lit(h).alias("value")) for i, h in enumerate(a.DSTAT_HEADER)]
    headers = t.events.select(file).distinct().select("file", F.inline(F.array(*heads)))
    placed = headers.unionByName(samples).repartition("file").sortWithinPartitions("file", "at").select("file", "value")
    folder = a.stage_text(t, placed, "sample-files", by=["file"])
    sink, state = work_path(t.spark, "samples-out"), work_path(t.spark, "samples-state")
    whole = lambda lines: lines.withColumn("file", source_of(F.col("file"), True))
    _piece_by_piece(t, folder, lambda lines: run_samples(whole(lines), sink, state, salts=1))
    events = accepted(t.spark.read.parquet(sink))
    return events.select("name", "host", "v_double", F.unix_millis("v_timestamp").alias("at_ms"))
