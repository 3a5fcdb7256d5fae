"""Analyses over extracted events that the schema invites."""

from pyspark.sql import DataFrame, functions as F

from runlens.functions.timestamps import format_millis
from runlens.operators.aggregates import exact_median
from runlens.operators.extract import accepted
from runlens.operators.extract.dstat import extract_samples
from runlens.operators.extract.flink import extract_task_states
from runlens.operators.extract.spark_tasks import extract_task_ends
from runlens.operators.intervals import pair_attempts, within_intervals
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import cut_lineage, work_path
from runlens.streaming.windows import average, newest_totals, stream_totals

_MEASURES = """samples AS (SELECT event_type AS host, ts, %s AS at_ms, name, v FROM (
  SELECT event_type, ts, unnest(['dstat_total_cpu_usage:usr', 'dstat_total_cpu_usage:sys', 'dstat_memory_usage:used', 'dstat_memory_usage:buff']) AS name,
         unnest([value, CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS v FROM events))""" % sql.MILLIS
_MEAN = "CAST(sum(CAST(v AS DECIMAL(28,6))) AS DOUBLE) / count(*)"


def _samples(t: a.Tables) -> DataFrame:
    return accepted(extract_samples(a.dstat_lines(t))).select("host", "name", "v_double", "v_timestamp")


@query(f"""WITH {_MEASURES}, runs AS (
  SELECT user_id AS run, CAST(ts AS DATE) AS day, min({sql.MILLIS}) AS first, max({sql.MILLIS}) AS last
  FROM events WHERE event_id % 5 < 4 GROUP BY ALL)
SELECT CAST(run AS INTEGER) AS run, strftime(day, '%Y-%m-%d') AS day, host, name, count(*) AS n, {_MEAN} AS mean, max(v) AS top
FROM runs JOIN samples ON at_ms BETWEEN first AND last GROUP BY ALL""")
def derived_host_use(t: a.Tables) -> DataFrame:
    """Use of every host while a run went on: a run is what one user's tasks did on a day, from its first to its last event."""
    tasks = accepted(extract_task_states(a.flink_lines(t, a.flink_v1_line())))
    ms = F.unix_millis("v_timestamp")
    runs = tasks.groupBy(F.col("task_instance").alias("run"), F.date_format("v_timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.min(ms).alias("first"), F.max(ms).alias("last")
    )
    samples = cut_lineage(_samples(t).select("host", "name", "v_double", ms.alias("at")), "samples")
    used = within_intervals(samples, runs, ["host", "name"], "at", "v_double", "first", "last")
    return used.select("run", "day", "host", "name", "n", average().alias("mean"), F.col("high").alias("top"))


@query(f"""WITH moves AS (
  SELECT event_type AS task, user_id AS task_instance, event_id % 5 AS state, {sql.MILLIS} AS ms,
         row_number() OVER (PARTITION BY event_type, user_id, event_id % 5 ORDER BY {sql.MILLIS}, event_id) AS attempt
  FROM events WHERE event_id % 5 IN (2, 3))
SELECT task, CAST(task_instance AS INTEGER) AS task_instance, attempt, max(ms) FILTER (WHERE state = 2) AS started,
       max(ms) FILTER (WHERE state = 3) AS ended, max(ms) FILTER (WHERE state = 3) - max(ms) FILTER (WHERE state = 2) AS duration
FROM moves GROUP BY ALL""")
def derived_task_durations(t: a.Tables) -> DataFrame:
    """The kth start of a task with its kth end; what never ended, or was never seen to start, has no duration."""
    states = accepted(extract_task_states(a.flink_lines(t, a.flink_v1_line()))).select(
        "task", "task_instance", "name", "record_key", F.unix_millis("v_timestamp").alias("at")
    )
    pairs = pair_attempts(
        states, ["task", "task_instance"], "name", "state_change_running", "state_change_finished", ["at", "record_key"], "at"
    )
    return pairs.withColumn("duration", F.col("ended") - F.col("started"))


@query("""WITH ends AS (
  SELECT 'app-' || event_type AS file, 'stage-' || user_id || '#0' AS stage, CAST(round(value * 100) AS BIGINT) AS duration
  FROM events WHERE event_type NOT IN ('view', 'signup', 'error'))
SELECT file, stage, count(*) AS n_tasks, max(duration) AS longest, CAST(median(duration) AS DOUBLE) AS median,
       max(duration) / CAST(nullif(median(duration), 0) AS DOUBLE) AS skew
FROM ends GROUP BY ALL""")
def derived_stage_skew(t: a.Tables) -> DataFrame:
    """Longest against median duration of the tasks of each stage."""
    moves = accepted(extract_task_ends(a.spark_lines(t))).select(
        "file", F.col("task").alias("stage"), "task_instance", "name", "record_key", F.unix_millis("v_timestamp").alias("at")
    )
    groups = ["file", "stage", "task_instance"]
    pairs = pair_attempts(moves, groups, "name", "state_change_running", "state_change_finished", ["at", "record_key"], "at")
    timed = cut_lineage(pairs.withColumn("duration", F.col("ended") - F.col("started")).where("duration is not null"), "durations")
    ends = timed.groupBy("file", "stage").agg(F.count(F.lit(1)).alias("n_tasks"), F.max("duration").alias("longest"))
    skew = F.col("longest") / F.nullif(F.col("median"), F.lit(0.0))
    return ends.join(exact_median(timed, ["file", "stage"], "duration"), ["file", "stage"]).withColumn("skew", skew)


@query(f"""WITH {_MEASURES}
SELECT host, name, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S.%g') AS window_start, count(*) AS n, {_MEAN} AS mean,
       min(v) AS low, max(v) AS high
FROM samples GROUP BY ALL""")
def derived_resource_windows(t: a.Tables) -> DataFrame:
    """Averages of six hours, from a stream over the samples in several micro-batches."""
    folder, sink, state = (work_path(t.spark, x) for x in ("samples", "windows", "windows-state"))
    samples = _samples(t)
    samples.repartition(4, "host", "name").write.parquet(folder)
    stream = t.spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", "2").parquet(folder)
    groups = ["host", "name"]
    stream_totals(stream, groups, "v_timestamp", "v_double", "6 hours", "60 days", sink, state).awaitTermination()
    totals = newest_totals(t.spark.read.parquet(sink), groups)
    return totals.select(*groups, format_millis(F.col("window_start")).alias("window_start"), "n", average().alias("mean"), "low", "high")
