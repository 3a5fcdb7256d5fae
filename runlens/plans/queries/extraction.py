"""Events out of log lines, and the import of run folders."""

from pyspark.sql import DataFrame, functions as F

from runlens.functions.timestamps import format_millis
from runlens.operators.extract import accepted, rejected
from runlens.operators.extract.dstat import extract_samples
from runlens.operators.extract.flink import extract_task_states
from runlens.operators.extract.spark_tasks import extract_task_ends
from runlens.operators.extract.table_functions import register_table_functions
from runlens.operators.ordering import by_key, forward_fill, position_within
from runlens.plans import adapters as a, etl
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import cut_lineage
from runlens.sources.files import scan_files
from runlens.sources.states import scan_run_states


def _at():
    return format_millis(F.col("v_timestamp")).alias("at")


@query(f"""SELECT 'jm-' || event_type AS file, 'state_change_' || lower({sql.STATE}) AS name, event_type AS task,
       CAST(user_id AS INTEGER) AS task_instance, {sql.CSV_TIME} AS at
FROM events WHERE event_id % 5 < 4""")
def extract_flink_v1(t: a.Tables) -> DataFrame:
    events = accepted(extract_task_states(a.flink_lines(t, a.flink_v1_line())))
    return events.select("file", "name", "task", "task_instance", _at())


@query(f"""SELECT 'jm-' || event_type AS file, 'state_change_' || lower({sql.STATE}) AS name,
       md5(CAST(event_id AS VARCHAR)) || ' (Map (' || event_type || '))' AS task,
       CAST(user_id AS INTEGER) AS task_instance, {sql.CSV_TIME} AS at
FROM events WHERE event_id % 5 < 4""")
def extract_flink_v2(t: a.Tables) -> DataFrame:
    events = accepted(extract_task_states(a.flink_lines(t, a.flink_v2_line())))
    return events.select("file", "name", "task", "task_instance", _at())


@query(f"""SELECT 'jm-' || event_type AS file, event_id AS record_key, 'state_change_' || lower({sql.STATE}) AS name,
       CASE WHEN event_id % 2 = 0 THEN event_type ELSE md5(CAST(event_id AS VARCHAR)) || ' (Map (' || event_type || '))' END AS task,
       CAST(user_id AS INTEGER) AS task_instance, {sql.CSV_TIME} AS at
FROM events WHERE event_id % 5 < 4""")
def extract_by_table_function(t: a.Tables) -> DataFrame:
    """Lines of both formats through the extractor's table function, in SQL."""
    register_table_functions(t.spark)
    value = F.when(F.col("event_id") % 2 == 0, a.flink_v1_line()).otherwise(a.flink_v2_line())
    a.flink_lines(t, value).createOrReplaceTempView("job_manager_lines")
    events = t.spark.sql("SELECT * FROM task_states(TABLE(job_manager_lines))")
    return accepted(events).select("file", "record_key", "name", "task", "task_instance", _at())


_TASKS = f"""SELECT 'app-' || event_type AS file, change AS name, 'stage-' || user_id || '#0' AS task,
       CAST(event_id % 2000000000 AS INTEGER) AS task_instance, event_id % 64 AS v_long,
       {sql.MILLIS} + CASE WHEN change = 'state_change_finished' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS at_ms
FROM events, (VALUES ('state_change_running'), ('state_change_finished')) AS c(change)
WHERE event_type NOT IN ('view', 'signup', 'error')"""


@query(_TASKS)
def extract_spark_tasks(t: a.Tables) -> DataFrame:
    events = accepted(extract_task_ends(a.spark_lines(t)))
    return events.select(
        "file", "name", "task", "task_instance", "v_long", F.unix_millis("v_timestamp").alias("at_ms")
    )


_SAMPLES = f"""SELECT 'dstat-user-' || event_type || '.csv' AS file, name, event_type AS host, v AS v_double, at_ms FROM (
  SELECT event_type, {sql.MILLIS} AS at_ms,
         unnest(['dstat_total_cpu_usage:usr', 'dstat_total_cpu_usage:sys', 'dstat_memory_usage:used', 'dstat_memory_usage:buff']) AS name,
         unnest([value, CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS v
  FROM events)"""


@query(_SAMPLES)
def extract_dstat(t: a.Tables) -> DataFrame:
    events = accepted(extract_samples(a.dstat_lines(t)))
    return events.select("file", "name", "host", "v_double", F.unix_millis("v_timestamp").alias("at_ms"))


@query(f"""SELECT event_type AS host, CAST(user_id AS DOUBLE) AS v_double, {sql.MILLIS} AS at_ms FROM events""")
def dstat_repeated_names(t: a.Tables) -> DataFrame:
    """Three columns of one name: the last one counts."""
    file = F.concat(F.lit("dstat-user-"), F.col("event_type"), F.lit(".csv"))
    heads = [F.struct(F.lit(i - 2).cast("bigint").alias("record_key"), F.lit(h).alias("value")) for i, h in enumerate(('"epoch","g",,', '"epoch","c","c","c"'))]
    headers = t.events.select(file.alias("file")).distinct().select("file", F.inline(F.array(*heads)))
    clock = F.regexp_extract(a.dstat_line(), "^[^,]+", 0)
    row = F.concat_ws(",", clock, F.lit("1"), F.lit("x"), F.col("user_id").cast("string"))
    rows = t.events.select(file.alias("file"), F.col("event_id").alias("record_key"), row.alias("value"))
    events = accepted(extract_samples(headers.unionByName(rows)))
    return events.select("host", "v_double", F.unix_millis("v_timestamp").alias("at_ms"))


@query("""SELECT file, record_key, reason FROM (
  SELECT 'app-' || event_type AS file, event_id AS record_key,
         CASE WHEN event_id % 3 = 0 THEN 'malformed json'
              WHEN event_id % 3 = 1 AND event_type NOT IN ('view', 'signup') THEN 'incomplete task info' END AS reason
  FROM events) WHERE reason IS NOT NULL""")
def extract_rejects(t: a.Tables) -> DataFrame:
    """A third of the lines cut short, a third without their task's index."""
    value = (
        F.when(F.col("event_id") % 3 == 0, F.left("value", F.lit(20)))
        .when(F.col("event_id") % 3 == 1, F.regexp_replace("value", r'"Index":\d+,', ""))
        .otherwise(F.col("value"))
    )
    lines = a.spark_lines(t).withColumn("event_id", F.col("record_key"))
    broken = lines.select("file", "record_key", value.alias("value"))
    return rejected(extract_task_ends(broken)).select("file", "record_key", F.col("reject_reason").alias("reason"))


@query("""SELECT p_partkey, header, name FROM (
  SELECT p_partkey, p_partkey // 8 AS header,
         last_value(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END IGNORE NULLS)
           OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS name
  FROM part) WHERE name IS NOT NULL""")
def header_ffill(t: a.Tables) -> DataFrame:
    """Headers of eight columns each, some without a name."""
    cells = t.part.select(
        "p_partkey", F.floor(F.col("p_partkey") / 8).alias("header"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("cell"),
    )
    return forward_fill(cells, ["header"], "p_partkey", "cell", "name").drop("cell")


@query("""SELECT event_type AS extractor, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq
FROM events""")
def event_sequence(t: a.Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("extractor"), "event_id")
    return position_within(by_key(rows, "event_id"), ["extractor"], ["event_id"], "seq").select(
        "extractor", "event_id", "seq"
    )


# -- run folders -------------------------------------------------------------------------------


@query(
    f"""WITH {sql.STATES}
SELECT suite, name, command, runner_id, runner_name, runner_version, exit_code, run_time FROM states""",
    name="scan_run_states",
)
def run_states(t: a.Tables) -> DataFrame:
    states, _ = scan_run_states(t.spark, a.results_tree(t))
    return states.select(
        "suite", "name", "command", F.col("runnerID").alias("runner_id"), F.col("runnerName").alias("runner_name"),
        F.col("runnerVersion").alias("runner_version"), F.col("runExitCode").alias("exit_code"),
        F.col("runTime").alias("run_time"),
    )


@query(f"""WITH {sql.FOLDERS}, files AS (SELECT unnest(['state.json', 'logs/flink/flink-u-jobmanager-h.log', 'logs/spark/app-1-1', 'logs/dstat/dstat-u-node1.csv']) AS f)
SELECT DISTINCT suite || '/' || name || '/' || f AS rel, list_extract(string_split(f, '/'), -1) AS file_name FROM folders, files""")
def scan_run_files(t: a.Tables) -> DataFrame:
    return scan_files(t.spark, a.results_tree(t)).select("rel", "file_name")


@query(f"WITH {sql.STATES} SELECT DISTINCT runner_id AS id, runner_name AS name, runner_version AS version FROM states")
def import_systems(t: a.Tables) -> DataFrame:
    states, _ = scan_run_states(t.spark, a.results_tree(t))
    return etl.systems_of(states).orderBy("id")


_NAMED = sql.STATES + ", named AS (SELECT *, 'exp' || ex AS experiment FROM states WHERE name LIKE '%.run__')"


@query(f"""WITH {_NAMED}
SELECT DISTINCT {sql.experiment_id("experiment", "suite")} AS id, experiment AS name, suite, runner_id AS system FROM named""")
def import_experiments(t: a.Tables) -> DataFrame:
    states, _ = scan_run_states(t.spark, a.results_tree(t))
    return etl.experiments_of(states).orderBy("name")


_RUN_ID = sql.wrap32(f"CAST({sql.experiment_id('experiment', 'suite')} AS BIGINT) * 31 + rn")


@query(f"""WITH {_NAMED}
SELECT {_RUN_ID} AS id, {sql.experiment_id("experiment", "suite")} AS experiment_id, CAST(rn AS INTEGER) AS run,
       coalesce(exit_code, CAST(-1 AS INTEGER)) AS exit, run_time AS time, suite, experiment, name AS run_name FROM named""")
def import_runs(t: a.Tables) -> DataFrame:
    states, _ = scan_run_states(t.spark, a.results_tree(t))
    return etl.runs_of(states)


@query(f"""WITH {sql.STATES}
SELECT suite, name, 'no command (kept)' AS reason FROM states WHERE command IS NULL
UNION ALL SELECT suite, name, 'no run number in name' FROM states WHERE name NOT LIKE '%.run__'""")
def import_rejects(t: a.Tables) -> DataFrame:
    return etl.read_suites(t.spark, a.results_tree(t)).rejects.select("suite", "name", "reason")


_GOOD = f"""{_NAMED}, keyed AS (SELECT suite, name, {_RUN_ID} AS experiment_run_id FROM named WHERE exit_code = 0),
good AS (SELECT f.event_id, f.event_type, f.user_id, f.value, f.ts, f.suite, k.experiment_run_id
         FROM folders f JOIN keyed k ON f.suite = k.suite AND f.name = k.name)"""

_ALL = f"""WITH {_GOOD}
SELECT suite, experiment_run_id, 'state_change_' || lower({sql.STATE}) AS name, NULL::VARCHAR AS host, event_type AS task,
       CAST(user_id AS INTEGER) AS task_instance, NULL::BIGINT AS v_long, NULL::DOUBLE AS v_double, {sql.MILLIS} AS at_ms
FROM good WHERE event_id % 5 < 4
UNION ALL
SELECT suite, experiment_run_id, change, NULL, 'stage-' || user_id || '#0', CAST(event_id % 2000000000 AS INTEGER), event_id % 64, NULL,
       {sql.MILLIS} + CASE WHEN change = 'state_change_finished' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END
FROM good, (VALUES ('state_change_running'), ('state_change_finished')) AS c(change)
WHERE event_type NOT IN ('view', 'signup', 'error')
UNION ALL
SELECT suite, experiment_run_id, name, 'node1', NULL, NULL, NULL, v, at_ms FROM (
  SELECT suite, experiment_run_id, {sql.MILLIS} AS at_ms,
         unnest(['dstat_total_cpu_usage:usr', 'dstat_total_cpu_usage:sys', 'dstat_memory_usage:used', 'dstat_memory_usage:buff']) AS name,
         unnest([value, CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS v
  FROM good)"""


def _imported_events(t: a.Tables) -> DataFrame:
    events = etl.read_suites(t.spark, a.results_tree(t)).events
    return events.select(
        "suite", "experiment_run_id", "name", "host", "task", "task_instance", "v_long", "v_double",
        F.unix_millis("v_timestamp").alias("at_ms"),
    )


@query(_ALL)
def all_events(t: a.Tables) -> DataFrame:
    return _imported_events(t)


@query(f"SELECT suite, count(*) AS n, count(*) AS n_ids, count(*) AS n_again FROM ({_ALL}) GROUP BY suite")
def import_event_ids(t: a.Tables) -> DataFrame:
    """Events, different ids, and ids that a second import with other splits gives again."""
    setting = "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(setting)
    first = cut_lineage(etl.read_suites(t.spark, a.results_tree(t)).events.select("suite", "id"))
    try:
        t.spark.conf.set(setting, "64k")
        second = cut_lineage(etl.read_suites(t.spark, a.results_tree(t)).events.select("suite", "id"))
    finally:
        t.spark.conf.set(setting, before)
    both = first.groupBy("suite", "id").count().join(second.distinct().withColumn("again", F.lit(1)), ["suite", "id"], "left")
    return both.groupBy("suite").agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_ids"), F.count("again").alias("n_again")
    )


@query(f"SELECT suite, experiment_run_id, count(*) AS n FROM ({_ALL}) GROUP BY ALL")
def successful_run_events(t: a.Tables) -> DataFrame:
    return _imported_events(t).groupBy("suite", "experiment_run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT suite, CASE WHEN name LIKE 'dstat%' THEN 'dstat' WHEN task LIKE 'stage-%' THEN 'spark_tasks' ELSE 'flink_tasks' END AS extractor,
       count(*) AS n FROM ({_ALL}) GROUP BY ALL""")
def extract_counts(t: a.Tables) -> DataFrame:
    root = a.results_tree(t)
    states, _ = scan_run_states(t.spark, root)
    return etl.extract_counts(t.spark, root, etl.runs_of(states))
