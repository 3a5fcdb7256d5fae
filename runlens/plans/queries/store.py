"""Keeping the results store."""

from pyspark.sql import DataFrame, functions as F

from runlens.functions.timestamps import format_millis
from runlens.operators import relational as rel
from runlens.operators.extract.base import clamp
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import work_path
from runlens.sources.datasets import copy_dataset as copy, ensure_dataset as ensure
from runlens.sources.event_csv import read_event_csv, write_event_csv
from runlens.sources.states import scan_run_states, write_run_states
from runlens.sources.store import ResultsStore, stored_schema

_EVENTS = f"""SELECT event_id AS id, CAST(user_id AS INTEGER) AS experiment_run_id, event_type AS name,
       'task, "' || event_type || '"' AS task,
       CASE WHEN event_type <> 'view' THEN CAST(user_id AS INTEGER) END AS task_instance,
       CAST(json_extract(props, '$.k') AS BIGINT) AS v_long, value AS v_double, {sql.CSV_TIME} AS at,
       CASE WHEN event_type <> 'click' THEN props END AS v_string
FROM events"""


@query(_EVENTS)
def events_csv_roundtrip(t: a.Tables) -> DataFrame:
    path = work_path(t.spark, "events-csv")
    write_event_csv(a.experiment_event(t), path)
    back = read_event_csv(t.spark, path)
    return back.withColumn("at", format_millis(F.col("v_timestamp"))).drop("v_timestamp", "host")


@query("""SELECT c_mktsegment AS suite, n_name || '.run01' AS name, count(*) AS run_time
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def states_json_roundtrip(t: a.Tables) -> DataFrame:
    """One run folder per segment and nation, written and scanned."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("runTime"))
    states = counts.select(
        F.col("c_mktsegment").alias("suite"), F.concat("n_name", F.lit(".run01")).alias("name"),
        F.lit("count").alias("command"), F.lit("spark-4").alias("runnerID"), F.lit("spark").alias("runnerName"),
        F.lit("4").alias("runnerVersion"), F.lit(0).alias("runExitCode"), "runTime",
    )
    root = work_path(t.spark, "states")
    write_run_states(states, root)
    found, _ = scan_run_states(t.spark, root)
    return found.select("suite", "name", F.col("runTime").alias("run_time"))


def _stored(t: a.Tables) -> ResultsStore:
    """A store filled from the tables; runs go to the suite of their experiment."""
    store = ResultsStore(t.spark, work_path(t.spark, "store"))
    store.create()
    experiments = a.experiment(t)
    store.append("system", a.system(t))
    store.append("experiment", experiments)
    suites = experiments.select(F.col("id").alias("experiment_id"), "suite")
    runs = a.experiment_run(t).join(suites, "experiment_id")
    store.append("experiment_run", runs)
    store.append("experiment_event", _end_events(runs))
    return store


def _end_events(runs: DataFrame) -> DataFrame:
    """One event per run: when it ended."""
    values = {
        "id": F.col("id"), "experiment_run_id": F.col("id"), "name": F.lit("run_end"), "v_long": F.col("time"), "suite": F.col("suite"),
    }
    return runs.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stored_schema("experiment_event").fields
    ])


@query(f"WITH {sql.EXPERIMENT} SELECT CAST(id AS INTEGER) AS id, name, suite, system FROM experiment")
def scan_store(t: a.Tables) -> DataFrame:
    return _stored(t).read("experiment")


@query(f"""WITH {sql.EXPERIMENT_RUN} SELECT id, experiment_id, run, exit, time FROM experiment_run
UNION ALL SELECT id + 1000000000, experiment_id, run, exit, time + 1 FROM experiment_run""")
def store_append(t: a.Tables) -> DataFrame:
    """Checked insert of as many rows again under new ids, read back from the store."""
    store = _stored(t)
    more = store.read("experiment_run").withColumns({"id": F.col("id") + 1_000_000_000, "time": F.col("time") + 1})
    store.insert("experiment_run", more)
    as_before = a.experiment_run(t).dtypes
    return store.read("experiment_run").select(*[F.col(c).cast(kind) for c, kind in as_before])


@query("""SELECT doc_id AS id, left(text, 127) AS host, left(text, 1024) AS task, left(text, 1024) AS v_string FROM documents""")
def clamp_strings(t: a.Tables) -> DataFrame:
    wide = t.documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("host"), F.col("text").alias("task"), F.col("text").alias("v_string")
    )
    return clamp(wide)


@query(f"WITH {sql.EXPERIMENT} SELECT id, name, suite, system FROM experiment UNION SELECT id, name, suite, 'other' FROM experiment WHERE id % 2 = 1")
def insert_missing(t: a.Tables) -> DataFrame:
    """Half of the offered rows differ from what is stored, the others are there already."""
    current = a.experiment(t)
    offered = current.withColumn("system", F.when(F.col("id") % 2 == 1, "other").otherwise(F.col("system")))
    return rel.insert_missing(current, offered)


@query(f"""WITH {sql.EXPERIMENT_RUN}
SELECT id, experiment_id, run, CASE WHEN exit = 1 THEN CAST(255 AS INTEGER) ELSE exit END AS exit,
       CASE WHEN exit = 1 THEN 42 ELSE time END AS time FROM experiment_run""")
def update_by_key(t: a.Tables) -> DataFrame:
    runs = a.experiment_run(t)
    changed = runs.where(F.col("exit") == 1).withColumns({"exit": F.lit(255), "time": F.lit(42).cast("bigint")})
    return rel.update_by_key(runs, changed)


@query(f"WITH {sql.EXPERIMENT_RUN} SELECT id, experiment_id, run, exit, time FROM experiment_run WHERE exit = 0")
def delete_by_key(t: a.Tables) -> DataFrame:
    runs = a.experiment_run(t)
    return rel.delete_by_key(runs, runs.where(F.col("exit") != 0))


@query(f"""WITH {sql.EXPERIMENT}, {sql.EXPERIMENT_RUN}, alive AS (SELECT id FROM experiment WHERE suite <> 'BUILDING'),
runs AS (SELECT id FROM experiment_run WHERE experiment_id NOT IN (SELECT id FROM experiment WHERE suite = 'BUILDING'))
SELECT 'experiment' AS relation, id, count(*) AS n FROM alive GROUP BY id
UNION ALL SELECT 'experiment_run', id, count(*) FROM runs GROUP BY id
UNION ALL SELECT 'experiment_event', l_orderkey, count(*) FROM lineitem
WHERE l_orderkey NOT IN (SELECT id FROM experiment_run WHERE experiment_id IN (SELECT id FROM experiment WHERE suite = 'BUILDING')) GROUP BY l_orderkey""")
def delete_cascade(t: a.Tables) -> DataFrame:
    """Line items stand for events of the run that is their order."""
    experiments, runs = a.experiment(t), a.experiment_run(t)
    events = t.lineitem.select(F.col("l_orderkey").alias("experiment_run_id"))
    victims = experiments.where(F.col("suite") == "BUILDING").select("id")
    left = rel.cascade(experiments, runs, events, victims)
    keys = ("id", "id", "experiment_run_id")
    names = ("experiment", "experiment_run", "experiment_event")
    parts = [
        df.groupBy(F.col(k).alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("relation"), "id", "n")
        for df, k, n in zip(left, keys, names)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {sql.EXPERIMENT} SELECT system AS id, count(*) AS n_children FROM experiment GROUP BY system")
def restrict_violations(t: a.Tables) -> DataFrame:
    return rel.restrict_violations(a.system(t), a.experiment(t), "id", "system")


@query(f"""WITH {sql.EXPERIMENT}, {sql.EXPERIMENT_RUN}
SELECT CAST(r.id AS INTEGER) AS id, CAST(r.experiment_id AS INTEGER) AS experiment_id, CAST(r.run AS INTEGER) AS run, r.exit AS exit,
       CASE WHEN e.suite IN ('BUILDING', 'MACHINERY') THEN r.time + 1 ELSE r.time END AS time, e.suite AS suite
FROM experiment_run r JOIN experiment e ON r.experiment_id = e.id
WHERE NOT (e.suite IN ('BUILDING', 'MACHINERY') AND r.exit = 1)""")
def suite_refresh(t: a.Tables) -> DataFrame:
    """Two suites come in again, without their failed runs and with other times; twice."""
    return _refreshed(t).read("experiment_run")


@query(f"""WITH {sql.EXPERIMENT}, {sql.EXPERIMENT_RUN}
SELECT r.id AS id, CAST(r.id AS INTEGER) AS experiment_run_id, 'run_end' AS name,
       CASE WHEN e.suite IN ('BUILDING', 'MACHINERY') THEN r.time + 1 ELSE r.time END AS v_long, e.suite AS suite
FROM experiment_run r JOIN experiment e ON r.experiment_id = e.id
WHERE NOT (e.suite IN ('BUILDING', 'MACHINERY') AND r.exit = 1)""")
def suite_refresh_events(t: a.Tables) -> DataFrame:
    """What the same refresh leaves of the events: those of the runs that went are gone as well."""
    return _refreshed(t).read("experiment_event").select("id", "experiment_run_id", "name", "v_long", "suite")


def _refreshed(t: a.Tables) -> ResultsStore:
    store = _stored(t)
    experiments = a.experiment(t).where(F.col("suite").isin("BUILDING", "MACHINERY"))
    suites = experiments.select(F.col("id").alias("experiment_id"), "suite")
    runs = a.experiment_run(t).where(F.col("exit") == 0).withColumn("time", F.col("time") + 1).join(suites, "experiment_id")
    for _ in range(2):
        store.refresh_suites(a.system(t), experiments, runs, _end_events(runs))
    return store


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def check_unique(t: a.Tables) -> DataFrame:
    return rel.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY user_id""")
def check_fk(t: a.Tables) -> DataFrame:
    """Events whose user has no label."""
    return rel.orphans(t.events, t.labels, "user_id", "doc_id")


@query("""SELECT 'quality' AS "column", count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL
UNION ALL SELECT 'toxic', count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL""")
def check_not_null(t: a.Tables) -> DataFrame:
    return rel.null_violations(t.documents.join(t.labels, "doc_id", "left"), ["doc_id", "quality", "toxic"])


@query("SELECT p_partkey, p_name FROM part")
def ensure_dataset(t: a.Tables) -> DataFrame:
    """Generated at the first call, read as it is at the second."""
    path = work_path(t.spark, "dataset")
    ensure(t.spark, path, lambda _: t.part.select("p_partkey", "p_name"))
    return ensure(t.spark, path, lambda _: t.part.select("p_partkey", "p_name").limit(0))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def copy_dataset(t: a.Tables) -> DataFrame:
    """Parquet to JSON lines."""
    path = work_path(t.spark, "copy")
    schema = "s_suppkey bigint, s_name string, s_acctbal double"
    return copy(t.spark, f"{t.folder}/supplier.parquet", path, "parquet", "json", schema)
