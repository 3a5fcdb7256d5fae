"""Run-time questions."""

from pyspark.sql import DataFrame, functions as F

from runlens.operators.aggregates import per_group_stats
from runlens.plans import adapters as a
from runlens.plans.analytics import run_query
from runlens.plans.catalog import query
from runlens.plans.queries import sql

_RUNS = f"WITH {sql.EXPERIMENT}, {sql.EXPERIMENT_RUN}"


@query(f"""{_RUNS}
SELECT e.suite AS suite, e.name AS name, min(r.time) AS min_time, max(r.time) AS max_time,
       CAST(sum(r.time) - min(r.time) - max(r.time) AS BIGINT) AS median_time
FROM experiment e, experiment_run r
WHERE e.id = r.experiment_id AND e.suite = 'BUILDING'
GROUP BY e.suite, e.name ORDER BY e.suite, e.name""")
def runtimes_for_suite(t: a.Tables) -> DataFrame:
    return run_query("runtimes_for_suite", a.relations(t), suite="BUILDING")


@query(f"""{_RUNS}
SELECT e.name AS name, e.suite AS suite,
       CAST(((2 * sum(r.time) + 10 * count(*)) // (20 * count(*))) / 100.0 AS DECIMAL(18,2)) AS average,
       median(r.time) / 1000.0 AS median, max(r.time) / 1000.0::DOUBLE AS max, min(r.time) / 1000.0::DOUBLE AS min,
       count(*) AS number_of_runs
FROM experiment e, experiment_run r WHERE e.id = r.experiment_id
GROUP BY e.suite, e.name ORDER BY e.name, e.suite""")
def runtime_summary(t: a.Tables) -> DataFrame:
    return run_query("runtime_summary", a.relations(t))


@query(f"""{_RUNS}
SELECT e.suite AS suite, e.name AS name, CAST(median(r.time) AS DOUBLE) AS median
FROM experiment e, experiment_run r WHERE e.id = r.experiment_id GROUP BY e.suite, e.name""")
def median_runtime(t: a.Tables) -> DataFrame:
    return run_query("median_runtime", a.relations(t))


@query(f"""{_RUNS}
SELECT e.name AS name, e.suite AS suite, r.time AS runtime, r.run AS run
FROM experiment e, experiment_run r WHERE e.id = r.experiment_id""")
def run_details(t: a.Tables) -> DataFrame:
    return run_query("run_details", a.relations(t))


@query("""SELECT CAST(user_id AS INTEGER) AS run, event_type AS task, count(*) AS emissions,
       avg(CAST(json_extract(props, '$.k') AS BIGINT)) AS avg_records
FROM events GROUP BY ALL""")
def emission_stats(t: a.Tables) -> DataFrame:
    events = a.experiment_event(t).select(F.col("experiment_run_id").alias("run"), F.col("name").alias("task"), "v_long")
    return per_group_stats(events, ["run", "task"], "v_long")
