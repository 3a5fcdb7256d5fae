"""Experiment design: grids, tiers, plans, versions, names."""

from pyspark.sql import DataFrame, functions as F

from runlens.functions.identity import experiment_id, java_hash as hash_of, run_id
from runlens.functions.text import parse_run_name, substitute
from runlens.functions.versions import version_key, version_prefixes
from runlens.operators import design, ordering
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import spread


def _lists(t: a.Tables, *names: str) -> dict[str, DataFrame]:
    columns = {"region": (t.region, "r_name"), "segment": (t.customer, "c_mktsegment"), "priority": (t.orders, "o_orderpriority")}
    return {n: design.indexed_values(*columns[n]) for n in names or columns}


_LISTS = """regions AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT r_name AS v FROM region)),
segment AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)),
priority AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))"""


@query(f"WITH {_LISTS} SELECT i AS point, v AS priority FROM priority")
def grid_simple(t: a.Tables) -> DataFrame:
    return design.grid_simple(t.spark, "priority", design.indexed_values(t.orders, "o_orderpriority"))


@query(f"""WITH {_LISTS} SELECT r.i AS point, r.v AS region, s.v AS segment, p.v AS priority
FROM regions r JOIN segment s ON r.i = s.i JOIN priority p ON r.i = p.i""")
def grid_zipped(t: a.Tables) -> DataFrame:
    return design.grid_zipped(t.spark, _lists(t))


@query(f"""WITH {_LISTS} SELECT (r.i * (SELECT count(*) FROM segment) + s.i) * (SELECT count(*) FROM priority) + p.i AS point,
       r.v AS region, s.v AS segment, p.v AS priority
FROM regions r, segment s, priority p""")
def grid_crossed(t: a.Tables) -> DataFrame:
    return design.grid_crossed(t.spark, _lists(t))


@query(f"""WITH {_LISTS}
SELECT p_partkey, s.v AS segment, p.v AS priority,
       p_brand || '.' || s.v || '.' || p.v || CASE WHEN p_size % 10 = 0 THEN '.__host__' ELSE '' END AS experiment,
       p_size % 10 = 0 AS rejected
FROM part, segment s, priority p""")
def grid_experiments(t: a.Tables) -> DataFrame:
    """A template per part, some of which name an unknown parameter."""
    tail = F.when(F.col("p_size") % 10 == 0, ".__host__").otherwise("")
    prototypes = spread(t.part, "p_partkey").select("p_partkey", F.concat("p_brand", F.lit(".__segment__.__priority__"), tail).alias("template"))
    found = design.expand_flagged(prototypes, _lists(t, "segment", "priority"), "template")
    return found.select("p_partkey", "segment", "priority", "experiment", "rejected")


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer),
tiers AS (SELECT CAST(5 * pow(2, i) AS BIGINT) AS k FROM range(0, 40) t(i) WHERE 5 * pow(2, i) <= (SELECT count(*) FROM customer))
SELECT printf('top%03d', k) AS tier, count(*) AS hosts, CAST(sum(c_nationkey + 1) AS BIGINT) AS parallelism, CAST(sum(16) AS BIGINT) AS memory
FROM r JOIN tiers ON rank <= k GROUP BY k
UNION ALL SELECT 'all', count(*), CAST(sum(c_nationkey + 1) AS BIGINT), CAST(16 * count(*) AS BIGINT) FROM customer""")
def scaleout_tiers(t: a.Tables) -> DataFrame:
    hosts = t.customer.select("c_custkey", "c_nationkey")
    return design.scaleout_tiers(hosts, "c_custkey", 5, F.col("c_nationkey") + 1, F.lit(16).cast("bigint"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer),
tiers AS (SELECT CAST(5 * pow(2, i) AS BIGINT) AS k FROM range(0, 40) t(i) WHERE 5 * pow(2, i) <= (SELECT count(*) FROM customer))
SELECT printf('top%03d', k) AS tier, c_custkey, rank FROM r JOIN tiers ON rank <= k
UNION ALL SELECT 'all', c_custkey, rank FROM r""")
def tier_members(t: a.Tables) -> DataFrame:
    return design.tier_members(t.customer, "c_custkey", 5)


@query("""WITH wanted AS (SELECT c_custkey, CAST(unnest(range(1, c_nationkey % 4 + 1)) AS INTEGER) AS run FROM customer),
done AS (SELECT o_custkey, o_orderkey % 4 + 1 AS run FROM orders WHERE o_orderstatus = 'F')
SELECT w.c_custkey AS c_custkey, w.run AS run FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_custkey = w.c_custkey AND d.run = w.run)""")
def pending_runs(t: a.Tables) -> DataFrame:
    """None to three runs are planned per customer; filled orders are successful runs."""
    planned = t.customer.select("c_custkey", (F.col("c_nationkey") % 4).cast("int").alias("runs"))
    runs = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("run"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit"),
    )
    return design.pending_runs(planned, runs, ["c_custkey"])


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events)
WHERE prev IS DISTINCT FROM event_type""")
def collapse_consecutive(t: a.Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type")
    return ordering.collapse_consecutive(ordering.by_key(rows, "event_id"), "event_type", ["event_id"])


_VERSIONS = """v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 12) || CASE p_partkey % 5 WHEN 0 THEN '.1' ELSE '' END
  || CASE p_partkey % 3 WHEN 0 THEN '-SNAPSHOT' WHEN 1 THEN '-rc' || (p_partkey % 4) ELSE '' END AS version FROM part)"""


@query(f"""WITH {_VERSIONS}, parsed AS (
  SELECT *, list_transform(string_split(string_split(version, '-')[1], '.'), lambda x: CAST(x AS INTEGER)) AS numbers,
         CASE WHEN contains(version, '-') THEN '-' || lower(string_split(version, '-')[2]) ELSE '' END AS suffix FROM v)
SELECT p_partkey, version, array_to_string(list_transform(numbers, lambda x: CAST(x AS VARCHAR)), '.') AS longest_prefix,
       row_number() OVER (ORDER BY numbers, CASE suffix WHEN '-snapshot' THEN 0 WHEN '' THEN 2 ELSE 1 END, suffix, p_partkey) AS pos
FROM parsed""")
def version_sort(t: a.Tables) -> DataFrame:
    """Position of every version in the version order."""
    key = F.col("p_partkey")
    version = F.concat(
        F.col("p_size").cast("string"), F.lit("."), (key % 12).cast("string"),
        F.when(key % 5 == 0, ".1").otherwise(""),
        F.when(key % 3 == 0, "-SNAPSHOT").when(key % 3 == 1, F.concat(F.lit("-rc"), (key % 4).cast("string"))).otherwise(""),
    )
    rows = t.part.select("p_partkey", version.alias("version")).withColumn("key", version_key(F.col("version")))
    placed = ordering.position_within(ordering.by_range(rows, ["key", "p_partkey"]), [], ["key", "p_partkey"])
    return placed.select("p_partkey", "version", version_prefixes(F.col("version"))[0].alias("longest_prefix"), "pos")


@query(f"""SELECT c_custkey, {sql.java_hash("c_name")} AS name_hash, {sql.experiment_id("c_name", "c_mktsegment")} AS experiment_id,
       {sql.wrap32("CAST(" + sql.experiment_id("c_name", "c_mktsegment") + " AS BIGINT) * 31 + c_nationkey")} AS run_id FROM customer""")
def java_hash(t: a.Tables) -> DataFrame:
    exp = experiment_id(F.col("c_name"), F.col("c_mktsegment"))
    return t.customer.select(
        "c_custkey", hash_of(F.col("c_name")).alias("name_hash"), exp.alias("experiment_id"),
        run_id(exp, F.col("c_nationkey")).alias("run_id"),
    )


@query("""SELECT o_orderkey, concat('c', o_custkey, '.run', printf('%02d', o_orderkey % 120)) AS name,
       CASE WHEN o_orderkey % 120 < 100 THEN 'c' || o_custkey END AS experiment,
       CASE WHEN o_orderkey % 120 < 100 THEN CAST(o_orderkey % 120 AS INTEGER) END AS run FROM orders""")
def run_name_parse(t: a.Tables) -> DataFrame:
    """Names of three-digit runs do not parse."""
    name = F.format_string("c%d.run%02d", "o_custkey", F.col("o_orderkey") % 120)
    parsed = t.orders.select("o_orderkey", name.alias("name")).withColumn("p", parse_run_name(F.col("name")))
    return parsed.select("o_orderkey", "name", "p.experiment", "p.run")


@query("""SELECT c_custkey, 'job --in ' || c_mktsegment || '/' || c_name || ' --n ' || c_nationkey || ' --again ' || c_name || ' ${none}' AS command FROM customer""")
def substitute_template(t: a.Tables) -> DataFrame:
    template = F.lit("job --in ${seg}/__name__ --n __nation__ --again ${name} ${none}")
    values = {"seg": F.col("c_mktsegment"), "name": F.col("c_name"), "nation": F.col("c_nationkey")}
    return t.customer.select("c_custkey", substitute(template, values).alias("command"))
