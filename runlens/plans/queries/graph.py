"""The order book as a dependency graph: region -> nation -> customer -> order."""

from pyspark.sql import DataFrame, functions as F

from runlens.operators import graph
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.session import spread


def _edge(df: DataFrame, src: str, src_key: str, dst: str, dst_key: str) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{src}:"), F.col(src_key).cast("string")).alias("src"),
        F.concat(F.lit(f"{dst}:"), F.col(dst_key).cast("string")).alias("dst"),
    )


def edges(t: a.Tables) -> DataFrame:
    return (
        _edge(t.nation, "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(_edge(t.customer, "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(_edge(t.orders, "c", "o_custkey", "o", "o_orderkey"))
    )


def _vertex(t: a.Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in names], "v string")


@query(f"WITH {sql.EDGES} SELECT src, dst, count(*) OVER (PARTITION BY src) AS out_degree FROM (SELECT DISTINCT src, dst FROM edges)")
def graph_adjacency(t: a.Tables) -> DataFrame:
    return graph.adjacency(edges(t).unionByName(edges(t)))


@query(f"""WITH {sql.EDGES} SELECT DISTINCT 'n:' || (c_custkey % 25) AS src, 'c:' || c_custkey AS dst FROM customer
WHERE c_custkey % 25 = c_nationkey""")
def graph_has_edge(t: a.Tables) -> DataFrame:
    """Is each customer in the nation its number would suggest?"""
    asked = t.customer.withColumn("guess", F.col("c_custkey") % 25)
    return graph.has_edge(edges(t), _edge(asked, "n", "guess", "c", "c_custkey"))


@query(f"WITH {sql.EDGES} SELECT DISTINCT dst AS src, src AS dst FROM edges")
def graph_reverse(t: a.Tables) -> DataFrame:
    return graph.reverse(*graph.build(edges(t)))[1]


@query(f"WITH {sql.EDGES} SELECT DISTINCT src AS v FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def graph_roots(t: a.Tables) -> DataFrame:
    return graph.roots(*graph.build(edges(t)))


_REACH = """{name}(v, depth) AS (
  SELECT '{start}', 0 UNION SELECT e.dst, r.depth + 1 FROM {name} r JOIN edges e ON e.src = r.v WHERE {cond})"""


@query(f"""WITH RECURSIVE {sql.EDGES}, {_REACH.format(name="reach", start="r:1", cond="e.dst <> 'n:2'")}
SELECT v, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY v""")
def graph_descendants(t: a.Tables) -> DataFrame:
    """Everything below one region, except through one nation."""
    return graph.descendants(edges(t), _vertex(t, "r:1"), _vertex(t, "n:2"))


@query(f"""WITH RECURSIVE {sql.EDGES}, reach(v, depth) AS (
  SELECT v, 0 FROM (SELECT DISTINCT src AS v FROM edges WHERE src NOT IN (SELECT dst FROM edges))
  UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.v)
SELECT v, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY v""")
def graph_traverse(t: a.Tables) -> DataFrame:
    return graph.traverse(*graph.build(edges(t)))


@query(f"""WITH RECURSIVE {sql.EDGES}, {_REACH.format(name="inp", start="n:1", cond="true")},
{_REACH.format(name="direct", start="r:1", cond="e.dst <> 'n:1'")}
SELECT DISTINCT v, true AS via_input FROM inp UNION ALL SELECT DISTINCT v, false FROM direct""")
def graph_reach_diff(t: a.Tables) -> DataFrame:
    """A region whose one nation counts as input."""
    return graph.reach_split(edges(t), _vertex(t, "r:1"), _vertex(t, "n:1"))


@query("""WITH x AS (SELECT c_mktsegment AS s, c_name AS e, 'nation-' || c_nationkey AS n, 'in-' || (c_custkey % 7) AS i, 'out-' || c_custkey AS o FROM customer)
SELECT s AS src, e AS dst FROM x UNION SELECT e, n FROM x UNION SELECT e, 'sampler' FROM x UNION SELECT e, i FROM x
UNION SELECT i, 'files' FROM x UNION SELECT e, o FROM x UNION SELECT o, 'files' FROM x""")
def graph_from_records(t: a.Tables) -> DataFrame:
    """A suite per market segment, an experiment per customer."""
    key = F.col("c_custkey").cast("string")
    read = F.struct(
        F.concat(F.lit("in-"), (F.col("c_custkey") % 7).cast("string")).alias("name"), F.array(F.lit("files")).alias("dependencies")
    )
    write = F.struct(F.concat(F.lit("out-"), key).alias("name"), F.lit("files").alias("fs"))
    records = spread(t.customer, "c_custkey").select(
        F.col("c_mktsegment").alias("suite"), F.col("c_name").alias("experiment"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("runner"),
        F.array(F.lit("sampler")).alias("systems"), F.array(read).alias("inputs"), F.array(write).alias("outputs"),
    )
    return graph.suite_edges(records)
