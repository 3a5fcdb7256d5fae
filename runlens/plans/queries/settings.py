"""Configuration tables."""

from pyspark.sql import DataFrame, functions as F

from runlens.operators import config
from runlens.plans import adapters as a
from runlens.plans.catalog import query


def _settings(t: a.Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("layer"), F.col("props").alias("value"))


_MERGED = "SELECT user_id, event_type AS key, arg_max(props, event_id) AS value FROM {0} GROUP BY ALL"


@query(_MERGED.format("events"))
def layered_merge(t: a.Tables) -> DataFrame:
    """Every event sets a key of its user; the later one is the stronger layer."""
    return config.layered_merge(_settings(t), ["user_id", "key"], "layer", "value")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS key, list_extract(['reference','system','bundle','host','application','experiment','runtime','jvm'],
                     CAST(o_orderkey % 8 + 1 AS BIGINT)) AS layer, o_orderkey % 8 AS rank, o_orderdate FROM orders)
SELECT o_custkey, key, max(rank) AS rank FROM s GROUP BY ALL""")
def layer_ranks(t: a.Tables) -> DataFrame:
    """Named layers: the strongest one that sets a key."""
    names = F.array(*[F.lit(n) for n in config.LAYERS])
    layer = F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("key"), config.layer_rank(layer).cast("bigint").alias("r"))
    ranked = rows.withColumn("rank", F.col("r"))
    return config.layered_merge(ranked, ["o_custkey", "key"], "r", "rank")


@query(f"""WITH old AS (SELECT * FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events)),
a AS ({_MERGED.format('old')}), b AS ({_MERGED.format('events')})
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.key, b.key) AS key, a.value AS old_value, b.value AS new_value
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def config_diff(t: a.Tables) -> DataFrame:
    """Settings half-way through the stream against those at its end."""
    rows = _settings(t)
    half = t.events.agg(F.floor(F.max("event_id") / 2))
    earlier = rows.where(F.col("layer") < half.scalar())
    merged = [config.layered_merge(df, ["user_id", "key"], "layer", "value") for df in (earlier, rows)]
    return config.config_diff(*merged, ["user_id", "key"], "value")


@query("""SELECT c_custkey, key, value FROM (
  SELECT c_custkey, unnest(['name', 'home.nation', 'home.1', 'balance']) AS key,
         unnest([c_name, CAST(c_nationkey AS VARCHAR), CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, CAST(c_custkey % 100 AS VARCHAR)]) AS value
  FROM customer) WHERE value IS NOT NULL""")
def flatten_config(t: a.Tables) -> DataFrame:
    nested = t.customer.select(
        "c_custkey",
        F.struct(F.struct(
            F.struct(F.col("c_name").alias("_root_")).alias("name"),
            F.struct(
                F.col("c_nationkey").alias("nation"),
                F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias('"1"'),
            ).alias("home"),
            (F.col("c_custkey") % 100).alias("balance"),
        ).alias("customer")).alias("config"),
    )
    return config.flatten_config(nested, "config", ["c_custkey"], "customer")


@query("""SELECT c_custkey, key, value FROM (
  SELECT c_custkey, unnest(['name', 'home.nation', 'home."1"', 'balance']) AS key,
         unnest([c_name, CAST(c_nationkey AS VARCHAR), CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, CAST(c_custkey % 100 AS VARCHAR)]) AS value
  FROM customer) WHERE value IS NOT NULL""")
def flatten_environment(t: a.Tables) -> DataFrame:
    """Settings as for environment files: numbers in keys stay quoted."""
    home = F.struct(F.col("c_nationkey").alias("nation"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias('"1"'))
    tree = F.struct(F.struct(
        F.struct(F.col("c_name").alias("_root_")).alias("name"), home.alias("home"), (F.col("c_custkey") % 100).alias("balance"),
    ).alias("customer"))
    return config.flatten_config(t.customer.select("c_custkey", tree.alias("config")), "config", ["c_custkey"], "customer", unquote=False)


def _order_settings(t: a.Tables) -> DataFrame:
    """Prices by priority, date and number of the order; a few rows set a priority itself, which is an object."""
    by = F.concat(F.lit("orders."), "o_orderpriority")
    deep = F.concat(by, F.lit('."'), F.col("o_orderdate").cast("string"), F.lit('".'), F.col("o_orderkey").cast("string"))
    rows = t.orders.select("o_custkey", deep.alias("key"), F.col("o_totalprice").cast("string").alias("value"))
    return rows.unionByName(t.orders.where("o_orderkey % 50 = 0").select("o_custkey", by.alias("key"), F.lit("x").alias("value")))


@query("""SELECT o_custkey, 'orders.' || o_orderpriority || '.' || CASE WHEN contains(CAST(o_orderdate AS VARCHAR), '.') THEN '"' || o_orderdate || '"' ELSE CAST(o_orderdate AS VARCHAR) END || '.' || o_orderkey AS key,
o_totalprice AS price FROM orders""")
def nest_settings(t: a.Tables) -> DataFrame:
    """Dotted settings put together as one object per customer, and taken apart again."""
    trees, _ = config.nest_config(_order_settings(t), "o_custkey")
    return config.unnest_config(trees, "o_custkey").select("o_custkey", "key", F.col("value").cast("double").alias("price"))


@query("""SELECT o_custkey, 'orders.' || o_orderpriority AS key, 'a value and an object' AS reason FROM orders WHERE o_orderkey % 50 = 0 GROUP BY ALL""")
def nest_rejects(t: a.Tables) -> DataFrame:
    return config.nest_config(_order_settings(t), "o_custkey")[1]
