"""Generated data whose rows are numbered by the given tables."""

from pyspark.sql import DataFrame, functions as F

from runlens.functions.ranhash import DEFAULT_SEED, with_uniform
from runlens.operators import datagen as gen
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql

_K = 1000
_U, _U_LAST = sql.uniform("events", "event_id", "u")


@query("""WITH c AS (SELECT (count(*) + 7) // 8 AS k FROM lineitem)
SELECT n, CAST((n - 1) // k AS INTEGER) AS task FROM (SELECT unnest(range(1, 8 * k + 1)) AS n, k FROM c)""")
def row_numbers(t: a.Tables) -> DataFrame:
    """As many numbers as there are line items, in eight equal tasks."""
    each = (t.lineitem.count() + 7) // 8
    return gen.row_numbers(t.spark, 8, each).select(F.col("id").alias("n"), F.spark_partition_id().alias("task"))


@query(f"WITH {_U} SELECT event_id, u FROM {_U_LAST}")
def ranhash(t: a.Tables) -> DataFrame:
    return with_uniform(t.events.select("event_id"), F.col("event_id"), "u")


@query(f'WITH {_U} SELECT event_id, CAST(greatest(ceil(u * {_K}) - 1, 0) AS INTEGER) AS "index" FROM {_U_LAST}')
def sample_uniform(t: a.Tables) -> DataFrame:
    return _sampled(t, "uniform", 1.0)


def _sampled(t: a.Tables, distribution: str, parameter: float) -> DataFrame:
    rows = with_uniform(t.events.select("event_id"), F.col("event_id"), "u")
    return gen.with_distribution(rows, _K, distribution, parameter).select("event_id", "index")


def _by_cdf(weight: str) -> str:
    return f"""WITH {_U}, w AS (SELECT i, {weight} AS w FROM range(0, {_K}) t(i)),
c AS (SELECT i, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS hi FROM w),
cdf AS (SELECT i, coalesce(lag(hi) OVER (ORDER BY i), 0) AS lo, CASE WHEN i = {_K - 1} THEN 1.0 ELSE hi END AS hi FROM c)
SELECT event_id, CAST(i AS INTEGER) AS "index" FROM {_U_LAST} JOIN cdf ON u > lo AND u <= hi"""


_ZIPF = "pow(i + 1.0, -1.0)"
_BINOMIAL = f"exp(lgamma({_K}) - lgamma(i + 1) - lgamma({_K} - i) + {_K - 1} * ln(0.5))"


@query(_by_cdf(_ZIPF))
def sample_zipf(t: a.Tables) -> DataFrame:
    return _sampled(t, "zipf", 1.0)


@query(_by_cdf(_BINOMIAL))
def sample_binomial(t: a.Tables) -> DataFrame:
    return _sampled(t, "binomial", 0.5)


_D, _D_LAST = sql.uniform("draws", "i * 27 + j", "d")


@query(f"""WITH draws AS (SELECT i, j FROM range(0, {_K}) a(i), range(0, 15) b(j)), {_D},
lens AS (SELECT i, CAST(floor(d * 13) + 2 AS BIGINT) AS len FROM {_D_LAST} WHERE j = 0),
dictionary AS (SELECT l.i AS i, string_agg(chr(97 + CAST(floor(d * 26) AS INTEGER)), '' ORDER BY j) AS word
               FROM {_D_LAST} x JOIN lens l ON x.i = l.i WHERE j BETWEEN 1 AND len GROUP BY l.i),
sampled AS ({_by_cdf(_ZIPF)})
SELECT event_id, word FROM sampled JOIN dictionary ON "index" = i""")
def gen_words(t: a.Tables) -> DataFrame:
    """A Zipf-distributed word per event."""
    return gen.with_sampled_word(t.events.select("event_id"), "event_id", _K, "zipf", 1.0)


def _key_values_sql() -> str:
    uk, last = sql.uniform("rows", "i * 2", "uk")
    uv, last = sql.uniform(last, "i * 2 + 1", "uv", tag="uv")
    numbered = f"numbered AS (SELECT *, CAST(greatest(ceil(uv * 1000000) - 1, 0) AS BIGINT) AS n FROM {last})"
    ctes, last = [], "numbered"
    for j, name in enumerate(("ul", "ua", "ub")):
        cte, last = sql.uniform(last, f"n * 3 + {j}", name, DEFAULT_SEED + 1, tag=name)
        ctes.append(cte)
    digits = "concat(" + ", ".join(
        f"lpad(lower(to_hex(CAST(floor({c} * 1099511627776) AS BIGINT))), 10, '0')" for c in ("ua", "ub")
    ) + ")"
    return f"""WITH rows AS (SELECT o_orderkey AS i FROM orders), {uk}, {uv}, {numbered}, {", ".join(ctes)}
SELECT i, CAST(greatest(ceil(uk * 400) - 1, 0) AS BIGINT) AS k,
       substring(translate({digits}, '0123456789abcdef', 'abcdefghijklmnop'), 1, CAST(floor(ul * 11) + 10 AS BIGINT)) AS v
FROM {last}"""


@query(_key_values_sql())
def gen_key_values(t: a.Tables) -> DataFrame:
    """A (key, string) pair per order."""
    return gen.with_key_value(t.orders.select(F.col("o_orderkey").alias("i")), "i", 400).select("i", "k", "v")
