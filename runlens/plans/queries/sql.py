"""Shared pieces of the SQL statements."""

from __future__ import annotations

from runlens.functions import ranhash

SYSTEM = """system AS (
  SELECT n_name AS id, r_name AS name, concat(n_nationkey, '.0') AS version
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
EXPERIMENT = """experiment AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS suite, n_name AS system
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
EXPERIMENT_RUN = """experiment_run AS (
  SELECT o_orderkey AS id, o_custkey AS experiment_id, o_orderkey AS run,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INTEGER) AS exit,
         CAST(round(o_totalprice * 100) AS BIGINT) AS time
  FROM orders)"""
STATE = """list_extract(['SCHEDULED','DEPLOYING','RUNNING','FINISHED','FAILED'], CAST(event_id % 5 + 1 AS BIGINT))"""
MILLIS = "(epoch_us(ts) // 1000)"
CSV_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"
LOG_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')"

FOLDERS = """folders AS (
  SELECT *, event_type AS suite, user_id % 4 AS ex, (user_id // 4) % 3 + 1 AS rn,
         CASE WHEN user_id % 4 = 3 AND (user_id // 4) % 3 + 1 = 3 THEN 'exp3.final'
              ELSE concat('exp', user_id % 4, '.run0', (user_id // 4) % 3 + 1) END AS name
  FROM events)"""
STATES = FOLDERS + """, states AS (
  SELECT suite, name, ex, rn,
         CASE WHEN NOT (ex = 2 AND rn = 3) THEN 'job ' || name END AS command,
         CASE WHEN ex % 2 = 0 THEN 'flink-1.0.3' ELSE 'spark-1.6.0' END AS runner_id,
         CASE WHEN ex % 2 = 0 THEN 'flink' ELSE 'spark' END AS runner_name,
         CASE WHEN ex % 2 = 0 THEN '1.0.3' ELSE '1.6.0' END AS runner_version,
         CAST(CASE WHEN ex = 0 AND rn = 3 THEN NULL WHEN (ex + rn) % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS run_time
  FROM folders GROUP BY ALL)"""

EDGES = """edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders)"""

_P, _Q = 1 << 64, 1 << 63


def java_hash(text: str) -> str:
    return wrap32(
        f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT)), "
        "lambda acc, x: (acc * 31 + x) % 4294967296)"
    )


def wrap32(value: str) -> str:
    return f"CAST(((({value}) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 AS INTEGER)"


def experiment_id(name: str, suite: str) -> str:
    return wrap32(f"CAST({java_hash(name)} AS BIGINT) * 31 + {java_hash(suite)}")


def _wrap64(value: str) -> str:
    return f"((({value}) % {_P}::HUGEINT + {_P}::HUGEINT + {_Q}::HUGEINT) % {_P}::HUGEINT) - {_Q}::HUGEINT"


def uniform(source: str, position: str, out: str, seed: int = ranhash.DEFAULT_SEED, tag: str | None = None) -> tuple[str, str]:
    """(CTEs, name of the last one): ``source`` with the draw at ``position`` as ``out``."""
    tag = tag or f"{source}_{out}"
    right = "CAST(xor(CAST(__x AS BIGINT), CAST(__x AS BIGINT) >> {0}) AS HUGEINT)"
    left = "CAST(xor(CAST(__x AS BIGINT), CAST(" + _wrap64("__x * {1}::HUGEINT") + " AS BIGINT)) AS HUGEINT)"
    steps = [
        _wrap64(f"__x * {ranhash.FIRST_FACTOR}::HUGEINT + {ranhash.INCREMENT}::HUGEINT"),
        right.format(21), left.format(37, 1 << 37), right.format(4),
        _wrap64(f"__x * {ranhash.SECOND_FACTOR}::HUGEINT"),
        left.format(20, 1 << 20), right.format(41), left.format(5, 1 << 5),
    ]
    ctes = [f"{tag}_0 AS (SELECT *, CAST({position} AS HUGEINT) + {seed} AS __x FROM {source})"]
    for i, step in enumerate(steps, 1):
        ctes.append(f"{tag}_{i} AS (SELECT * REPLACE ({step} AS __x) FROM {tag}_{i - 1})")
    ctes.append(
        f"{tag} AS (SELECT * EXCLUDE (__x), CAST(__x AS DOUBLE) * {ranhash.TWO_POW_NEG_64!r} + 0.5 AS {out} FROM {tag}_{len(steps)})"
    )
    return ",\n".join(ctes), tag
