"""File scans and file-level relations."""

from pyspark.sql import DataFrame, functions as F

from runlens.operators.extract import registered, route_files as route
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.plans.queries import sql
from runlens.schemas import LISTENER_EVENT
from runlens.session import work_path
from runlens.sources import files as src
from runlens.sources.checksums import tree_checksums
from runlens.sources.event_csv import read_key_values
from runlens.sources.files import scan_lines as read_lines
from runlens.sources.hidden import scan_hidden_lines


@query(f"""SELECT {sql.LOG_TIME} || chr(9) || event_type || '(' || user_id || '/200) switched to ' || {sql.STATE} || ' ' AS value
FROM events""")
def scan_lines(t: a.Tables) -> DataFrame:
    """Lines of gzip-compressed logs."""
    lines = t.events.select(a.flink_v1_line().alias("value"))
    return read_lines(t.spark, a.stage_text(t, lines, "lines", compression="gzip")).select("value")


@query(f"""SELECT CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_type = 'view' THEN 'SparkListenerTaskStart' ELSE 'SparkListenerTaskEnd' END END AS event,
       CASE WHEN event_id % 4 > 0 AND event_type <> 'signup' THEN user_id END AS stage_id,
       CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 2000000000 AS INTEGER) END AS task_id,
       CASE WHEN event_id % 4 > 0 THEN {sql.MILLIS} END AS launch_time,
       CASE WHEN event_id % 4 = 0 THEN 'malformed json' END AS reason
FROM events""")
def scan_json_events(t: a.Tables) -> DataFrame:
    """Objects line by line; every fourth line is cut short and becomes a reject."""
    line = a.spark_json_line()
    broken = F.when(F.col("event_id") % 4 == 0, F.left(line, F.lit(30))).otherwise(line)
    path = a.stage_text(t, t.events.select(broken.alias("value")), "json")
    records, rejects = src.scan_json_lines(read_lines(t.spark, path), LISTENER_EVENT)
    good = records.select(
        F.col("record.Event").alias("event"), F.col("record.`Stage ID`").alias("stage_id"),
        F.col("record.`Task Info`.`Task ID`").alias("task_id"),
        F.col("record.`Task Info`.`Launch Time`").alias("launch_time"),
        F.lit(None).cast("string").alias("reason"),
    )
    return good.unionByName(rejects.select("reason"), allowMissingColumns=True)


@query("""SELECT l_partkey AS k, concat(l_returnflag, l_linestatus, ',"', l_linenumber) AS v FROM lineitem""")
def scan_key_values(t: a.Tables) -> DataFrame:
    """Typed CSV; values hold separators and quotes."""
    value = F.concat("l_returnflag", "l_linestatus", F.lit(',"'), F.col("l_linenumber").cast("string"))
    path = work_path(t.spark, "key-values")
    t.lineitem.select(F.col("l_partkey").alias("k"), value.alias("v")).write.option("escape", '"').csv(path)
    return read_key_values(t.spark, path)


@query("""WITH f AS (SELECT o_orderkey, list_extract(['logs/flink/flink-u-jobmanager-h.log', 'logs/spark/app-1-22', 'logs/dstat/dstat-u-h.csv',
                                'logs/flink/flink-u-taskmanager-h.log', 'run.out', 'logs/spark/app-1-x'], CAST(o_orderkey % 6 + 1 AS BIGINT)) AS rel FROM orders)
SELECT o_orderkey, rel, CAST(1 AS INTEGER) AS n_readers, CAST(1 AS INTEGER) AS n_extractors,
       CASE o_orderkey % 6 WHEN 0 THEN 'flink_tasks' WHEN 1 THEN 'spark_tasks' ELSE 'dstat' END AS extractor,
       CASE o_orderkey % 6 WHEN 1 THEN 'json' ELSE 'line' END AS reader
FROM f WHERE o_orderkey % 6 < 3""")
def route_files(t: a.Tables) -> DataFrame:
    """One file per order, named like a log, another system's log or plain output."""
    names = [
        "logs/flink/flink-u-jobmanager-h.log", "logs/spark/app-1-22", "logs/dstat/dstat-u-h.csv",
        "logs/flink/flink-u-taskmanager-h.log", "run.out", "logs/spark/app-1-x",
    ]
    rel = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = t.orders.select("o_orderkey", rel.alias("rel")).withColumn("file_name", F.substring_index("rel", "/", -1))
    return route(files, registered().values()).drop("file_name")


@query("""SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY doc_id""")
def file_line_counts(t: a.Tables) -> DataFrame:
    return src.file_line_counts(a.document_lines(t), "doc_id")


@query("""WITH numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT n.doc_id AS doc_id, n.line_no AS line_no, n.line AS line FROM numbered n LEFT JOIN labels l ON n.doc_id = l.doc_id
WHERE n.line_no > coalesce(2 + l.quality, 0)""")
def delta_lines(t: a.Tables) -> DataFrame:
    """Two or three lines were seen of the labelled documents, none of the others."""
    offsets = t.labels.select("doc_id", (F.col("quality") + 2).alias("n_lines"))
    return src.delta_lines(a.document_lines(t), offsets, "doc_id").select("doc_id", "line_no", "line")


@query("""WITH lines AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, event_type FROM events)
SELECT event_type, event_id, line_no FROM lines WHERE line_no > (SELECT count(*) FROM events e WHERE e.event_type = lines.event_type AND event_id % 3 = 0)""")
def appended_lines(t: a.Tables) -> DataFrame:
    """Files of event ids, some lines long when they are read first; the second read finds the lines after those."""
    path = work_path(t.spark, "logs")
    numbered = t.events.select(F.col("event_id").cast("string").alias("value"), "event_type")
    numbered.repartition("event_type").sortWithinPartitions("event_type", F.col("value").cast("bigint")).write.partitionBy("event_type").text(path)
    seen = t.events.where("event_id % 3 = 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_lines"))
    files = read_lines(t.spark, path).select("file").distinct().withColumn("event_type", F.regexp_extract("file", "event_type=([^/]+)/", 1))
    new, _ = src.appended_lines(t.spark, path, files.join(seen, "event_type").select("file", "n_lines"))
    return new.select(
        F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("event_type"), F.col("value").cast("bigint").alias("event_id"), "line_no"
    )


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no FROM events")
def hidden_lines(t: a.Tables) -> DataFrame:
    """A file of event ids for each type below a folder that Spark's readers pass over, read in splits of 4 kB with line numbers."""
    root = work_path(t.spark, "tree")
    numbered = t.events.select(F.col("event_id").cast("string").alias("value"), "event_type").repartition("event_type")
    numbered.sortWithinPartitions("event_type", F.col("value").cast("bigint")).write.partitionBy("event_type").text(f"{root}/_kept")
    files = src.scan_files(t.spark, root).where(F.col("file_name").startswith("part-")).select("source", "bytes")
    lines = src.number_lines(scan_hidden_lines(files, root, split_bytes=4096))
    return lines.select(
        F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("event_type"), F.col("value").cast("bigint").alias("event_id"), "line_no"
    )


def _log_files(t: a.Tables) -> DataFrame:
    path = F.concat(F.lit("app-"), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"))
    return t.events.select("user_id", path.alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("modified"))


_FILES = "files AS (SELECT user_id, 'app-' || event_type || '-' || event_id AS path, epoch_us(ts) AS modified FROM events)"
_LATEST = "SELECT user_id, m.path AS path, m.modified AS modified FROM (SELECT user_id, max(struct_pack(modified := modified, path := path)) AS m FROM {0} GROUP BY user_id)"


@query(f"WITH {_FILES} {_LATEST.format('files')}")
def latest_file(t: a.Tables) -> DataFrame:
    return src.latest_file(_log_files(t), ["user_id"])


@query(f"""WITH {_FILES}, earlier AS (SELECT * FROM files WHERE modified < epoch_us(TIMESTAMP '2024-01-20')),
now AS ({_LATEST.format('files')}), before AS ({_LATEST.format('earlier')})
SELECT n.user_id AS user_id, n.path AS path, n.modified AS modified FROM now n LEFT JOIN before b ON n.user_id = b.user_id
WHERE n.path IS DISTINCT FROM b.path""")
def changed_latest_file(t: a.Tables) -> DataFrame:
    """Users whose newest file is not the one of an earlier snapshot."""
    files = _log_files(t)
    cut = F.unix_micros(F.lit("2024-01-20").cast("timestamp"))
    before = src.latest_file(files.where(F.col("modified") < cut), ["user_id"])
    return src.changed_latest(before, src.latest_file(files, ["user_id"]), ["user_id"])


@query("""SELECT d.doc_id AS doc_id, md5(d.text) AS md5,
       CASE WHEN l.doc_id IS NOT NULL THEN md5(CASE WHEN l.quality = 1 THEN d.text ELSE d.text || 'x' END) END AS expected
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR l.quality <> 1""")
def checksum_check(t: a.Tables) -> DataFrame:
    """Texts against the sums on record: right for good labels, wrong for bad ones, absent otherwise."""
    actual = t.documents.select("doc_id", F.md5("text").alias("md5"))
    told = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    expected = t.documents.join(t.labels, "doc_id").select("doc_id", F.md5(told).alias("md5"))
    return src.checksum_mismatches(actual, expected, "doc_id")


@query("SELECT 'nation=' || n_nationkey AS folder, md5(n_name || chr(10)) AS md5 FROM nation")
def checksum_files(t: a.Tables) -> DataFrame:
    """MD5 of whole files, one per nation."""
    path = work_path(t.spark, "sums")
    t.nation.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    return src.checksum_files(t.spark, path).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "md5")


@query("""WITH lines AS (SELECT o_orderkey // 1000 AS file, string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1),
blocks AS (SELECT file, length(text) AS bytes, unnest(range(0, greatest((length(text) + 511) // 512, 1))) AS node, text FROM lines),
level0 AS (SELECT file, bytes, count(*) OVER (PARTITION BY file) AS n, node, md5(substr(text, node * 512 + 1, 512)) AS h FROM blocks),
level1 AS (SELECT file, bytes, n, node // 16 AS node, CASE WHEN n > 1 THEN md5(string_agg(h, '' ORDER BY node)) ELSE max(h) END AS h FROM level0 GROUP BY file, bytes, n, node // 16)
SELECT file, bytes, n AS n_blocks, CASE WHEN n > 16 THEN md5(string_agg(h, '' ORDER BY node)) ELSE max(h) END AS md5 FROM level1 GROUP BY file, bytes, n""")
def checksum_blocks(t: a.Tables) -> DataFrame:
    """Files of a thousand orders, summed up in blocks of 512 bytes by trees of fan-out 16."""
    path = work_path(t.spark, "block-sums")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    lines = t.orders.select(F.expr("o_orderkey div 1000").alias("file"), "o_orderkey", line.alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "o_orderkey").select("file", "value").write.partitionBy("file").text(path)
    sums = tree_checksums(t.spark, path, block_bytes=512, fan=16)
    return sums.select(F.regexp_extract("path", "file=([0-9]+)/", 1).cast("long").alias("file"), "bytes", "n_blocks", "md5")
