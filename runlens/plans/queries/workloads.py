"""The standard workloads."""

from pyspark.sql import DataFrame, functions as F

from runlens.operators import aggregates as agg
from runlens.plans import adapters as a
from runlens.plans.catalog import query
from runlens.session import spread, work_path
from runlens.sources.files import scan_lines
from runlens.sources.text_sinks import write_counts_csv, write_counts_text, write_words

_VALUE = "concat(l_returnflag, l_linestatus, l_suppkey, '-', l_orderkey)"


def _pairs(t: a.Tables, lineitem: DataFrame | None = None) -> DataFrame:
    value = F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"))
    return (t.lineitem if lineitem is None else lineitem).select(F.col("l_partkey").alias("k"), value.alias("v"))


@query(r"""WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
tokens AS (
  SELECT line, unnest(regexp_split_to_array(lower(line), '\W+')) AS word,
         generate_subscripts(regexp_split_to_array(lower(line), '\W+'), 1) AS pos FROM lines)
SELECT word, count(*) AS n FROM tokens
WHERE word <> '' OR (pos = 1 AND (line = '' OR regexp_matches(line, '\w')))
GROUP BY word""")
def wordcount(t: a.Tables) -> DataFrame:
    lines = spread(t.documents.select("doc_id", "text"), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    return agg.word_count(lines)


@query(f"SELECT l_partkey AS k, CAST(max(length({_VALUE})) AS INTEGER) AS max_len FROM lineitem GROUP BY l_partkey")
def max_len_per_key(t: a.Tables) -> DataFrame:
    return agg.max_length_per_key(_pairs(t))


@query(f"SELECT l_partkey AS k, max({_VALUE}) AS max_value FROM lineitem GROUP BY l_partkey")
def max_value_per_key(t: a.Tables) -> DataFrame:
    return agg.max_value_per_key(_pairs(t))


@query(f"""SELECT k, max(struct_pack(l := length(v), v := v)).v AS v
FROM (SELECT l_partkey AS k, {_VALUE} AS v FROM lineitem) GROUP BY k""")
def user_reduce(t: a.Tables) -> DataFrame:
    """The longest value per key, the largest one of equally long ones, by a Python function."""

    def longer(left: str, right: str) -> str:
        return max(left, right, key=lambda s: (len(s), s))

    # Python works per row here: worth spreading a small scan
    return agg.reduce_per_key(_pairs(t, spread(t.lineitem, "l_orderkey")), "k", "v", longer)


@query("""WITH lines AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT file, marker, count(*) AS n FROM lines, (VALUES ('the'), ('ou'), ('@')) AS m(marker)
WHERE contains(line, marker) GROUP BY file, marker""")
def marker_counts(t: a.Tables) -> DataFrame:
    lines = a.document_lines(t).select(F.col("source").alias("file"), "line")
    return agg.marker_counts(lines, ["the", "ou", "@"], "file", "line")


_COUNTS = "SELECT p_brand AS word, count(*) AS n FROM part GROUP BY p_brand"


@query(f"WITH c AS ({_COUNTS}) SELECT 'text' AS sink, '(' || word || ',' || n || ')' AS line FROM c UNION ALL SELECT 'csv', word || ',' || n FROM c")
def count_sinks(t: a.Tables) -> DataFrame:
    """Counts written as tuples and as CSV, over an earlier output, and read back as lines."""
    counts = t.part.groupBy(F.col("p_brand").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for sink, write in (("text", write_counts_text), ("csv", write_counts_csv)):
        path = work_path(t.spark, f"counts-{sink}")
        for _ in range(2):
            write(counts, path)
        out.append(scan_lines(t.spark, path).select(F.lit(sink).alias("sink"), F.col("value").alias("line")))
    return out[0].unionByName(out[1])


@query("SELECT p_name AS value FROM part")
def word_sink(t: a.Tables) -> DataFrame:
    """Words written over an earlier output."""
    path = work_path(t.spark, "words")
    for column in ("p_brand", "p_name"):
        write_words(t.part, path, column)
    return scan_lines(t.spark, path).select("value")
