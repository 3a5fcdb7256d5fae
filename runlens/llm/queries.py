"""The operators as queries over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import (
    chat_format, cover_tree, fair_mix, lexical_search, line_dedup, ngram_join, periodic_runs, quality, sentencepiece_scan, suffix_dedup,
    token_files, token_rollup, url_filter,
)
from runlens.llm.common import WORD, documents
from runlens.llm.sql import SQL
from runlens.session import work_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    schema = "conv_id bigint, turn bigint, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema)
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    parts = rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    read_back = chat_format.parse_chats(chat_format.format_chats(parts))
    newline = F.lit("\n")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    model = tokenizer_path(PIECES)
    coded = sentencepiece_scan.encode(documents(spark, folder).select("doc_id", "text"), model, keep_text=False)
    read = sentencepiece_scan.decode(coded, model)
    return read.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return ngram_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_tokens(documents(spark, folder), path, tokenizer_path(), end_id=1)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy()).cast("B")
            sums = [zlib.crc32(flat[4 * ends[i] : 4 * ends[i + 1]]) for i in range(batch.num_rows)]
            counts = [int(ends[i + 1] - ends[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    read = token_files.with_starts(spark, path).select("doc_id", "start", "ids")
    return read.mapInArrow(digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches over all documents: insert all; count what is not English anew under a second version
    and revise the first one's to it; delete short documents. The second is committed twice, to no effect."""
    docs = documents(spark, folder).select(
        "doc_id", "source", "lang", fair_mix.word_count().alias("words"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[a-z0-9]+|[^a-z0-9\x20\x09-\x0D]")).cast("long").alias("pieces"),
    )
    columns = ["seq", "doc_id", "source", "lang"]
    rows = docs.withColumn("seq", F.lit(0))

    def change(op: str, tokenizer: str, count: str | None, where: str) -> DataFrame:
        value = F.lit(None).cast("long") if count is None else F.col(count)
        return rows.where(where).select(F.lit(op).alias("op"), *columns, F.lit(tokenizer).alias("tokenizer"), value.alias("n_tokens"))

    rollup = token_rollup.TokenRollup(spark, work_path(spark, "token-rollup"))
    rollup.commit(1, change("insert", "words-1", "words", "true"))
    foreign = "lang is null or lang <> 'en'"
    second = change("insert", "pieces-1", "pieces", foreign).unionByName(change("revise", "words-1", "pieces", foreign))
    rollup.commit(2, second)
    rollup.commit(2, second)
    rollup.commit(3, change("delete", "words-1", None, "words < 20").unionByName(change("delete", "pieces-1", None, "words < 20")))
    return rollup.totals()


def op6_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = cover_tree.usable(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")
    scaled = rows.withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("double")))
    found = cover_tree.top_k(scaled, scaled.where(F.col("id") % 50 == 0), k=5)
    return found.withColumn("score", F.col("score").cast("long"))


def op7_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return fair_mix.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(documents(spark, folder).select("doc_id", "text"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.drop_frequent_lines(documents(spark, folder).select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    measured = quality.with_features(docs)
    failed = F.expr(" or ".join(f"({r.fails})" for r in quality.BASE))
    return quality.cascade(measured, measured=quality.FEATURES, sample_of=docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical_search.top_k(documents(spark, folder), items, k=20)


def planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of one document in ten, by the checksum of the id, with a tail of words that repeats."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    n, g, words = F.size("words").cast("long"), F.col("g"), F.regexp_extract_all("text", F.lit(f"({WORD})"))
    # words are cut only where they are needed
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("a", F.when(n > 0, g % n))
    p = 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long")
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1 - F.col("a")), lambda i: F.get("words", (F.col("a") + i % p).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return docs.select("doc_id", F.when(F.size("words") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_periods(documents(spark, folder)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The rules of the query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_sentencepiece, op3_ngram_join, op4_token_files, op5_token_counts, op6_cover_tree, op7_fair_mix,
        op8_suffix_dedup, op9_line_dedup, op10_quality_rules, op11_lexical_search, op12_periodic_runs, op13_url_filter,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in QUERIES if name in SQL}
