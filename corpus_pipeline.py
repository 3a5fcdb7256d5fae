"""A corpus from raw documents to token ids: five stages, each written and read again by whoever runs them.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
Rows are documents; mixing returns a document once for each time it is taken.

Defined cases, in all stages: an empty table gives an empty one. Columns of documents come through under their names with
their values, also if an operator makes a column of that name. Null texts are empty ones: they fail the quality rules. Rows that agree in id and text
are one document from the n-gram join on, before it they are judged one by one, alike. Of linked documents with equal or null ids the one of the smallest
row key stays. A document that loses all its lines stays as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import fair_mix, line_dedup, ngram_join, quality, sentencepiece_scan
from runlens.llm.common import documents, row_key, table
from runlens.llm.queries import PIECES, tokenizer_path


def _set_aside(docs: DataFrame, made: Iterable[str]) -> DataFrame:
    """Columns that are called like what an operator makes, out of its way."""
    return docs.withColumnsRenamed({c: f"__given_{c}" for c in docs.columns if c in made})


def _as_given(done: DataFrame, docs: DataFrame, made: Iterable[str]) -> DataFrame:
    return done.select(*[F.col(f"`__given_{c}`" if c in made else f"`{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    made = ("kept", "rejected_by", *quality.FEATURES)
    return _as_given(quality.cascade(_set_aside(docs, made)).where("kept"), docs, made)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; ``n_chars`` follows the text."""
    made = ("n_lines", "n_dropped")
    kept = _as_given(line_dedup.drop_frequent_lines(_set_aside(docs, made), min_docs=10, min_chars=1), docs, made)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("long"))
    return kept


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id, also if ids are null or tied; documents without words stay."""
    made = ("n_shingles", "component_id")
    joined = ngram_join.jaccard_components(_set_aside(docs, made), first="__first").where("__first")
    # rows that agree in id and text are one document
    return _as_given(joined.withColumn("__key", row_key()).dropDuplicates(["__key"]), docs, made)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, twice at most."""
    return fair_mix.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of the text."""
    coded = sentencepiece_scan.encode(docs.select("doc_id", "source", "text"), tokenizer_path(PIECES), keep_text=False)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The last stage can not be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
