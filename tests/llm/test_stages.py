"""Stages of the pipeline on tables that are empty, repeat rows, or have columns named like the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import sentencepiece_scan
from runlens.llm.queries import PIECES, tokenizer_path

MADE = ("kept", "rejected_by", "n_words", "n_lines", "n_dropped", "n_dup_lines", "n_shingles", "component_id", "copies", "size", "target")


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("alpha beta gamma delta river stone house green seven night paper light".split()) + str(rnd.randrange(50)) for _ in range(n))


@pytest.fixture
def docs(spark):
    near = prose(1, 200)
    texts = [(1, prose(0)), (2, near), (3, near + " end"), (2, near), (None, prose(3)), (None, prose(3)), (4, None), (5, "short"), (6, prose(6) + "\nA line\n" + prose(7))]
    rows = spark.createDataFrame([(i, t, "s" if n % 3 else None) for n, (i, t) in enumerate(texts)], "doc_id bigint, text string, source string")
    return rows.select("*", *[F.lit(f"my {c}").alias(c) for c in MADE])


def test_columns_come_through_all_stages(spark, docs):
    rows, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns
        left[name] = rows.collect()
        assert left[name] and all(r[c] == f"my {c}" for r in left[name] for c in MADE), name
        rows = spark.createDataFrame(left[name], docs.schema)
    ids = {name: sorted((r.doc_id for r in found), key=str) for name, found in left.items()}
    assert ids["quality rules"] == ids["line dedup"] == [1, 2, 2, 3, 6, None, None]
    assert ids["n-gram Jaccard join"] == [1, 2, 6, None]
    assert set(ids["mixing sources to target weights"]) <= {1, 2, 6, None}
    coded = corpus_pipeline.encode_pieces(spark, rows, "").collect()
    assert len(coded) == len(left["mixing sources to target weights"]) and all(r.n_tokens == len(r.ids) > 0 for r in coded)


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs.limit(0), "")
        assert done.isEmpty(), name


def test_texts_go_to_the_encoder_once_and_do_not_come_back(spark, odd, monkeypatch):
    docs = odd("one two", None, "", "three\u00a0four " * 40, "x" * 700)
    sent, with_ids = [], sentencepiece_scan._with_ids
    monkeypatch.setattr(sentencepiece_scan, "_with_ids", lambda rows, path: sent.append(rows.columns) or with_ids(rows, path))
    model = tokenizer_path(PIECES)
    whole = sentencepiece_scan.encode(docs, model, chunk_chars=300)
    brief = sentencepiece_scan.encode(docs, model, chunk_chars=300, keep_text=False)
    assert brief.columns == [c for c in whole.columns if c != "text"]
    assert sorted(brief.collect()) == sorted(whole.drop("text").collect())
    corpus_pipeline.encode_pieces(spark, docs, "")
    assert [len(columns) for columns in sent] == [8, 7, 3]
