"""Every query of the subpackage against its SQL, or against brute force on the same table."""

import hashlib
import os
import struct
import zlib
from array import array
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import compare, oracle
from runlens.llm import queries as llm
from runlens.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_registered_once_for_each_operator():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()


def test_token_files_against_the_library(spark, texts):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(llm.tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in llm.op4_token_files(spark, FOLDER).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert got[doc_id] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_pieces_against_one_pass_over_each_text(spark, texts):
    from runlens.llm.sentencepiece_scan import Model

    model = Model(llm.tokenizer_path(llm.PIECES))
    got = {r.doc_id: r for r in llm.op2_sentencepiece(spark, FOLDER).collect()}
    for doc_id, text in texts:
        row = got[doc_id]
        assert row.ids == list(array("I", model.encode(model.normal(text)))) and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_removed_repeats_against_all_windows(spark, texts):
    length, seen = 200, Counter()
    bodies = [(i, t.encode()) for i, t in texts]
    for _, b in bodies:
        seen.update(hash(b[i : i + length]) for i in range(len(b) - length + 1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in llm.op8_suffix_dedup(spark, FOLDER).collect()}
    for doc_id, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert got[doc_id] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
