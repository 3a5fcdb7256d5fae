"""SentencePiece ids of a BPE model against the library with the unchanged model file."""

import os
import random
from array import array

import duckdb
import pytest

from runlens.llm import sentencepiece_scan
from runlens.llm.queries import PIECES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", "  a  b ", "\n\n", "日本語テスト𝔘x", "é´̀", "the then\tthere. The", "supercalifragilistic" * 6, "a▁b", "x" * 90, " " * 70, "a" + " " * 37 + "the"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def model():
    return sentencepiece_scan.Model(tokenizer_path(PIECES))


def test_merges_are_those_of_the_library(library, model):
    rnd = random.Random(2)
    pieces = [p.replace("▁", " ") for p in model.piece]
    for alphabet in (pieces, pieces[:500], "ab etn", " aé日\n\t▁𝔘́."):
        for t in [*TEXTS, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(200))]:
            want, normal = library.encode(t), model.normal(t)
            assert list(array("I", model.encode(normal))) == want, t
            # neither way to replay merges needs the cuts
            for ends in (model._merged_ends(normal), model._merged_ends_of_long(normal)) if normal else ():
                assert list(array("I", model.ids(normal, ends))) == want, t


@pytest.mark.parametrize("chunk", [16, 40])
def test_chunks_of_a_bpe_model_give_the_ids_of_the_library(spark, odd, library, chunk):
    texts = [None, *TEXTS, "the quick brown fox. " * 20, "nospaceatall" * 30]
    got = sentencepiece_scan.encode(odd(*texts), tokenizer_path(PIECES), chunk_chars=chunk).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all((r.n_chunks > 1) == (len(r.text or "") >= chunk) for r in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_documents_have_the_ids_of_the_library(library, model):
    for (text,) in duckdb.sql(f"SELECT coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall():
        assert list(array("I", model.encode(model.normal(text)))) == library.encode(text)


@pytest.mark.parametrize("kind", [1, 3])
def test_type_of_the_model_decides(tmp_path, kind):
    """Unigram models still take the best path, also in chunks; what is neither is refused."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = kind
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    if kind == 3:
        with pytest.raises(ValueError):
            sentencepiece_scan.Model(str(tmp_path / "other.model"))
    else:
        assert not sentencepiece_scan.Model(str(tmp_path / "other.model")).merges


@pytest.mark.parametrize("chunk, fan", [(16, 2), (40, 128)])
def test_chunks_of_a_unigram_model(spark, odd, tmp_path, chunk, fan):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model = sentencepiece_scan.Model(str(path))
    texts = [None, *TEXTS, "the quick brown fox. " * 20, "nospaceatall" * 30]
    got = sentencepiece_scan.encode(odd(*texts), str(path), chunk_chars=chunk, fan=fan).collect()
    assert {r.doc_id: r.ids for r in got} == {i: list(array("I", model.encode(model.normal(t or "")))) for i, t in enumerate(texts)}


def test_letters_without_blanks_in_many_chunks(spark, library):
    """A million letters that no certain boundary cuts: every chunk needs the ones before it."""
    rnd = random.Random(7)
    words = ["the", "ing", "tion", "er", "an", "s", "q", "re", "straße", "x"]
    text = "".join(rnd.choice(words) for _ in range(400_000))[:1_000_000]
    docs = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in sentencepiece_scan.encode(docs, tokenizer_path(PIECES), chunk_chars=8_192, fan=16).collect()}
    assert got[1].n_chunks == 123 and got[2].n_chunks == 13
    for i, t in ((1, text), (2, "x" * 100_000)):
        assert got[i].ids == library.encode(t)


def test_neighbours_tell_the_merges(library, model):
    """The merges' pieces fit their neighbours, and from the begin no boundary has two pieces before it."""
    rnd = random.Random(3)
    for t in [*TEXTS, *("".join(rnd.choice("abetn re") for _ in range(rnd.randint(1, 120))) for _ in range(50))]:
        normal, states = model.normal(t), {0: {0: 1}}
        model.follow(normal, 0, len(normal), states)
        assert all(len(d) == 1 for d in states.values())
        ends = [len(normal)]
        while ends[-1]:
            ends.append(ends[-1] - next(iter(states[ends[-1]])))
        assert list(array("I", model.ids(normal, ends[::-1]))) == library.encode(t), t
