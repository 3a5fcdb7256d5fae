"""Chat formatting, line dedup, quality rules, token files, SentencePiece: small cases."""

import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import chat_format, line_dedup, quality, sentencepiece_scan, token_files
from runlens.llm.queries import PIECES, tokenizer_path

# -- chat formatting ---------------------------------------------------------------------------

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>", "\\", "\\\\<|", "<\\|x", "[\\INST]<s>\\", "<<SYS>>", "<</SYS>>\\<", "a<|end|>\nb", "é<s>日"]


def chats(spark, rows):
    schema = f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}, n_turns string"
    return spark.createDataFrame([(*r, "clash") for r in rows], schema)


def text(value):
    return [("text", value, None, None, None, None, None)]


def test_any_text_comes_back(spark):
    rows = [(c, t, role, text(x + y)) for c, x in enumerate(TEXTS) for t, (y, role) in enumerate(zip(TEXTS, ["user", "assistant"] * 6))]
    back = chat_format.parse_chats(chat_format.format_chats(chats(spark, rows))).collect()
    assert len(back) == len(TEXTS)
    for r in back:
        said = [TEXTS[r.conv_id] + y for y in TEXTS]
        assert [t.text for t in r.turns] == said
        assert r.loss_text == "".join(said[1::2])
        for s in r.loss_spans:
            assert r.formatted[s.start_in_chat : s.start_in_chat + s.length] == r.formatted.split("<|turn|>")[s.turn + 1][
                s.start - 8 : s.start - 8 + s.length
            ]
        assert r.formatted.count("<|turn|>") == len(TEXTS) and "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_parts_become_placeholders_in_order(spark):
    parts = [
        ("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 1024, 513, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None), ("document", "t", "c.pdf", None, None, None, 3),
        ("video", None, "d.mp4", None, None, None, None), ("text", None, None, None, None, None, None), None,
    ]
    (row,) = chat_format.format_chats(chats(spark, [(1, 0, "assistant", parts)])).collect()
    assert "see <\\|image|> <|image|><|audio|><|document|><|other|><|end|>" in row.formatted
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, "image", "a.png", 85 + 4 * 170), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 2250), (0, "other", "d.mp4", 0)
    ]
    assert row.expanded_tokens == 85 + 680 + 38 + 2250


def test_nulls_ties_and_order_of_turns(spark):
    rows = [(1, 300, "user", text("c")), (1, None, "user", None), (1, 2, "b", text("y")), (1, 2, "b", text("x")), (1, 2, None, text(None)),
            (None, 1, "assistant", text("n")), (None, 0, "user", text("m"))]
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(chats(spark, rows))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("", ""), ("b", "x"), ("b", "y"), ("user", "c")]
    assert got[None].loss_text == "n" and [t.text for t in got[None].turns] == ["m", "n"]
    assert chat_format.parse_chats(chat_format.format_chats(chats(spark, []))).isEmpty()


def test_templates_that_can_not_be_escaped_are_refused():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(controls=("<|", "\\x"))
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(begin="turn:")


# -- line dedup ----------------------------------------------------------------------------------


def test_frequent_lines_go_and_the_rest_keeps_its_place(odd, empty):
    docs = odd("x\n Keep \nA b\nlast", "\tX \n\nkeep", "x", None, "", "x\nx", ids=[1, 2, 3, 4, 5, None])
    out = line_dedup.drop_frequent_lines(docs, min_docs=4)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.key) for r in out.collect()), key=repr)
    assert got == sorted(
        [(1, " Keep \nA b\nlast", 4, 1, "k"), (2, "\nkeep", 3, 1, "k"), (3, "", 1, 1, "k"), (4, "", 1, 0, "k"), (5, "", 1, 0, "k"), (None, "", 2, 2, "k")],
        key=repr,
    )
    assert line_dedup.drop_frequent_lines(empty, min_docs=2).isEmpty()


def test_repeated_rows_count_as_documents(odd):
    out = line_dedup.drop_frequent_lines(odd("a\nb", "a\nb", "a", ids=[1, 1, 2]), min_docs=2)
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == [(1, "", 2), (1, "", 2), (2, "", 1)]
    out = line_dedup.drop_frequent_lines(odd("a\nbb", "a\nbb"), min_docs=2, min_chars=2)
    assert [r.text for r in out.collect()] == ["a", "a"]


# -- quality rules -------------------------------------------------------------------------------

PROSE = " ".join(f"word{i}" for i in range(40))


def repeats(words, window=8):
    places = {}
    for i in range(len(words) - window + 1):
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def test_features_against_plain_python(odd):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a  b\x0bc", PROSE, "x " * 50, "a\n a\na\n\na", "# $ | <b>", *(
        " ".join(rnd.choice("abc") for _ in range(rnd.randint(5, 60))) for _ in range(40)
    )]
    for r in quality.with_features(odd(*texts)).collect():
        t = r.text or ""
        words, lines = t.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" "), t.split("\n")
        words = [w for w in words if w]
        lines = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
        assert r.n_repeat_words == repeats(words), t


def test_order_of_rules_changes_no_verdict(odd, empty):
    docs = odd(PROSE, "short", None, "y " * 60, PROSE + " # | $ % & * < >", "a\n" * 30 + PROSE)
    want = [True, False, False, False, False, False]
    for rules in (quality.RULES, quality.RULES[::-1]):
        out = quality.cascade(docs, rules=rules)
        assert [r.kept for r in out.orderBy("doc_id").collect()] == want
        assert out.columns == [*docs.columns, "kept", "rejected_by"]
        measured = quality.cascade(quality.with_features(docs), rules=rules, measured=quality.FEATURES)
        assert [r.kept for r in measured.orderBy("doc_id").collect()] == want
    assert quality.cascade(empty).isEmpty()


def test_cheap_and_selective_rules_run_first(odd):
    docs = odd(*[PROSE + " # | $ % & * < >"] * 9, PROSE)
    names = [r.name for r in quality.order_rules(docs, "text", quality.RULES)]
    assert names[0] == "symbols" and names[-1] != "symbols"
    assert [r.name for r in quality.order_rules(docs.limit(0), "text", quality.RULES)] == [r.name for r in quality.RULES]


def test_costs_are_measured_and_set_the_order(spark, odd, monkeypatch):
    docs = odd(*[PROSE + " # | $ % & * < >", "short"] * 5, *[PROSE] * 10)
    monkeypatch.setattr(quality, "feature_costs", lambda sample, text, names: dict.fromkeys(names, 1.0) | {"n_words": 50.0})
    names = [r.name for r in quality.order_rules(docs, "text", quality.RULES[:1] + quality.RULES[3:4])]
    # both need the words; the symbols cost more on top, and half of their rejections are as many
    assert names == ["few_words", "symbols"]
    monkeypatch.undo()
    costs = quality.feature_costs(odd(*[PROSE * 40] * 200).select("text").repartition(1), "text", ["n_symbols", "n_repeat_words"])
    assert costs["n_repeat_words"] > costs["n_symbols"] >= quality.LEAST_COST


def test_the_sample_computes_no_feature_of_all_rows(odd, monkeypatch):
    docs, seen = odd(PROSE, "short"), []
    whole = quality.order_rules
    monkeypatch.setattr(quality, "order_rules", lambda d, *a: seen.append(d) or whole(d, *a))
    quality.cascade(quality.with_features(docs), measured=quality.FEATURES, sample_of=docs)
    assert seen == [docs]


# -- token files ---------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    encoder = token_files.WordEncoder(tokenizer_path())
    for t in ["", "Don't DON'T it's.,?! 12a3", "H̱ t̂ ẖ J̌", "<|ENDOFTEXT|> <|endoftext|>x", "a b　c \x1c d", "ΣΑΣ İst", "日本 語\x85", "x" * 5000]:
        assert encoder.check(t), t


def test_files_hold_ascending_ranges_and_are_pruned(spark, odd, tmp_path):
    docs = odd(*[f"word{i} and more" for i in range(300)], None, "", ids=[*range(300, 0, -1), None, 0])
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, tokenizer_path(), files=4)
    rows = token_files.with_starts(spark, path).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.doc_id for r in rows] == [None, *range(301)]
    at = 0
    for r in rows:
        assert r.start == at and r.ids[-1] == 1
        at += len(r.ids)
    assert rows[0].ids == rows[1].ids == [1]
    spans = token_files.read_tokens(spark, path).groupBy("file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("file").collect()
    assert len(spans) == 4 and all(x.z < y.a for x, y in zip(spans, spans[1:]))
    plan = token_files.read_tokens(spark, path).where("doc_id = 7")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(doc_id,7)" in plan


def test_thousands_of_files_written_twice(spark, tmp_path):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs.where("doc_id < 50"), path, tokenizer_path(), files=3)
    token_files.write_tokens(docs.where("doc_id % 100 = 0"), path, tokenizer_path(), files=3_000)
    rows = token_files.with_starts(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(0, 4_000, 100)) and [r.start for r in rows] == [sum(len(x.ids) for x in rows[:i]) for i in range(40)]
    assert len(token_files._bounds(docs, 3_000)) > 2_500


def test_documents_of_one_id_share_a_file(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd("b c d", "a", "a", "x", ids=[5, 5, 5, 6]), path, tokenizer_path(), files=4)
    rows = token_files.with_starts(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [5, 5, 5, 6] and len({r.file for r in rows[:3]}) == 1 and rows[0].ids == rows[1].ids


def test_token_files_of_no_documents(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(empty, path, tokenizer_path())
    assert token_files.with_starts(spark, path).isEmpty()


# -- SentencePiece -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """The pieces of the given file as a unigram model."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path_factory.mktemp("models") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def unigram(unigram_file):
    return sentencepiece_scan.Model(unigram_file)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_scan.Model(tokenizer_path(PIECES))


def test_best_paths_against_the_library(tmp_path):
    """The library's unigram search over the same pieces; barred scores are made ordinary, as it sums in single precision."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb2.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000)
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = sentencepiece_scan.Model(str(tmp_path / "unigram.model"))
    rnd = random.Random(1)
    words = [p.replace("▁", "") for p in list(model.piece)[:3000] if p.strip("▁")]
    for _ in range(300):
        t = "".join(rnd.choice(words) + rnd.choice(["", " ", ", "]) for _ in range(rnd.randint(1, 6)))
        assert list(array("I", model.encode(model.normal(t)))) == library.encode(t), t


def by_brute_force(model, text):
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.width), end):
            found = model.piece.get(text[start:end])
            score = found[1] if found else model.unknown_score if end - start == 1 else -np.inf
            if best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start)
    ends = [len(text)]
    while ends[-1]:
        ends.append(best[ends[-1]][1])
    return model.ids(text, ends[::-1])


ODD_TEXTS = ["", "  a  b ", "\n\n", "日本語テスト𝔘x", "é´̀", "the then\tthere. The", "supercalifragilistic" * 6, "a▁b", "x" * 90, " " * 70]


def test_units_are_what_the_whole_text_gives(unigram):
    for t in ODD_TEXTS:
        assert unigram.encode(unigram.normal(t)) == by_brute_force(unigram, unigram.normal(t)), t


@pytest.mark.parametrize("chunk, fan", [(16, 2), (23, 3), (40, 128)])
def test_chunks_give_the_same_ids(spark, odd, model, chunk, fan):
    texts = [None, *ODD_TEXTS, "the quick brown fox. " * 20, "nospaceatall" * 30]
    coded = sentencepiece_scan.encode(odd(*texts), tokenizer_path(PIECES), chunk_chars=chunk, fan=fan)
    back = {r.doc_id: r for r in sentencepiece_scan.decode(coded, tokenizer_path(PIECES)).collect()}
    assert len(back) == len(texts)
    for i, t in enumerate(texts):
        normal = model.normal(t or "")
        assert back[i].ids == list(array("I", model.encode(normal)))
        assert back[i].decoded == (t or "").replace("▁", " ")
        assert back[i].key == "k" and (back[i].n_chunks > 1) == (len(t or "") >= chunk)


def test_pieces_of_nothing_and_of_null(spark, empty):
    assert sentencepiece_scan.encode(empty, tokenizer_path(PIECES)).isEmpty()
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 13])], "n int, ids array<int>")
    assert [r.decoded for r in sentencepiece_scan.decode(rows, tokenizer_path(PIECES)).orderBy("n").collect()] == [None, "", " ⁇ \n"]
