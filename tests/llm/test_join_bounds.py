"""Bounds of the n-gram join, and what the pipeline keeps of its groups."""

import re

import corpus_pipeline
from runlens.llm import ngram_join

COUNTED = "c int, a_pos int, b_pos int, a_size int, b_size int, a_low int, a_high int, b_low int, b_high int"


def test_a_place_bounds_only_pairs_of_single_sets(spark, odd):
    """b = 100..179, x = 0..19 and b, x2 = x without 0..3 and 100..115: x and x2 are linked, and x and b.

    Of b's first 17 members x has one (100) among its own and x2 one (116), so the last place in b is 16, by x2.
    """
    b = set(range(100, 180))
    x = b | set(range(20))
    x2 = x - set(range(4)) - set(range(100, 116))
    first = {name: sorted(s)[: len(s) - -(-4 * len(s) // 5) + 1] for name, s in (("b", b), ("x", x), ("x2", x2))}
    assert len(x & x2) * 5 == len(x | x2) * 4 and len(x & b) * 5 == len(x | b) * 4
    met = [m for m in first["b"] if m in first["x"] or m in first["x2"]]
    rows = [(len(met), -1, first["b"].index(met[-1]), 2, 1, 80, 100, 80, 80), (2, 3, 16, 1, 1, 100, 100, 80, 80)]
    assert rows[0][:3] == (2, -1, 16)
    join = ngram_join.NgramJoin(odd("a"), "text", "doc_id", 5, (80, 100))
    got = spark.createDataFrame(rows, COUNTED).select(join._reachable().alias("r")).collect()
    # the single pair can share 2 + 63 members of the 80 it needs
    assert [r.r for r in got] == [True, False]


def test_one_document_of_a_group_stays_whatever_its_ids(spark, odd):
    """Tied ids, null ids, null and tied ids, other ids; each group has three near copies and an exact one of the first."""
    texts, ids = [None, "", " "], [1, 2, 2]
    for n, group in enumerate([[5, 5, 5], [None, None, None], [None, 7, 7], [8, 6, 9]]):
        body = " ".join(f"g{n}w{i}" for i in range(60))
        texts += [body, body + " more", "less " + body, body]
        ids += [*group, group[0]]
    docs = odd(*texts, ids=ids)
    rows = corpus_pipeline.join_near_duplicates(spark, docs, "").collect()
    kept = [(re.search(r"g(\d)w", r.text)[1], r.doc_id) for r in rows if (r.text or "").strip()]
    assert sorted(kept) == [("0", 5), ("1", None), ("2", 7), ("3", 6)]
    # documents without words stay
    assert sorted(r.doc_id for r in rows if not (r.text or "").strip()) == [1, 2, 2]
    assert set(rows[0].asDict()) == set(docs.columns)
