"""Lexical search, periodic runs and URL filters against brute force, and their odd cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runlens.llm import lexical_search as search
from runlens.llm import periodic_runs as periodic
from runlens.llm import queries as llm
from runlens.llm import url_filter

# --- lexical search


def by_brute_force(texts, items, k):
    """(item, rank, doc, score) of texts [(id, text)] and items [(id, text)]."""
    bags = [(i, Counter(search.terms_of((t or "").encode()))) for i, t in texts]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        asked, scored = Counter(search.terms_of((text or "").encode())), []
        for (doc, bag), n in zip(bags, sizes):
            if n:
                norm = 12 * (75 + 25 * n * n_docs // n_terms)
                score = sum(c * search.weight(n_docs, df[t]) * (10**9 * bag[t] // (1000 * bag[t] + norm)) for t, c in asked.items() if t in bag)
                if score > 0:
                    scored.append((-score, doc is None, doc))
        rows += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return rows


def some_texts(n, seed=3, topics=12):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    special = [[f"t{t}x{i}" for i in range(30)] for t in range(topics)]
    return [(i, " ".join(rnd.choice(special[i % topics] if rnd.random() < 0.6 else words) for _ in range(rnd.randint(3, 40)))) for i in range(n)]


@pytest.mark.parametrize("k, block, segment", [(5, 8, 64), (3, 2, 2048), (20, 8, 200)])
def test_search_equals_scoring_all(spark, monkeypatch, k, block, segment):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(search, "SAMPLE_DOCS", 50)
    texts = some_texts(700)
    items = [(i, t) for i, t in some_texts(9, seed=8)] + [(90, ""), (91, None), (92, "nowhere"), (92, "w1 w1 W1, w2"), (92, "w1 w1 W1, w2")]
    got = search.top_k(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert sorted(map(tuple, got.collect())) == sorted(by_brute_force(texts, items, k))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_of_odd_documents(spark, odd, empty):
    long = "many words " * 30_000 + "rare"
    texts = [None, "", " \n.,;", "rare word", "rare word", "É é rare", long, "Rare\x00WORD rare", "none"]
    ids = [1, 2, 3, 5, 4, None, 6, None, 7]
    docs = odd(*texts, ids=ids).withColumnRenamed("key", "item").withColumn("rank", F.lit(0)).withColumn("score", F.lit(1))
    items = spark.createDataFrame([(None, "rare"), (2, "rare É"), (3, "é"), (4, "none word")], "item_id bigint, text string")
    want = by_brute_force(list(zip(ids, texts)), [tuple(r) for r in items.collect()], 4)
    got = list(map(tuple, search.top_k(docs, items, 4).collect()))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert search.top_k(empty, items).isEmpty() and search.top_k(docs, items.limit(0)).isEmpty()


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 300)
    texts, items = some_texts(120), some_texts(9, seed=8)
    got = search.top_k(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(by_brute_force(texts, items, 5))


def test_blocks_are_skipped(spark):
    """On documents of several topics most blocks fall to their maxima, and few documents are scored."""
    texts, items = some_texts(2000), search.Items([t.encode() for _, t in some_texts(12, seed=8)])
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    send = spark.sparkContext.broadcast
    held = search.vectors(docs, send(items), "text", "doc_id").coalesce(1)
    totals = {r.term: r.n for r in search._totals(held).collect()}
    items.weigh(totals[-1], totals[-2], np.array([totals.get(i, 0) for i in range(len(items.number))], np.int64))
    want = by_brute_force(texts, list(enumerate(t.decode() for t in items.texts)), 10)
    bars = np.array([min(s for i, _, _, s in want if i == item) for item in range(len(items.texts))])
    segment = {k: np.array(v) for k, v in search.index_segments(held, send(items), bars).first().asDict().items()}
    looked = search.Looked()
    search.search_segment(items, segment, bars, 10, looked)
    assert looked.skipped > 0.25 * looked.blocks and looked.scored < 0.1 * len(texts) * len(items.texts)


def test_segments_are_read_a_few_at_a_time(spark, monkeypatch):
    """A task that searches holds row groups of bounded size, whose segments stay compressed outside of Python."""
    monkeypatch.setattr(search, "PACKED_GROUP", 1)
    items = search.Items([t.encode() for _, t in some_texts(5, seed=8)])
    held = search.vectors(spark.createDataFrame(some_texts(640), "doc_id bigint, text string"), spark.sparkContext.broadcast(items), "text", "doc_id")
    items.weigh(640, 12_000, np.full(len(items.number), 9))
    sent, bars = spark.sparkContext.broadcast(items), np.ones(5, np.int64)
    held = held.repartition(10, "doc_id")
    plain = search.index_segments(held, sent, bars).collect()
    kept = search._segment_table(search.index_segments(held, sent, bars, packed=True).coalesce(1))
    assert len(plain) == kept.count() == 10
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept.inputFiles()]
    assert all(g.num_row_groups == g.num_rows for g in groups)
    found = {tuple(r.doc_ids): search.unpack(pa.scalar(bytes(r.body), pa.binary())) for r in kept.collect()}
    for r in plain:
        assert all(np.array_equal(found[tuple(r.doc_ids)][c], r[c]) for c in r.asDict())


# --- periodic runs


def runs_by_brute_force(w, lo, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(lo, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_all_periods(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(600):
        w = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 70))]
        if w and rnd.random() < 0.6:
            a = rnd.randrange(len(w))
            p = 1 + rnd.randrange((len(w) - a) // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        texts.append(rnd.choice([" ", "\n", "\t \x0b"]).join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in periodic.periodic_runs(docs).withColumn("best", periodic.strongest(F.col("runs"))).collect():
        w = texts[r.doc_id].split()
        want = runs_by_brute_force(w, 6, 4)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapse(w, want) and r.n_words == len(w)
        best = None
        for s, n, q in want:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        assert (tuple(r.best) if r.best else None) == best


def test_runs_of_odd_texts(spark, odd, empty, monkeypatch):
    texts = [None, "", "  ", "x " * 200_000, "a b\u00a0c " * 5, "a b\u00a0c " * 5, "one two", "p q r s t u v w " * 9_000 + "end"]
    docs = odd(*texts).withColumnRenamed("body", "runs").withColumnRenamed("key", "n_words")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [list(map(tuple, got[i].runs)) for i in range(8)] == [[], [], [], [(0, 200_000, 1)], [(0, 10, 2)], [(0, 10, 2)], [], [(0, 72_000, 8)]]
    assert [got[i].collapsed for i in (0, 3, 4, 6, 7)] == ["", "x", "a b\u00a0c", "one two", "p q r s t u v w end"]
    assert got[5].source == "s" and got[5].n == 7
    assert periodic.periodic_runs(empty).isEmpty()
    monkeypatch.setattr(periodic, "KNOWN_WORDS", 1)
    monkeypatch.setattr(periodic, "TEXT_BYTES", 10)
    assert {r.doc_id: r.runs for r in periodic.periodic_runs(docs).collect()} == {i: r.runs for i, r in got.items()}
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=3)


def test_names_that_fill_no_single_integer():
    w = np.array([0, 1, 2] * 4 + [3], np.int64)
    ends = np.full(len(w), len(w))
    assert periodic.find_runs(w << 58, ends, 6, 4).tolist() == [[0, 12, 3]]


# --- URL filters

URLS = [
    None, "", "no scheme example.org/", "https://", "https:///es/x", "https://EXAMPLE.org", "https://example.org/", "http://a.b.Example.ORG/es/1?q",
    "http://badexample.org/es/", "http://example.org/en/17#x", "http://example.org/en/27", "http://example.com/fr", "http://x.com/fr/?a",
    "http://x.com/de/a/b", "http://x.net/de/", "x://y://example.org/es/", "http://com/de/", "http://org./", "http://x.com?/de/", "http://é.org/\n/",
    "http://example.org:80/es/",
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


MORE_RULES = [*llm.URL_RULES, ("example.org", "", "block"), ("net", "/d", "allow"), ("net", "/d", "block"), ("", "/", "block"), ("a.b.example.org", "/es/1", "allow")]


@pytest.mark.parametrize("rules", [llm.URL_RULES, MORE_RULES])
@pytest.mark.parametrize("max_rows", [1000, 0])
def test_verdicts_equal_trying_all_rules(spark, rules, max_rows):
    schema = "host string, path string, verdict string"
    frame = spark.createDataFrame([*rules, *rules[:2], (None, "/", "block"), ("net", None, "block"), ("net", "/", None)], schema)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id bigint, url string")
    got = url_filter.judge(pages, frame, max_rows=max_rows).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == [(i, *judged(u, rules)) for i, u in enumerate(URLS * 2)]


def test_url_filter_of_odd_tables(spark):
    rules = spark.createDataFrame(llm.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([("h", 1, "http://x.com/de/" + "y" * 100_000), ("h", 1, None)] * 2, "host string, prefix int, url string")
    got = url_filter.judge(pages, rules)
    assert got.columns == ["prefix", "url", "host", "path", "rule", "verdict"]
    assert sorted(r.verdict for r in got.collect()) == ["allow", "allow", "block", "block"]
    assert url_filter.judge(pages.limit(0), rules).isEmpty()
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_equal_hash_prefixes_are_told_apart(spark, monkeypatch):
    """With a prefix of no bytes all expressions meet all rules; whole digests decide."""
    monkeypatch.setattr(url_filter, "PREFIX_BYTES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = spark.createDataFrame(llm.URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == [(i, *judged(u, llm.URL_RULES)) for i, u in enumerate(URLS)]
