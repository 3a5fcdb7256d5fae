"""N-gram join, token rollups, cover-tree search, mixing, suffix dedup and the pipeline: small cases and brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import cover_tree, fair_mix, ngram_join, suffix_dedup
from runlens.llm.common import table
from runlens.llm.components import components
from runlens.llm.induced_sorting import repeated_starts, suffix_array
from runlens.llm.token_rollup import TokenRollup

# -- n-gram join -----------------------------------------------------------------------------------


def grams(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(texts):
    sets, label = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(rnd, n, edits, size=120):
    """Copies of one text, each with some words changed."""
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(size)] = f"e{rnd.randint(0, 30)}"
        yield " ".join(words)


@pytest.mark.parametrize("frequent, block", [(16, 256), (3, 8)])
def test_components_equal_those_of_all_pairs(odd, monkeypatch, frequent, block):
    """Families on both sides of the threshold, chains through members, shared passages, and odd texts."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(frequent)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " \n", "One two", "one TWO", "one two three", *family(rnd, 40, 5), *family(rnd, 25, 3, 60)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):  # each one is like the next, the ends are not alike
        chain[i * 8] = f"d{i}"
        texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(f"q{rnd.random()}" for _ in range(rnd.randint(5, 40))) for _ in range(20)]
    texts += [texts[8], texts[8].upper()]
    out = ngram_join.jaccard_components(odd(*texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.key) for r in out.collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == [(*w, "k") for w in want]


def test_join_without_rows_and_with_null_or_repeated_ids(odd, empty):
    assert ngram_join.jaccard_components(empty).isEmpty()
    long = " ".join(f"w{i}" for i in range(30))
    out = ngram_join.jaccard_components(odd(long, long, long + " x", "alone", None, ids=[None, 5, 5, None, 3]))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)
    assert got == sorted([(None, 26, 5), (5, 26, 5), (5, 27, 5), (None, 1, None), (3, 0, 3)], key=repr)


def test_classes_that_share_their_number(odd, monkeypatch):
    """Numbers of three values only: what is left of the hash tells the classes apart."""

    def poor(members):
        return len(members) % 3, xxhash.xxh3_64_intdigest(members.tobytes()) - 2**63

    monkeypatch.setattr(ngram_join, "node_of", poor)
    rnd = random.Random(5)
    texts = [None, "a b", *family(rnd, 12, 4), *family(rnd, 6, 2, 50), "a B", *[f"x{i} y z u v w" for i in range(9)]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_class_numbers_are_halves_of_one_hash():
    members = ngram_join.shingles(b"one two three four five six seven")
    low, high = ngram_join.node_of(members)
    assert (high + 2**63) * 2**64 + low + 2**63 == xxhash.xxh3_128_intdigest(members.tobytes())


def test_components_of_a_long_chain(spark, rows):
    edges = spark.range(1, 60).select((F.col("id") * 7 % 61).alias("x"), ((F.col("id") + 1) * 7 % 61).alias("y"))
    assert rows(components(edges).select("label").distinct()) == [(1,)]
    assert components(edges.limit(0)).isEmpty()


# -- token rollups ---------------------------------------------------------------------------------

CHANGE = "op string, seq int, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"


def test_deltas_add_up_to_a_recount(spark, tmp_path):
    rnd, state, rollup = random.Random(2), {}, TokenRollup(spark, str(tmp_path / "rollup"))
    for batch in range(1, 5):
        changes = []
        for seq in range(60):
            op = rnd.choice(["insert", "revise", "delete"])
            key = (rnd.randint(1, 25), rnd.choice(["t1", "t2"]))
            value = (rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([rnd.randint(0, 99), None]))
            changes.append((op, seq, key[0], value[0], value[1], key[1], value[2]))
        for op, _, doc, source, lang, tok, n in dict(((c[2], c[5]), c) for c in changes).values():
            if op == "delete":
                state.pop((doc, tok), None)
            else:
                state[doc, tok] = (source, lang, n or 0)
        frame = spark.createDataFrame(changes, CHANGE)
        assert rollup.commit(batch, frame) and not rollup.commit(batch, frame)
    want, docs = Counter(), Counter()
    for (_, tok), (source, lang, n) in state.items():
        want[source, lang, tok] += n
        docs[source, lang, tok] += 1
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got == {k: (docs[k], want[k]) for k in docs}
    with pytest.raises(ValueError):
        rollup.commit(0, frame)


def test_rollups_of_nothing_and_cut_short_batches(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().isEmpty() and rollup.committed() == []
    nothing = spark.createDataFrame([("insert", 0, None, "s", "en", "t", 5), ("delete", 0, 1, "s", "en", "t", None), ("odd", 0, 1, "s", "en", "t", 1)], CHANGE)
    assert rollup.commit(1, nothing) and rollup.totals().isEmpty()
    one = spark.createDataFrame([("insert", 0, 1, "s", "en", "t", 5)], CHANGE)
    rollup._write(2, one)  # a batch whose commit got lost is written again
    (tmp_path / "rollup" / "commits" / "batch=2" / "_SUCCESS").unlink()
    assert rollup.committed() == [1] and rollup.commit(2, one)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 1, 5)]


# -- cover-tree search -------------------------------------------------------------------------------


def test_search_equals_all_scores():
    rnd = np.random.default_rng(4)
    for n, k in ((1, 3), (40, 5), (700, 5)):
        points = np.floor(rnd.normal(size=(n, 6)) * 20)
        points[: n // 3] = points[0]  # a third are copies
        ids = rnd.permutation(n).astype(np.int64)
        search = cover_tree.Search(ids, points, k)
        for at in range(0, n, 150):
            search.add(ids[at : at + 150], points[at : at + 150])
        row, found, score = search.results()
        got = {i: sorted((-s, f) for r, f, s in zip(row, found, score) if r == i) for i in range(n)}
        scores = points @ points.T
        for i in range(n):
            assert got[i] == sorted((-scores[i, j], ids[j]) for j in range(n) if j != i)[:k]


def test_tree_covers_and_prunes():
    points = np.concatenate([np.random.default_rng(1).normal(c * 100, 1, (400, 4)) for c in range(4)])
    tree = cover_tree.CoverTree(points)
    stack, nodes = [tree.root], 0
    while stack:
        node = stack.pop()
        nodes += 1
        inside = tree.points[node.low : node.high]
        assert np.sqrt(((inside - node.center) ** 2).sum(1)).max() <= node.radius + 1e-9
        stack += node.children
    assert nodes > 4 and sorted(tree.order) == list(range(1600))


def test_clustered_vectors_are_mostly_not_scored(monkeypatch):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(0, 1, (40, 16))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    points = np.floor(np.repeat(centres, 200, axis=0) + rnd.normal(0, 4, (8000, 16)))
    rnd.shuffle(points)
    ids, scored = np.arange(8000), []
    score = cover_tree.Search._score

    def counting(self, q_low, q_high, data, ids, d_low, d_high):
        scored.append((q_high - q_low) * (d_high - d_low))
        return score(self, q_low, q_high, data, ids, d_low, d_high)

    monkeypatch.setattr(cover_tree.Search, "_score", counting)
    search = cover_tree.Search(ids[::20], points[::20], 5)
    for at in range(0, 8000, 4096):
        search.add(ids[at : at + 4096], points[at : at + 4096])
    row, found, got = search.results()
    assert sum(scored) < 0.5 * 400 * 8000
    for q in range(400):
        s = points @ points[q * 20]
        s[q * 20] = -np.inf
        want = sorted(zip(-s, ids))[:5]
        assert sorted((-g, f) for g, f in zip(got[row == q], found[row == q])) == want


def test_vectors_that_take_no_part_and_waves(spark, rows):
    data = [(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 9.0]),
            (9, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [5.0, 5.0])]
    usable = cover_tree.usable(spark.createDataFrame(data, "vec_id bigint, e array<float>"), "vec_id", "e")
    for waves in (65_536, 2):
        found = cover_tree.top_k(usable, usable.where("id in (1, 7, 9)"), k=4, wave_rows=waves)
        got = rows(found, "query_id", "rank", "vec_id", "score")
        assert got == sorted([(1, 1, 8, 5.0), (1, 2, 9, 5.0), (1, 3, 9, 5.0), (1, 4, 2, 3.0), *((7, i + 1, v, 0.0) for i, v in enumerate([1, 2, 8, 9])),
                              (9, 1, 1, 5.0), (9, 2, 8, 5.0), (9, 3, 2, 3.0), (9, 4, 7, 0.0)], key=repr)
    assert cover_tree.top_k(usable.limit(0), usable.limit(0)).isEmpty()


def test_a_seed_sample_changes_nothing(spark, rows):
    frame = spark.range(600).select("id", F.array(*[(F.hash("id", F.lit(i)) % 50).cast("double") for i in range(5)]).alias("v"))
    asked = frame.where("id % 20 = 0")
    assert rows(cover_tree.top_k(frame, asked, seed_rows=100)) == rows(cover_tree.top_k(frame, asked))


# -- mixing ------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and total and left * weight[s] / total > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / total for s in order}
        for s in over:
            full.add(s)
            left -= most * sizes[s]


def test_targets_and_shares(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choices(["a", "b", "c", "Z", None, "é"], [50, 5, 30, 3, 8, 4])[0]) for i in range(900)]
    rows += [(None, None, "a"), (7, "w w w", "b"), (7, "w w w", "b"), (1000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    out = fair_mix.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = plain_targets(sizes, (5, 2, 1)), Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2 * 40, source
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = fair_mix.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in again) == Counter((r.doc_id, r.source, r.size, r.taken) for r in out)
    mixed = fair_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(fair_mix.word_count())).first()[0] == sum(taken.values())


def test_mixing_nothing(spark, empty, odd):
    assert fair_mix.mix(empty).isEmpty() and fair_mix.mixed_documents(empty).isEmpty()
    assert [r.taken for r in fair_mix.mix(odd(None, "")).collect()] == [0, 0]


def test_chunks_of_a_large_source_add_up(odd, monkeypatch):
    docs = odd(*["w " * (i % 9) for i in range(300)])
    want = {r.doc_id: r.taken for r in fair_mix.mix(docs).collect()}
    monkeypatch.setattr(fair_mix, "CHUNK_ROWS", 5)
    assert {r.doc_id: r.taken for r in fair_mix.mix(docs).collect()} == want


# -- suffix dedup ------------------------------------------------------------------------------------


def test_suffix_arrays_equal_sorted_suffixes():
    rnd = random.Random(1)
    for _ in range(150):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(1, 120))]
        assert suffix_array(np.array(s), 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert len(suffix_array(np.array([], np.int32), 5)) == 0


@pytest.mark.parametrize("length", [3, 8, 12])
def test_common_prefixes(length):
    rnd = random.Random(length)
    for _ in range(60):
        raw = bytes(rnd.choice(b"ab") for _ in range(60)) + b"\0" * 8
        valid = np.arange(len(raw)) <= 60 - length
        got = repeated_starts(raw, suffix_array(np.frombuffer(raw, np.uint8).astype(np.int32) + 1, length), valid, length)
        seen = Counter(raw[i : i + length] for i in np.flatnonzero(valid))
        assert [seen[raw[i : i + length]] > 1 for i in np.flatnonzero(valid)] == got[valid].tolist()


def removed(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [2048, 2])
def test_every_repeat_goes_and_nothing_else(odd, group):
    rnd = random.Random(group)
    noise = lambda n: "".join(rnd.choice("abcdefgh äß") for _ in range(n))
    passage, other = noise(150), noise(70)
    texts = [None, "", noise(30), noise(400), "a" * 300, "ab" * 200, noise(90) * 3]
    texts += [noise(rnd.randint(0, 80)) + passage + noise(rnd.randint(0, 80)) for _ in range(25)]
    texts += [noise(20) + other[: rnd.randint(40, 70)] + noise(20) for _ in range(12)]
    texts += [texts[10], texts[11], "z" + texts[12]]
    docs = odd(*texts)
    out = suffix_dedup.remove_repeats(docs, length=64, group_segments=group)
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 64)


def test_long_runs_of_one_byte(odd):
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    left, right = noise(40), noise(40)
    texts = [" " * n for n in (39, 40, 41, 80, 81, 500)]
    texts += [left + " " * 100 + right, left + " " * 700 + right, noise(30) + "x" * 81 + "y" * 300 + noise(30), left[-20:] + " " * 19 + noise(20)]
    texts += [noise(50) + "z" * 40 + noise(50), "\u20ac" * 200, left[-5:] + " " * 90 + noise(9) + " " * 200 + right[:7]]
    out = suffix_dedup.remove_repeats(odd(*texts), length=40).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}
    assert [got[i] for i in range(len(texts))] == removed(texts, 40)


def test_a_run_of_fifty_megabytes_is_cheap():
    body = b"head" + b" " * (50 << 20) + b"tail"
    started = time.perf_counter()
    short, starts, excess = suffix_dedup.squeezed(body, 200)
    assert (short, starts.tolist(), excess.tolist()) == (b"head" + b" " * 400 + b"tail", [4], [(50 << 20) - 400])
    assert suffix_dedup._cut(body, [{"first": 4, "count": 201}], 200) == (len(body), 50 << 20, 1, b"headtail")
    assert time.perf_counter() - started < 20


def test_repeated_rows_and_no_rows(odd, empty):
    texts = ["x".join(str(i) for i in range(60))] * 2
    out = suffix_dedup.remove_repeats(odd(*texts, ids=[4, 4]), length=40).collect()
    assert [(r.n_removed, bytes(r.kept)) for r in out] == [(len(texts[0]), b"")] * 2
    assert suffix_dedup.remove_repeats(empty).isEmpty()
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty, length=16)


# -- pipeline ------------------------------------------------------------------------------------------


def test_stages_work_on_what_was_kept(spark, odd):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    body = lambda n=60: " ".join(rnd.sample(words, n))
    texts = [body() + "\nterms of use" for _ in range(30)]
    texts += [texts[0].replace("\n", "\n\n"), texts[1] + " more", "too short", None, "# | $ " * 40]
    docs = odd(*texts).select("doc_id", "text", "lang", "source", F.lit(0).cast("bigint").alias("n_chars"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, ""), "stage")
        kept.append(docs)
    assert [d.columns for d in kept] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert sorted(r.doc_id for r in kept[0].collect()) == list(range(32))
    assert all("terms of use" not in r.text.split("\n") and r.n_chars == len(r.text) for r in kept[1].collect())
    assert sorted(r.doc_id for r in kept[2].collect()) == list(range(30))
    times = Counter(r.doc_id for r in kept[3].collect())
    assert set(times.values()) <= {1, 2} and sum(times.values()) in (44, 45)
    last = corpus_pipeline.STAGES[-1][1](spark, kept[3], "").collect()
    assert Counter(r.doc_id for r in last) == times and all(r.n_tokens == len(r.ids) > 0 for r in last)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_rows_without_ids_are_shuffled_by_their_texts(spark, monkeypatch):
    """A third of the rows and more without an id, or of one id, fill many chunks, not one."""
    monkeypatch.setattr(fair_mix, "CHUNK_ROWS", 100)
    n = 6_000
    docs = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, F.lit(7).cast("long"))).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"),
    )
    sizes = docs.select(F.lit("k").alias("key"), "doc_id", "source", F.lit(3).cast("long").alias("size"), fair_mix._shuffled("mix", "text", "doc_id").alias("shuffled"))
    parts = sizes.groupBy(F.substring("shuffled", 1, 2)).count().collect()
    assert len(parts) > 200 and max(r["count"] for r in parts) < 100
    out = fair_mix.mix(docs)
    assert out.count() == n and out.agg(F.sum("taken")).first()[0] <= 1.5 * 3 * n
    three = fair_mix.mix(docs, copies=3, share=2.5)
    assert three.agg(F.max("target")).first()[0] == 2.5 * 3 * n and {r.copies for r in three.collect()} == {2, 3}
