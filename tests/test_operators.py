import collections
import gzip
import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from runlens.operators import aggregates as agg
from runlens.operators import config, datagen, design, graph, ordering
from runlens.sources import datasets, files, text_sinks
from test_functions import draw


def table(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


# -- aggregates ----------------------------------------------------------------------------------


def test_word_count_tokens(spark, rows):
    lines = table(spark, "line string", (" a b ",), ("",), (" ",), ("a,B",), ("--",), ("c--",))
    assert rows(agg.word_count(lines)) == [("", 2), ("a", 2), ("b", 2), ("c", 1)]


def test_longest_and_largest(spark, rows):
    pairs = table(spark, "k bigint, v string", (1, "b"), (1, "aaa"), (2, "z"))
    assert rows(agg.max_length_per_key(pairs)) == [(1, 3), (2, 1)]
    assert rows(agg.max_value_per_key(pairs)) == [(1, "b"), (2, "z")]


def test_hash_and_sort_plans(spark):
    pairs = table(spark, "k bigint, v string", (1, "b"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan(agg.max_length_per_key(pairs))
    assert "SortAggregate" in plan(agg.max_value_per_key(pairs))


def hot_values(n=3000):
    """A third of all rows belong to key 0; values repeat and are skewed."""
    rng = random.Random(7)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), int(rng.expovariate(0.001)) // 7) for i in range(n)]


@pytest.mark.parametrize("max_group, buckets", [(1_000_000, 1000), (100, 1000), (1, 1000), (1, 2)])
def test_median_against_brute_force(spark, monkeypatch, max_group, buckets):
    """Plain, mixed and narrowed down; with two buckets it takes many steps."""
    monkeypatch.setattr(agg, "BUCKETS", buckets)
    data = hot_values()
    df = table(spark, "k bigint, v bigint", *data).unionByName(table(spark, "k bigint, v bigint", (None, 4), (None, 6), (99, None)))
    groups = collections.defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    want = {k: float(statistics.median(v)) for k, v in groups.items()} | {None: 5.0}
    got = {r.k: r.median for r in agg.exact_median(df, ["k"], "v", max_group=max_group).collect()}
    assert got == want


def test_reduce_against_brute_force(spark):
    data = hot_values()
    got = {r.k: r.v for r in agg.reduce_per_key(table(spark, "k bigint, v bigint", *data), "k", "v", lambda a, b: a + b, salts=4).collect()}
    want = collections.Counter()
    for k, v in data:
        want[k] += v
    assert got == dict(want)


def test_markers(spark, rows):
    lines = table(spark, "file string, value string", ("a", "Registering x"), ("a", "no"), ("b", "Registering up"), ("b", "up"))
    assert rows(agg.marker_counts(lines, ["Registering", "up"])) == [("a", "Registering", 1), ("b", "Registering", 1), ("b", "up", 2)]


# -- order ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("cut", ["key", "range"])
def test_positions_across_chunks(spark, cut):
    data = [(0 if i % 3 == 0 else i % 5, i) for i in range(500)]
    df = table(spark, "g bigint, i bigint", *data).repartition(5)
    chunked = ordering.by_key(df, "i", 16) if cut == "key" else ordering.by_range(df, ["g", "i"], 6)
    got = {(r.g, r.i): r.pos for r in ordering.position_within(chunked, ["g"], ["i"]).collect()}
    seen, want = collections.Counter(), {}
    for g, i in data:
        seen[g] += 1
        want[g, i] = seen[g]
    assert got == want


def test_collapse_across_chunks(spark, rows):
    rng = random.Random(3)
    data = [(i, rng.choice("aab") if i % 50 < 40 else None) for i in range(300)]
    chunked = ordering.by_key(table(spark, "i bigint, v string", *data), "i", 8)
    want = [p for q, p in zip([(None, "start")] + data, data) if q[1] != p[1]]
    assert sorted(rows(ordering.collapse_consecutive(chunked, "v", ["i"]))) == sorted(want)


def test_forward_fill(spark, rows):
    cells = table(spark, "f string, i int, c string", *[("x", i, c) for i, c in enumerate(["", "a", "", "", "b", ""])])
    assert rows(ordering.forward_fill(cells, ["f"], "i", "c", "n"), "i", "n") == [(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")]


# -- generated data ------------------------------------------------------------------------------


def word(index, seed=0xC00FFEE):
    position = index * 27
    length = math.floor(draw(seed, position) * 13) + 2
    return "".join(chr(97 + math.floor(draw(seed, position + 1 + i) * 26)) for i in range(length))


def test_dictionary(spark):
    got = [r.word for r in datagen.dictionary(spark, 300).orderBy("index").collect()]
    assert got == [word(i) for i in range(300)]
    assert {len(w) for w in got} == set(range(2, 15))


def cdf(distribution, k, parameter):
    if distribution == "zipf":
        w = [(i + 1) ** -parameter for i in range(k)]
    else:
        n = k - 1
        w = [math.comb(n, i) * parameter**i * (1 - parameter) ** (n - i) for i in range(k)]
    out, total = [], 0.0
    for x in w:
        total += x
        out.append(total)
    return [x / total for x in out]


@pytest.mark.parametrize("distribution, parameter", [("zipf", 1.0), ("zipf", 0.3), ("binomial", 0.5), ("binomial", 0.02)])
def test_inverse_cdf(spark, distribution, parameter):
    k, n = 200, 4000
    rows = datagen.with_distribution(
        datagen.with_uniform(spark.range(n), F.col("id"), "u"), k, distribution, parameter
    ).collect()
    table_ = cdf(distribution, k, parameter)
    assert len(rows) == n
    for r in rows:
        i = r["index"]
        assert table_[i] >= r.u - 1e-12 and (i == 0 or table_[i - 1] < r.u + 1e-12)


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_binomial_without_choice(spark, p):
    df = datagen.with_distribution(datagen.with_uniform(spark.range(50), F.col("id"), "u"), 10, "binomial", p)
    assert {r["index"] for r in df.collect()} == {9 if p else 0}


def test_generated_words_do_not_depend_on_tasks(spark, rows):
    one = rows(datagen.generate_words(spark, 1, 1200, 50, "zipf", 1.0).groupBy("word").count())
    many = rows(datagen.generate_words(spark, 6, 200, 50, "zipf", 1.0).groupBy("word").count())
    assert one == many and sum(n for _, n in one) == 1200
    first = draw(0xC00FFEE, 1)
    table_ = cdf("zipf", 50, 1.0)
    assert word(next(i for i, c in enumerate(table_) if c >= first)) in {w for w, _ in one}


def test_large_dictionaries_are_joined_by_shuffle(spark, rows, monkeypatch):
    small = rows(datagen.generate_words(spark, 2, 100, 50, "zipf", 1.0))
    monkeypatch.setattr(datagen, "MAX_TABLE", 10)
    assert rows(datagen.generate_words(spark, 2, 100, 50, "zipf", 1.0)) == small


def test_key_values(spark):
    rows = datagen.with_key_value(datagen.row_numbers(spark, 4, 500), "id", 40, values=100).collect()
    assert {r.k for r in rows} == set(range(40))
    assert {len(r.v) for r in rows} <= set(range(10, 21)) and len({r.v for r in rows}) <= 100
    with pytest.raises(ValueError):
        datagen.with_distribution(spark.range(1), 3, "normal")


# -- design --------------------------------------------------------------------------------------


def test_grids(spark):
    crossed = design.grid_crossed(spark, {"x": [1, 2], "y": ["a", "b"]}).orderBy("point")
    assert [(r.x, r.y) for r in crossed.collect()] == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert [(r.x, r.y) for r in design.grid_zipped(spark, {"x": [1, 2], "y": ["a", "b"]}).orderBy("point").collect()] == [(1, "a"), (2, "b")]
    assert [r.x for r in design.grid_simple(spark, "x", [3, 1]).orderBy("point").collect()] == [3, 1]
    for bad in ({"x": [1], "y": [1, 2]}, {"x": []}, {}):
        with pytest.raises(ValueError):
            design.grid_zipped(spark, bad)


def test_keys_that_cluster_are_cut_on_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 50)
    n = 1000
    even = spark.range(n).withColumn("k", F.col("id") * 7)
    dense = spark.range(n).withColumn("k", F.when(F.col("id") == 0, -(10**12)).otherwise(F.col("id")))
    for df in (even, dense):
        chunked = ordering.by_key(df, "k")
        assert max(r["count"] for r in chunked.groupBy(ordering.CHUNK).count().collect()) <= ordering.UNEVEN * 50
        placed = ordering.position_within(chunked, [], ["k"])
        assert placed.where(F.col("pos") == F.col("id") + 1).count() == n


def test_templates_are_cut_once_per_prototype(spark, rows):
    prototypes = table(spark, "t string", ("a.__x__.${y}.__x__",), ("__y__",), ("plain",), ("",), ("__z__",), (None,))
    out = design.expand_flagged(prototypes, {"x": ["1", "__y__"], "y": [None, "q"]}, "t")
    below = out._jdf.queryExecution().optimizedPlan().toString()
    assert below.index("Generate explode") < below.index("regexp_extract_all")
    assert out.where("rejected").count() == 8
    assert rows(out.where("not rejected"), "t", "point", "experiment") == sorted(
        [("a.__x__.${y}.__x__", i, f"a.{x}.{y}.{x}") for i, (x, y) in enumerate((x, y) for x in ("1", "__y__") for y in ("", "q"))]
        + [("__y__", i, ("", "q")[i % 2]) for i in range(4)] + [(t, i, t) for t in ("plain", "") for i in range(4)], key=repr)


def test_value_lists_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(design, "SINGLE_TASK_ROWS", 2)
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 2)
    values = table(spark, "v string", *[(c,) for c in "dbacadb"], (None,))
    assert sorted(map(tuple, design.indexed_values(values, "v").collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_expand(spark, rows):
    prototypes = table(spark, "template string", ("wc.__top__",), ("wc.__top__.__nope__",))
    good, bad = design.expand(prototypes, {"top": ["top005", "top010"]}, "template")
    assert rows(good, "experiment") == [("wc.top005",), ("wc.top010",)]
    assert bad.count() == 2


@pytest.mark.parametrize("n, unit, tiers", [(20, 5, [5, 10, 20]), (19, 5, [5, 10]), (4, 5, []), (9, 1, [1, 2, 4, 8])])
def test_tiers(spark, rows, n, unit, tiers):
    assert design.tier_sizes(n, unit) == tiers
    hosts = spark.range(100, 100 + n).withColumn("cores", F.lit(2))
    got = design.scaleout_tiers(hosts, "id", unit, F.col("cores"), F.lit(3))
    want = [("all", n, 2 * n, 3 * n)] + [(f"top{k:03d}", k, 2 * k, 3 * k) for k in tiers]
    assert rows(got) == sorted(want, key=repr)


def test_pending_runs(spark, rows):
    planned = table(spark, "e string, runs int", ("a", 3), ("b", 0), ("c", 1))
    done = table(spark, "e string, run int, exit int", ("a", 1, 0), ("a", 2, 1), ("c", 1, 0))
    assert rows(design.pending_runs(planned, done, ["e"])) == [("a", 2), ("a", 3)]
    assert design.pending_runs(planned, done, ["e"], force=True).count() == 4


# -- graphs --------------------------------------------------------------------------------------


@pytest.fixture
def arcs(spark):
    return table(spark, "src string, dst string", ("A", "B"), ("B", "C"), ("D", "E"), ("E", "C"), ("A", "B"))


def vertices(spark, *names):
    return table(spark, "v string", *[(n,) for n in names])


def test_graph_relations(spark, arcs, rows):
    v, e = graph.build(arcs, vertices(spark, "alone"))
    assert rows(v) == [("A",), ("B",), ("C",), ("D",), ("E",), ("alone",)] and e.count() == 4
    assert rows(graph.roots(v, e)) == [("A",), ("D",), ("alone",)]
    assert rows(graph.adjacency(arcs)) == [("A", "B", 1), ("B", "C", 1), ("D", "E", 1), ("E", "C", 1)]
    back_v, back = graph.reverse(v, e)
    assert rows(graph.descendants(back, vertices(spark, "C")), "v") == [("A",), ("B",), ("C",), ("D",), ("E",)]
    assert back_v.count() == 6
    assert graph.has_edge(e, table(spark, "src string, dst string", ("A", "B"), ("A", "C"))).count() == 1
    assert graph.has_edge(e, table(spark, "src string", ("A",), ("C",))).count() == 1
    with pytest.raises(ValueError):
        graph.reverse(v.limit(0), e.limit(0))


def test_reachability(spark, arcs, rows):
    reach = graph.descendants
    assert rows(reach(arcs, vertices(spark, "A"))) == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(reach(arcs, vertices(spark, "D"), vertices(spark, "E"))) == [("D", 0)]
    cycle = arcs.unionByName(table(spark, "src string, dst string", ("C", "A")))
    assert rows(reach(cycle, vertices(spark, "A"))) == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(graph.traverse(*graph.build(arcs))) == [("A", 0), ("B", 1), ("C", 2), ("D", 0), ("E", 1)]
    assert rows(graph.traverse(*graph.build(arcs), start=vertices(spark, "B"))) == [("A", 0), ("B", 0), ("C", 1), ("D", 0), ("E", 1)]
    assert rows(graph.reach_split(arcs, vertices(spark, "D"), vertices(spark, "E"))) == [("C", True), ("D", False), ("E", True)]


# -- configuration -------------------------------------------------------------------------------


def test_layers(spark, rows):
    settings = table(spark, "key string, layer string, value string", ("a", "reference", "x"), ("a", "host", "y"), ("b", "jvm", "z"))
    ranked = settings.withColumn("rank", config.layer_rank(F.col("layer")))
    merged = config.layered_merge(ranked, ["key"], "rank", "value")
    assert rows(merged) == [("a", "y"), ("b", "z")]
    other = table(spark, "key string, value string", ("a", "y"), ("b", "q"), ("c", None), ("d", "n"))
    assert rows(config.config_diff(merged, other, ["key"], "value")) == [("b", "z", "q"), ("d", None, "n")]


# -- files ---------------------------------------------------------------------------------------


def test_line_scan_reads_gzip(spark, tmp_path, rows):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write("three\n")
    assert rows(files.scan_lines(spark, str(tmp_path)), "value") == [("one",), ("three",), ("two",)]


def test_file_listing_of_both_layouts(spark, tmp_path, rows):
    plain, written = tmp_path / "plain" / "s p" / "e.run01" / "logs", tmp_path / "written"
    plain.mkdir(parents=True)
    (plain / "x.log").write_text("12345")
    table(spark, "suite string, name string, sub string, file string, value string", ("s p", "e.run01", "logs", "x.log", "1234")).write.partitionBy(
        "suite", "name", "sub", "file").text(str(written))
    files.mark_tree(spark, str(written))
    for root in (tmp_path / "plain", written):
        assert rows(files.scan_files(spark, str(root)), "rel", "file_name", "n_parts", "bytes") == [("s p/e.run01/logs/x.log", "x.log", 1, 5)]


def test_checksums(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"abd")
    actual = files.checksum_files(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    good = hashlib.md5(b"abc").hexdigest().upper()
    expected = table(spark, "name string, md5 string", ("a", good), ("b", good))
    assert [r.name for r in files.checksum_mismatches(actual, expected, "name").collect()] == ["b"]


def test_appended_lines_and_newest_files(spark, rows):
    lines = table(spark, "file string, line_no bigint, value string", ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"))
    offsets = table(spark, "file string, n_lines bigint", ("a", 1))
    assert rows(files.delta_lines(lines, offsets), "value") == [("y",), ("z",)]
    assert rows(files.delta_lines(lines, files.file_line_counts(lines))) == []
    before = table(spark, "g int, path string, modified bigint", (1, "p", 5), (1, "q", 5), (2, "r", 1))
    after = before.unionByName(table(spark, "g int, path string, modified bigint", (2, "s", 2), (3, "t", 1)))
    latest = files.latest_file(after, ["g"])
    assert rows(latest, "g", "path") == [(1, "q"), (2, "s"), (3, "t")]
    assert rows(files.changed_latest(files.latest_file(before, ["g"]), latest, ["g"]), "g") == [(2,), (3,)]


def test_datasets_are_made_once(spark, tmp_path):
    path, calls = str(tmp_path / "d"), []

    def make(session):
        calls.append(1)
        return session.range(3)

    assert datasets.ensure_dataset(spark, path, make).count() == 3
    assert datasets.ensure_dataset(spark, path, make).count() == 3 and len(calls) == 1

    def fail(session):
        return session.range(3).select(F.raise_error(F.lit("no")))

    with pytest.raises(Exception):
        datasets.ensure_dataset(spark, str(tmp_path / "half"), fail)
    assert not (tmp_path / "half").exists()
    datasets.clear(spark, path)
    assert not datasets.is_complete(spark, path)
    copied = datasets.copy_dataset(spark, _parquet(spark, tmp_path), str(tmp_path / "c"), "parquet", "csv", "id bigint")
    assert copied.count() == 4


def _parquet(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "p"))
    return str(tmp_path / "p")


def test_text_sinks(spark, tmp_path, rows):
    counts = table(spark, "word string, n bigint", ("a", 2), ("", 1))
    for write, want in ((text_sinks.write_counts_text, {"(a,2)", "(,1)"}), (text_sinks.write_counts_csv, {"a,2", ",1"})):
        path = str(tmp_path / write.__name__)
        write(counts, path)
        assert {r.value for r in spark.read.text(path).collect()} == want
    words = str(tmp_path / "words")
    for size in (30, 20):
        text_sinks.write_words(datagen.generate_words(spark, 2, size, 50), words)
    got = agg.word_count(spark.read.text(words), "value")
    assert rows(got) == rows(datagen.generate_words(spark, 2, 20, 50).groupBy("word").count())
