from pyspark.sql import functions as F

from runlens import functions as rf
from runlens.functions.ranhash import with_bounded_int, with_uniform
from runlens.operators.config import clean_keys, layer_rank


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "s string").select(expression(F.col("s")).alias("v")).first()[0]


def java_hash(text):
    units, value = text.encode("utf-16-be"), 0
    for i in range(0, len(units), 2):
        value = (value * 31 + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def draw(seed, position):
    """The generator in exact integer arithmetic."""
    x = signed(3935559000370003845 * signed(seed + position) + 2691343689449507681)
    for shift in (lambda v: v >> 21, lambda v: v << 37, lambda v: v >> 4):
        x = signed(x ^ shift(x))
    x = signed(4768777513237032717 * x)
    for shift in (lambda v: v << 20, lambda v: v >> 41, lambda v: v << 5):
        x = signed(x ^ shift(x))
    return x * 5.4210108624275221700e-20 + 0.5


def test_java_hash(spark):
    texts = ["", "a", "exp", "suite.default", "Zoë", "\U0001F600x", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.h for r in df.select("s", rf.java_hash(F.col("s")).alias("h")).collect()}
    assert got == {t: java_hash(t) for t in texts}


def test_ids_wrap_and_collide(spark):
    df = spark.range(1).select(
        rf.run_id(F.lit(2147483647), F.lit(1)).alias("wrapped"),
        rf.run_id(F.lit(7), F.lit(32)).alias("a"), rf.run_id(F.lit(8), F.lit(1)).alias("b"),
    ).first()
    assert df.wrapped == ((2147483647 * 31 + 1 + 2**31) % 2**32) - 2**31
    assert df.a == df.b


def test_run_names(spark):
    parse = rf.parse_run_name
    assert tuple(one(spark, parse, "wordcount.flink.run07")) == ("wordcount.flink", 7)
    assert one(spark, parse, "wordcount.run100") is None
    assert one(spark, parse, "datagen.words") is None
    assert spark.range(1).select(rf.format_run_name(F.lit("e"), F.lit(3))).first()[0] == "e.run03"


def test_word_tokens(spark):
    cases = {" A b ": ["", "a", "b"], "": [""], " ": [], "a,b": ["a", "b"], "x--": ["x"], "été": ["", "t"]}
    for line, tokens in cases.items():
        assert one(spark, rf.word_tokens, line) == tokens, line


def test_version_order(spark):
    ordered = ["1.9-snapshot", "1.9-rc1", "1.9-rc2", "1.9", "1.9.1", "1.10.0", "2"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "s string")
    assert [r.s for r in df.orderBy(rf.version_key(F.col("s"))).collect()] == ordered
    assert one(spark, rf.version_prefixes, "1.2.3-SNAPSHOT") == ["1.2.3", "1.2", "1"]
    assert one(spark, rf.version_numbers, "one.two") is None


def test_clocks(spark):
    millis = lambda c: F.unix_millis(c)
    assert one(spark, lambda c: millis(rf.log_timestamp(c)), "2019-02-03 04:05:06,007") == 1549166706007
    assert one(spark, rf.log_timestamp, "2019-13-03 04:05:06,007") is None
    assert one(spark, lambda c: millis(rf.dstat_epoch(c)), "1464692877.5") == 1464692877500
    assert one(spark, lambda c: millis(rf.dstat_epoch(c, strict_compat=True)), "1464692877.5") == 1464692877005
    assert one(spark, rf.dstat_epoch, "1464692877") is None
    assert one(spark, rf.dstat_epoch, "1.2.3") is None


def test_templates(spark):
    values = {"top": F.lit("__q__"), "x": F.lit("$1")}
    filled = spark.createDataFrame([("wc.__top__.${top}.__y__ ${x}",), (None,), ("",), ("${a b} ${z} __top__",)], "t string").select(
        rf.substitute(F.col("t"), values).alias("filled"), rf.unknown_keys(F.col("t"), values).alias("unknown")
    )
    assert [tuple(r) for r in filled.collect()] == [
        ("wc.__q__.__q__.__y__ $1", ["y"]), (None, None), ("", []), ("${a b} ${z} __q__", ["z"])
    ]


def test_config_keys(spark):
    assert one(spark, lambda c: clean_keys(c, "site"), 'site.foo."1".bar."_root_"') == "foo.1.bar"
    assert one(spark, layer_rank, "host") == 3 and one(spark, layer_rank, "nobody") is None


def test_uniform_draws_are_exact_and_do_not_depend_on_partitions(spark):
    assert draw(0xC00FFEE, 1) == 0.021889494460401615
    want = [(i, draw(0xC00FFEE, i)) for i in range(2000)]
    for parts in (1, 7):
        df = with_uniform(spark.range(0, 2000, 1, parts), F.col("id"), "u")
        assert sorted(map(tuple, df.collect())) == want
    assert all(0.0 < u < 1.0 for _, u in want)


def test_predicates_on_draws_stay_cheap(spark):
    df = with_uniform(spark.range(1000), F.col("id"), "u").where("u > 0.5 and u < 0.6")
    assert df.count() == sum(0.5 < draw(0xC00FFEE, i) < 0.6 for i in range(1000))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_bounded_ints(spark):
    got = {r.n for r in with_bounded_int(spark.range(5000), F.col("id"), 6, "n").collect()}
    assert got == set(range(6))
