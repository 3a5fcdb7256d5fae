"""Sums of blocks, nested settings, extractors as table functions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import config
from runlens.operators.extract import registered
from runlens.operators.extract.table_functions import register_table_functions, table_function
from runlens.sources.checksums import tree_checksums


def by_hand(content, block, fan):
    sums = [hashlib.md5(content[i : i + block]).hexdigest() for i in range(0, max(len(content), 1), block)]
    while len(sums) > 1:
        sums = [hashlib.md5("".join(sums[i : i + fan]).encode()).hexdigest() for i in range(0, len(sums), fan)]
    return sums[0]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_sums_of_files_of_many_blocks(spark, tmp_path, fan):
    rnd, contents = random.Random(1), {}
    for size in (0, 1, 99, 100, 101, 200, 850, 5_003):
        contents[size] = bytes(rnd.randrange(256) for _ in range(size))
        (tmp_path / f"a b {size}+ü.bin").write_bytes(contents[size])
    found = tree_checksums(spark, str(tmp_path), block_bytes=100, fan=fan, parts=5)
    got = {r.bytes: (r.n_blocks, r.md5) for r in found.collect()}
    assert got == {n: (max(1, -(-n // 100)), by_hand(c, 100, fan)) for n, c in contents.items() if n}
    assert got[99][1] == hashlib.md5(contents[99]).hexdigest()
    other = tree_checksums(spark, str(tmp_path), block_bytes=100, fan=fan, parts=2)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, found.collect()))


def test_blocks_of_a_file_are_several_tasks_work(spark, tmp_path):
    from runlens.sources.checksums import block_sums, file_blocks

    (tmp_path / "large.bin").write_bytes(b"z" * 10_000)
    sums = block_sums(file_blocks(spark, str(tmp_path), 100), 100, parts=6)
    assert sums.select(F.spark_partition_id()).distinct().count() > 1 and sums.count() == 100


SETTINGS = [
    (1, "a.b.c", "1"), (1, "a.b.d", 'say "hi"\n\\'), (1, "a.e", "3"), (1, 'f."x.y".0', "4"), (1, "g", ""), (2, "a", "5"), (2, "b.c", None),
    (3, "a", "1"), (3, "a.b", "2"), (3, "a.b.c", "3"), (3, "z", "9"), (4, "k", "1"), (4, "k", "1"), (4, '"k"', "1"), (4, "l..m", "1"), (4, "", "1"), (5, "n", None),
]


def test_nested_settings_and_what_is_rejected(spark, rows):
    given = spark.createDataFrame(SETTINGS, "id int, key string, value string")
    trees, rejects = config.nest_config(given, "id")
    got = {r.id: json.loads(r.tree) for r in trees.collect()}
    assert got == {
        1: {"a": {"b": {"c": "1", "d": 'say "hi"\n\\'}, "e": "3"}, "f": {"x.y": {"0": "4"}}, "g": ""}, 2: {"a": "5"}, 3: {"a": {"b": {"c": "3"}}, "z": "9"},
    }
    assert rows(rejects) == sorted(
        [(3, "a", "a value and an object"), (3, "a.b", "a value and an object"), (4, "k", "set twice"), (4, "", "no dotted key"), (4, "l..m", "no dotted key")], key=repr
    )
    back = rows(config.unnest_config(trees, "id"))
    kept = [s for s in SETTINGS if s[0] < 3 and s[2] is not None] + [(3, "a.b.c", "3"), (3, "z", "9")]
    assert back == sorted(kept, key=repr)


def test_settings_of_environment_files(spark):
    keys = spark.createDataFrame([('env.site."1"',), ('env.a."2".b."_root_"',), ("other.c",)], "key string")
    assert [r[0] for r in keys.select(config.clean_keys(F.col("key"), "env", unquote=False)).collect()] == ['site."1"', 'a."2".b', "other.c"]
    assert [r[0] for r in keys.select(config.clean_keys(F.col("key"), "env")).collect()] == ["site.1", "a.2.b", "other.c"]


LINES = [
    "2019-02-03 04:05:06,007\tMap -> (x)(1/4) switched to RUNNING \n", "2019-02-03 04:05:06,007\tMap(9999999999/4) switched to FINISHED",
    "2019-99-03 04:05:06,007\tMap(1/4) switched to DEPLOYING", "2019-02-03 04:05:06,007\tMap(1/4) switched to FAILED", "noise", None,
    "2019-02-03 04:05:06,123 INFO  graph.Graph  - Map (x) (3/4) (abc) switched from CREATED to SCHEDULED",
]


def test_one_extractor_both_ways(spark, rows):
    register_table_functions(spark)
    lines = spark.createDataFrame([("f", i, s and s.rstrip("\n"), "c") for i, s in enumerate(LINES)], "file string, record_key bigint, value string, suite string")
    lines.createOrReplaceTempView("some_lines")
    by_function = spark.sql("SELECT * FROM task_states(TABLE(some_lines))")
    plain = registered()["flink_tasks"].extract(lines)
    assert sorted(by_function.columns) == sorted(plain.columns)
    assert rows(by_function, *plain.columns) == rows(plain) and plain.count() == 4


def test_a_users_own_table_function(spark, rows):
    fn = table_function("sizes", lambda line: [{"name": "size", "v_long": len(line)}] if line else [])
    spark.udtf.register("sizes", fn)
    got = spark.sql("SELECT n, name, v_long FROM sizes(TABLE(SELECT * FROM VALUES (1, 'abc'), (2, '') AS t(n, value)))")
    assert rows(got) == [(1, "size", 3)]
    with pytest.raises(Exception, match="column value"):
        spark.sql("SELECT * FROM sizes(TABLE(SELECT 1 AS n))").collect()
