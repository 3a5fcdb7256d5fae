"""Configuration as (entity, key, value) rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from runlens.session import cut_lineage

# Layer order, weakest first.
LAYERS = ("reference", "system", "bundle", "host", "application", "experiment", "runtime", "jvm")


def layer_rank(layer: Column) -> Column:
    """Position of a layer name; null for unknown names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(LAYERS) for x in (n, i)]), layer)


def layered_merge(settings: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Value of the strongest layer per key.

    One aggregation on (rank, value) pairs; it combines before the shuffle, so a key set in many
    layers, or very often, still costs one row per task.
    """
    strongest = F.max(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))
    return settings.groupBy(*keys).agg(strongest.alias("__s")).select(*keys, F.col("__s.v").alias(value))


def config_diff(current: DataFrame, rendered: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose value differs, with old and new value; missing on one side counts as a difference."""
    old = current.select(*keys, F.col(value).alias("old_value"))
    new = rendered.select(*keys, F.col(value).alias("new_value"))
    return old.join(new, list(keys), "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def flatten_config(
    df: DataFrame, column: str, keep: Sequence[str] = (), prefix: str = "", unquote: bool = True
) -> DataFrame:
    """(keep..., key, value) rows of the leaves of a struct column, with dotted keys.

    A leaf named ``_root_`` stands for its parent, quotes around numeric path parts go, and
    ``prefix`` is taken off the keys. Unset leaves give no row. Without ``unquote`` this is the form
    for environment files, in which numbers stay quoted.
    """
    leaves = _leaves(df.schema[column].dataType, [column])
    pairs = [
        F.struct(F.lit(_clean(".".join(path[1:]), prefix, unquote)).alias("key"), _at(path).cast("string").alias("value"))
        for path in leaves
    ]
    return df.select(*keep, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _leaves(dtype: T.DataType, path: list[str]) -> list[list[str]]:
    if not isinstance(dtype, T.StructType):
        return [path]
    return [leaf for f in dtype.fields for leaf in _leaves(f.dataType, [*path, f.name])]


def _at(path: list[str]) -> Column:
    value = F.col(f"`{path[0]}`")
    for name in path[1:]:
        value = value.getField(name)
    return value


def _clean(key: str, prefix: str, unquote: bool = True) -> str:
    key = key.removeprefix(f"{prefix}.") if prefix else key
    for root in ('."_root_"', "._root_"):
        key = key.removesuffix(root)
    if not unquote:
        return key
    return ".".join(p[1:-1] if p[:1] == p[-1:] == '"' and p[1:-1].isdigit() else p for p in key.split("."))


def clean_keys(key: Column, prefix: str = "", unquote: bool = True) -> Column:
    """The same rules for keys that are data."""
    if prefix:
        key = F.when(key.startswith(f"{prefix}."), F.substring(key, F.lit(len(prefix) + 2), F.length(key))).otherwise(key)
    key = F.regexp_replace(key, r'\."_root_"$', "")
    return F.regexp_replace(key, r'\."(\d+)"', r".$1") if unquote else key


# -- the nested form ---------------------------------------------------------------------------

#: A part of a dotted key: quoted, and then of any characters, or up to the next dot.
PATH_PART = r'"[^"]*"|[^."]+'


def nest_config(rows: DataFrame, entity: str, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entity, tree) and rejects (entity, key, reason): dotted rows as one JSON object per entity, keys in order.

    Rows are grouped by their path without its last part, the deepest first, so that each step puts together objects of one
    level; there are as many steps as parts in the longest key. Values stay text. Quotes around a part go. Rejected are: keys that are not made of
    parts, keys that are set twice, and values of keys that other keys go below (a value can not be an object too). A null value
    is an unset key. Runs jobs.
    """
    parts = F.regexp_extract_all(F.col(key), F.lit(f"({PATH_PART})"))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, '^"|"$', ""))
    given = rows.where(F.col(value).isNotNull()).select(
        F.col(entity).alias("e"), F.col(key).alias("k"), F.col(value).cast("string").alias("v"), plain.alias("path"),
        F.array_join(parts, ".").eqNullSafe(F.col(key)).alias("sound"),
    )
    bad = given.where(~F.col("sound") | (F.size("path") == 0)).select("e", "k", F.lit("no dotted key").alias("reason"))
    sound = given.where(F.col("sound") & (F.size("path") > 0))
    # what is set at a path, and whether something lies below it: one aggregation over all prefixes
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("path"), (n == F.size("path")).alias("leaf")))
    marks = sound.select("e", "k", "v", F.inline(prefixes)).groupBy("e", "path").agg(
        F.count_if("leaf").alias("set"), F.count_if(~F.col("leaf")).alias("below"),
        F.max(F.when(F.col("leaf"), F.col("v"))).alias("v"), F.max(F.when(F.col("leaf"), F.col("k"))).alias("k"),
    )
    marks = cut_lineage(marks.where("set > 0"), "settings")
    reason = F.when(F.col("below") > 0, "a value and an object").when(F.col("set") > 1, "set twice")
    clash = marks.where(reason.isNotNull()).select("e", "k", reason.alias("reason"))
    nodes = marks.where(reason.isNull()).select("e", "path", F.to_json(F.array("v")).alias("json"))
    nodes = nodes.withColumn("json", F.substring("json", F.lit(2), F.length("json") - 2))  # a JSON string
    # each level takes its own leaves and what the level below put together, so the plan has every level once
    nodes = cut_lineage(nodes.withColumn("level", F.size("path")), "nodes")
    depth = nodes.agg(F.max("level")).first()[0] or 0
    whole = nodes.where("level = 0").select("e", "path", "json")
    for level in range(depth, 0, -1):
        here = nodes.where(F.col("level") == level).select("e", "path", "json")
        here = here if level == depth else here.unionByName(whole)
        name = F.element_at("path", -1)
        quoted = F.to_json(F.array(name))
        member = F.struct(name.alias("n"), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.col("json")).alias("m"))
        members = F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"])
        whole = here.groupBy("e", F.slice("path", 1, level - 1).alias("path")).agg(
            F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("json")
        )
    nodes = whole
    trees = nodes.select(F.col("e").alias(entity), F.col("json").alias("tree"))
    return trees, bad.unionByName(clash).select(F.col("e").alias(entity), F.col("k").alias(key), "reason")


def unnest_config(trees: DataFrame, entity: str, tree: str = "tree") -> DataFrame:
    """(entity, key, value) rows of the leaves of JSON objects, level by level; parts that are no plain names are quoted. Runs jobs."""
    level = trees.select(F.col(entity), F.lit("").alias("key"), F.col(tree).alias("value"))
    done = []
    while True:
        level = cut_lineage(level, "level")
        below = level.where(F.col("value").startswith("{"))
        done.append(level.where(~F.col("value").startswith("{")))
        if below.isEmpty():
            break
        # members keep their JSON text: objects go on, strings are read below
        members = below.select(entity, F.col("key").alias("above"), F.explode(F.from_json("value", "map<string,variant>")).alias("name", "member"))
        part = F.when(F.col("name").rlike('[."]') | (F.col("name") == ""), F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.col("name"))
        level = members.select(
            entity, F.when(F.col("above") == "", part).otherwise(F.concat("above", F.lit("."), part)).alias("key"), F.to_json("member").alias("value")
        )
    leaves = functools.reduce(DataFrame.unionByName, done)
    text = F.when(F.col("value").startswith('"'), F.variant_get(F.parse_json("value"), "$", "string")).otherwise(F.col("value"))
    return leaves.where("value is not null and key <> ''").select(entity, "key", text.alias("value"))
