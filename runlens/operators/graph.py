"""Dependency graphs as (src, dst) edge tables.

Reachability runs level by level: one join and one anti-join per level, each level written as a table, so
plans stay short and a lost executor costs one level. Neighbours stay rows; no vertex's edge list is
gathered into one value, so a hub is just many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.session import BROADCAST_ROWS, cut_lineage

# Levels after which the visited set is written as one table again.
COMPACT_LEVELS = 10


def build(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) without repeats; edge ends are vertices."""
    distinct = edges.select("src", "dst").distinct()
    ends = distinct.select(F.explode(F.array("src", "dst")).alias("v"))
    if vertices is not None:
        ends = ends.unionByName(vertices.select("v"))
    return ends.distinct(), distinct


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, out_degree) of the distinct edges.

    Degrees are counted per vertex and joined back; AQE splits the join where a hub is too large.
    """
    distinct = edges.select("src", "dst").distinct()
    degree = distinct.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    return distinct.join(degree, "src")


def has_edge(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (src) or (src, dst) rows that are in the graph."""
    on = [c for c in ("src", "dst") if c in asked.columns]
    return asked.join(edges.select(*on).distinct(), on, "left_semi")


def reverse(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges turned round; isolated vertices stay. An empty graph can not be reversed."""
    if vertices.isEmpty():
        raise ValueError("cannot reverse an empty graph")
    return vertices, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices no edge leads to."""
    return vertices.join(edges.select(F.col("dst").alias("v")), "v", "left_anti")


def descendants(edges: DataFrame, start: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(v, depth): all vertices reachable from ``start`` (included), with the smallest depth.

    Excluded vertices are not entered. Runs one job per level; cycles end by themselves.
    """
    arcs = edges.select("src", "dst").distinct()
    if excluded is not None:
        arcs = arcs.join(excluded.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst")
    arcs = cut_lineage(arcs)
    frontier = cut_lineage(start.select("v").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while n := frontier.count():
        depth += 1
        # a small frontier goes to the arcs, whose hubs then need no shuffle at all
        side = F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier
        step = arcs.join(side, arcs.src == side.v).select(F.col("dst").alias("v")).distinct()
        fresh = step.join(visited.select("v"), "v", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(fresh)
        visited = visited.unionByName(frontier)
        if depth % COMPACT_LEVELS == 0:
            visited = cut_lineage(visited)
    return visited


def traverse(vertices: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(v, depth) from the roots, plus the start set if one is given."""
    begin = roots(vertices, edges)
    if start is not None:
        begin = begin.unionByName(start.select("v"))
    return descendants(edges, begin)


def reach_split(edges: DataFrame, vertex: DataFrame, inputs: DataFrame) -> DataFrame:
    """(v, via_input): reachable from the inputs, or from the vertex without entering the inputs.

    A vertex that is reached both ways shows up once per way.
    """
    by_input = descendants(edges, inputs).select("v", F.lit(True).alias("via_input"))
    direct = descendants(edges, vertex, inputs).select("v", F.lit(False).alias("via_input"))
    return by_input.unionByName(direct)


def suite_edges(suites: DataFrame) -> DataFrame:
    """Edges of nested suite records.

    ``suites`` has (suite, experiment, runner, systems[], inputs[struct(name, dependencies[])],
    outputs[struct(name, fs)]). An experiment depends on its runner, systems, inputs and outputs, an
    input on its own dependencies, an output on its file system.
    """
    e = F.col("experiment")

    def pair(src, dst):
        return F.struct(src.alias("src"), dst.alias("dst"))

    none = F.array().cast("array<struct<src:string,dst:string>>")
    edges = [
        F.array(pair(F.col("suite"), e), pair(e, F.col("runner"))),
        F.transform("systems", lambda s: pair(e, s)),
        F.transform("inputs", lambda i: pair(e, i["name"])),
        F.flatten(F.transform("inputs", lambda i: F.transform(i["dependencies"], lambda d: pair(i["name"], d)))),
        F.transform("outputs", lambda o: pair(e, o["name"])),
        F.transform("outputs", lambda o: pair(o["name"], o["fs"])),
    ]
    return suites.select(F.inline(F.concat(*[F.coalesce(x, none) for x in edges]))).distinct()
