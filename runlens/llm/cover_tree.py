"""Exact top-k search by inner product with two cover trees, one over queries and one over data.

A node covers its points within its radius; its children's centres lie more than the radius divided by
``BASE`` apart and cover within that. For nodes Q and D no score exceeds

    c_q . c_d + |c_q| r_d + |c_d| r_q + r_q r_d

so the pair is dropped if that is below the worst k-th score among the queries of Q. Pairs whose nodes
hold few points, and points that are a child of their own, are scored with one matrix product.

The queries come in waves of some ``WAVE_ROWS`` or, if vectors are wide, as many as take ``WAVE_BYTES``, hashed by id and
vector. A wave passes the driver and is broadcast, so that bounds both; its broadcast goes when what it found is written. Each task indexes its data in blocks of ``BLOCK_ROWS`` and carries the scores
found from block to block. First a sample of ``SEED_ROWS`` rows is searched: its k-th scores are a lower bound
that every task starts from and below which it returns nothing.

Defined cases: vectors that are null or hold null or non-finite components take no part. Of vectors of unequal
length the shorter one counts as padded with zeros. A row does not match itself nor other rows of its id.
Repeated queries (id and vector equal) count once, repeated data rows each. Fewer than k
candidates: all are returned. Ties go to the smaller id. Rows with a null id are no queries and no candidates.
Empty tables give an empty result. Scores are double products and sums: exact for integer components
as long as sums stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm.common import table

BASE = 2.0
LEAF = 64
BLOCK_ROWS = 4096
WAVE_ROWS = 65_536
WAVE_BYTES = 128 << 20
SEED_ROWS = 16_384


class Node:
    __slots__ = ("low", "high", "loose", "center", "norm", "radius", "children")

    def __init__(self, low, high, center, radius):
        self.low, self.high, self.loose = low, high, high
        self.center, self.norm, self.radius = center, float(np.sqrt(center @ center)), radius
        self.children: list[Node] = []


class CoverTree:
    """``order`` puts the points of every node next to each other; points[low:loose] of a node with children
    are its points without a node of their own."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.root = None
        if len(points):
            away = _distances(points, points[0])
            self.root = self._build(np.arange(len(points)), away, points[0], 0, out := [])
            self.order = np.concatenate(out)
            self.points = points[self.order]

    def _build(self, rows, away, center, low, out) -> Node:
        radius = float(away.max()) * (1 + 1e-12)
        node = Node(low, low + len(rows), center, radius)
        if len(rows) <= LEAF or radius == 0:
            out.append(rows)
            return node
        cover, groups = radius / BASE, []
        near = away <= cover
        groups.append((rows[near], away[near], center))
        rows = rows[~near]
        while len(rows):
            c = self.points[rows[0]]
            away = _distances(self.points[rows], c)
            near = away <= cover
            near[0] = True
            groups.append((rows[near], away[near], c))
            rows = rows[~near]
        alone = [g[0] for g in groups if len(g[0]) <= LEAF // 8]
        if alone:
            out.append(np.concatenate(alone))
            low += len(out[-1])
        node.loose = low
        for r, a, c in groups:
            if len(r) > LEAF // 8:
                node.children.append(self._build(r, a, c, low, out))
                low += len(r)
        return node


def _distances(points, center):
    d = points - center
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Search:
    """The k best candidates so far of every query of a tree; ``floor`` are scores known to be reached."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.tree = CoverTree(points)
        self.ids, self.k = ids[self.tree.order], k
        n = len(ids)
        self.floor = np.full(n, -np.inf) if floor is None else floor[self.tree.order]
        self.scores = np.full((n, k), -np.inf)
        self.found = np.zeros((n, k), np.int64)

    def kth(self, low: int, high: int) -> np.ndarray:
        return np.maximum(self.scores[low:high, -1], self.floor[low:high])

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        """Index a block of data and search it for all queries."""
        if not len(ids) or self.tree.root is None:
            return
        q_width, d_width = self.tree.points.shape[1], points.shape[1]
        if d_width < q_width:
            points = np.pad(points, ((0, 0), (0, q_width - d_width)))
        elif d_width > q_width:  # what a query lacks is zero and adds nothing
            points = points[:, :q_width]
        data = CoverTree(points)
        self._dual(data, ids[data.order])

    def _dual(self, data: CoverTree, ids: np.ndarray) -> None:
        stack = [(np.inf, self.tree.root, data.root)]
        while stack:
            bound, q, d = stack.pop()
            if bound < self.kth(q.low, q.high).min():
                continue
            if not d.children and (not q.children or q.high - q.low <= LEAF):
                self._score(q.low, q.high, data, ids, d.low, d.high)
            elif d.children and (d.radius >= q.radius or not q.children):
                self._score(q.low, q.high, data, ids, d.low, d.loose)
                self._push(stack, [(q, c) for c in d.children])
            else:
                if q.loose > q.low:
                    self._loose_queries(q, d, data, ids)
                self._push(stack, [(c, d) for c in q.children])

    def _push(self, stack, pairs) -> None:
        """Most promising pair on top."""
        stack.extend(sorted(((_bound(q, d), q, d) for q, d in pairs), key=lambda x: x[0]))

    def _loose_queries(self, q: Node, d: Node, data: CoverTree, ids) -> None:
        """Queries without a node of their own are taken down the data tree together."""
        part = Node(q.low, q.loose, q.center, q.radius)
        self_stack = [d]
        while self_stack:
            node = self_stack.pop()
            if _bound(part, node) < self.kth(part.low, part.high).min():
                continue
            self._score(part.low, part.high, data, ids, node.low, node.loose if node.children else node.high)
            self_stack.extend(node.children)

    def _score(self, q_low, q_high, data, ids, d_low, d_high) -> None:
        if q_low == q_high or d_low == d_high:
            return
        a, b, ids = self.tree.points[q_low:q_high], data.points[d_low:d_high], ids[d_low:d_high]
        s = a @ b.T
        s[self.ids[q_low:q_high, None] == ids[None, :]] = -np.inf
        hit = (s >= self.kth(q_low, q_high)[:, None]) & (s > -np.inf)
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return
        s = np.where(hit, s, -np.inf)[np.ix_(rows, columns)]
        every_s = np.concatenate([self.scores[q_low + rows], s], axis=1)
        every_i = np.concatenate([self.found[q_low + rows], np.broadcast_to(ids[columns], s.shape)], axis=1)
        best = np.lexsort((every_i, -every_s), axis=1)[:, : self.k]
        self.scores[q_low + rows] = np.take_along_axis(every_s, best, 1)
        self.found[q_low + rows] = np.take_along_axis(every_i, best, 1)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query in the order given, id found, score."""
        row, place = np.nonzero(self.scores > -np.inf)
        return self.tree.order[row], self.found[row, place], self.scores[row, place]


def _bound(q: Node, d: Node) -> float:
    most = float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return most + 1e-9 * (1.0 + abs(most) + q.norm * d.norm)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles, padded with zeros to the longest."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    for i in range(len(lengths)):
        out[i, : lengths[i]] = flat[ends[i] : ends[i + 1]]
    return out


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _search(data: DataFrame, queries, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, floor = queries.value
        search = Search(ids, points, k, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                search.add(part.column(0).to_numpy(), _matrix(part.column(1)))
        number, found, scores = search.results()
        for at in range(0, len(number), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[cut], pa.int32()), pa.array(ids[number[cut]], pa.int64()), pa.array(found[cut], pa.int64()),
                 pa.array(scores[cut], pa.float64())],
                names=["number", "query_id", "vec_id", "score"],
            )

    return data.mapInArrow(run, "number int, query_id bigint, vec_id bigint, score double")


def _found(data: DataFrame, queries: tuple, k: int, label: str) -> DataFrame:
    """What ``_search`` finds, written; nothing of the queries stays on the executors. Runs a job."""
    sent = data.sparkSession.sparkContext.broadcast(queries)
    try:
        return table(_search(data, sent, k), label)
    finally:
        sent.destroy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, wave_rows: int = WAVE_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for frames as ``usable`` makes them. Runs jobs."""
    spark = vectors.sparkSession
    asked = table(queries.dropDuplicates(["id", "v"]), "queries")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    rows, waves = vectors.count(), -(-n // max(1, min(wave_rows, WAVE_BYTES // (8 * max(1, width or 0)))))
    out = []
    for w in range(waves):
        got = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(waves)) == w).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids, points = got.column("id").to_numpy(), _matrix(got.column("v").chunk(0))
        floor = np.full(len(ids), -np.inf)
        if rows > 2 * seed_rows:
            seen = vectors.sample(seed_rows / rows, seed=11)
            first = _ranked(_found(seen, (ids, points, floor), k, "seeds"), k).where(F.col("rank") == k)
            known = first.select("number", "score").toArrow()
            floor[known.column("number").to_numpy()] = known.column("score").to_numpy()
        found = _found(vectors, (ids, points, floor), k, "wave")
        out.append(found.withColumn("wave", F.lit(w)))
    if not out:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return _ranked(whole, k, "wave").select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int, *also: str) -> DataFrame:
    best = Window.partitionBy(*also, "number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
