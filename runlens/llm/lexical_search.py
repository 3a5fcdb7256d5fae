"""Ranked lexical search: posting lists in blocks of similar documents, whose coordinatewise maxima bound their scores.

An item scores a document by sum of c * w * impact over its terms: c counts the term in the item, w weighs it by how many
documents hold it, and the impact grows with its occurrences and falls with the document's length (``impacts``). All of it is
integer, so bounds and scores are exact.

1. Texts become sparse vectors of the terms that some item asks for; a pass over these counts documents and terms.
2. Some documents are scored in full. The kth score among them is one that the item's kth result reaches.
3. Documents are indexed in segments of a bounded size. In each, a term's posting list is cut into blocks by similarity:
   every ``BLOCK_DOCS``-th document is a centre, and documents join the centre of largest cosine. A block stores the
   largest impact of each coordinate over its documents, for the coordinates that items of that list can ask for. A list is kept if it is
   essential to some item: the item's other terms with smaller contributions can not reach its bar together, so a document
   of the result stands in an essential list.
4. Items pass over segments, first over some, which raises their bars, then over all. The product of an item with a block's maxima
   bounds the scores inside; the block is skipped only if that is below the bar. Documents of the
   other blocks are scored exactly, and the best k of each segment meet in one ranking per item.

Items come in blocks of bounded size, as distinct texts: each block's terms, weights and bars pass the driver and are sent to the tasks.
Segments, vectors and hits are tables.

Defined cases: null and empty texts hold no terms, count in nothing and are never found; items without terms have no rows.
Repeated documents are ranked one by one, repeated items are answered each. Equal scores rank by ascending id, null
ids last. Empty tables give an empty result. Weights are those of whole floating-point logarithms; the sum of c * w of an
item has to stay below 9 * 10^9, some 400,000 words, as scores are compared as doubles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm.common import shuffle_files_dropped, table, text_bytes
from runlens.session import work_path

ITEM_BYTES = 128 << 10
SAMPLE_DOCS = 4_096
SEGMENT_DOCS = 2_048
SEGMENT_CELLS = 16 << 20
BLOCK_DOCS = 8
SIMILAR_BY = 256
EARLY_SHARES = (1 / 16,)
_NO_ID = np.iinfo(np.int64).max
#: Terms are runs of ASCII letters, digits and everything above; other characters become blanks, A-Z lower case.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
SEGMENT = (
    "doc_ids array<bigint>, ptr array<int>, terms array<int>, impacts array<int>, list_term array<int>, list_coords array<int>, "
    "list_blocks array<int>, coords array<int>, block_docs array<int>, docs array<int>, maxima array<int>"
)
#: A segment as a table holds it: its columns as one compressed value, which only tasks that search it unpack.
PACKED = "doc_ids array<bigint>, body binary"
PACKED_GROUP = 16 << 20
HITS = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Of a term that occurs ``tf`` times in a document of ``n`` terms, among ``docs`` documents of ``terms`` terms."""
    norm = 75 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1_000 * tf + 12 * norm)


def weight(docs: int, df: int) -> int:
    return math.floor(1_000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Items:
    """A block of items: their terms by number, padded, and what the scores need."""

    texts: list[bytes]
    number: dict[bytes, int] = field(default_factory=dict)
    terms: np.ndarray = None  # item x term; len(number) stands for none
    counts: np.ndarray = None
    weights: np.ndarray = None  # counts times weight
    n_docs: int = 0
    n_terms: int = 0

    def __post_init__(self):
        bags = [Counter(terms_of(t)) for t in self.texts]
        for bag in bags:
            for term in bag:
                self.number.setdefault(term, len(self.number))
        shape = (len(bags), max([1, *map(len, bags)]))
        self.terms, self.counts = np.full(shape, len(self.number), np.int64), np.zeros(shape, np.int64)
        for i, bag in enumerate(bags):
            self.terms[i, : len(bag)] = [self.number[t] for t in bag]
            self.counts[i, : len(bag)] = list(bag.values())

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        w = np.array([weight(n_docs, int(d)) for d in df] + [0], np.int64)
        self.weights = self.counts * w[self.terms]
        if self.weights.size and self.weights.sum(1).max() >= 9 * 10**9:
            raise ValueError("an item has too many words for exact scores")

    def essential(self, largest: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """item x term: lists that have to be looked at. ``largest`` holds the largest impact of each term."""
        most = self.weights * largest[self.terms]
        order = np.argsort(most, axis=1)
        reach = np.cumsum(np.take_along_axis(most, order, 1), axis=1)
        needed = np.empty(most.shape, bool)
        np.put_along_axis(needed, order, reach >= bars[:, None], 1)
        return needed & (most > 0)


def vectors(docs: DataFrame, items, text: str, id_column: str) -> DataFrame:
    """Documents as the terms that ``items`` (a broadcast) asks for; ``n`` counts all terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.number
        for batch in batches:
            n, ptr, terms, counts = [], [0], [], []
            for body in batch.column(1).to_pylist():
                words = terms_of(body)
                for term, count in Counter(words).items():
                    if term in known:
                        terms.append(known[term])
                        counts.append(count)
                n.append(len(words))
                ptr.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_bytes(text).alias("body")).mapInArrow(rows, VECTORS)


def _totals(held: DataFrame) -> DataFrame:
    """Documents by term; as terms -1 and -2, the documents and the terms of all. Counts combine in each task first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            more = np.bincount(batch.column(1).values.to_numpy())
            if len(more) > len(df):
                more[: len(df)] += df
                df = more
            else:
                df[: len(more)] += more
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [-1, -2]), pa.int32()), pa.array(np.append(df[at], [n_docs, n_terms]), pa.int64())], names=["term", "n"]
        )

    return held.select("n", "terms").mapInArrow(rows, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _segments(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, offsets, terms and impacts of documents, as many at once as a segment holds."""
    most = max(64, min(SEGMENT_DOCS, SEGMENT_CELLS // (len(items.number) + 1)))
    held: list[pa.RecordBatch] = []
    rows = 0

    def made() -> tuple:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists, counts = whole.column("terms").combine_chunks(), whole.column("counts").combine_chunks()
        ptr = lists.offsets.to_numpy()
        terms, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        ptr = (ptr - ptr[0]).astype(np.int64)
        n = np.repeat(whole.column("n").to_numpy(), np.diff(ptr))
        return _ids(whole.column("doc_id").combine_chunks()), ptr, terms, impacts(tf, n, items.n_docs, items.n_terms)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - rows)
            held.append(part)
            rows += part.num_rows
            at += part.num_rows
            if rows == most:
                yield made()
                held, rows = [], 0
    if rows:
        yield made()


def _grid(n_terms: int, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Terms by documents; the last row, of no term, stays empty."""
    grid = np.zeros((n_terms + 1, len(ptr) - 1), np.int32)
    grid[terms, np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))] = values
    return grid


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _hits(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    items = np.concatenate([np.full(len(ids), i, np.int32) for i, ids, _ in found] or [np.zeros(0, np.int32)])
    ids = np.concatenate([ids for _, ids, _ in found] or [np.zeros(0, np.int64)])
    scores = np.concatenate([s for _, _, s in found] or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["item", "doc_id", "score"])


def _scored(items: Items, i: int, grid: np.ndarray, docs: np.ndarray) -> np.ndarray:
    used = items.weights[i] > 0
    return items.weights[i, used] @ grid[np.ix_(items.terms[i, used], docs)].astype(np.int64)


def _scored_in_full(held: DataFrame, items, k: int) -> DataFrame:
    """The best k of each part of these documents, for every item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        for ids, ptr, terms, values in _segments(batches, asked):
            grid, found = _grid(len(asked.number), ptr, terms, values), []
            for i in range(len(asked.texts)):
                scores = _scored(asked, i, grid, np.arange(len(ids)))
                some = np.flatnonzero(scores > 0)
                best = some[_best(ids[some], scores[some], k)]
                found.append((i, ids[best], scores[best]))
            yield _hits(found)

    return held.mapInArrow(rows, HITS)


def _blocks(vectors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a list's documents by block, and where blocks start. ``vectors``: coordinates by documents."""
    n = vectors.shape[1]
    centres = np.arange(0, n, BLOCK_DOCS)
    if len(centres) == 1:
        return np.arange(n), np.zeros(1, np.int64)
    top = np.argsort(-weights, kind="stable")[:SIMILAR_BY]
    x = vectors[top] * weights[top, None].astype(np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(0)), 1e-9)
    nearest = np.argmax(x[:, centres].T @ x, axis=0)
    order = np.argsort(nearest, kind="stable")
    return order, np.flatnonzero(np.concatenate(([True], np.diff(nearest[order]) > 0)))


def pack(segment: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, segment.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(segment)
    return pa.RecordBatch.from_arrays([segment.column("doc_ids"), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["doc_ids", "body"])


def unpack(body: pa.Scalar) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(body.as_buffer()) as stream:
        (segment,) = stream
    flat = {x: c.flatten() for x, c in zip(segment.schema.names, segment.columns)}
    return {x: _ids(v) if x == "doc_ids" else v.to_numpy() for x, v in flat.items()}


def index_segments(held: DataFrame, items, bars: np.ndarray, packed: bool = False) -> DataFrame:
    """One row per segment: its vectors, and the blocks of each list that is essential to some item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        for ids, ptr, terms, values in _segments(batches, asked):
            grid = _grid(len(asked.number), ptr, terms, values)
            largest = grid.max(axis=1, initial=0).astype(np.int64)
            who, which = np.nonzero(asked.essential(largest, bars))
            lists = asked.terms[who, which]
            order = np.argsort(lists, kind="stable")
            out: dict[str, list] = {x: [] for x in ("list_term", "list_coords", "list_blocks", "coords", "block_docs", "docs", "maxima")}
            cuts = np.flatnonzero(np.diff(lists[order], prepend=-1))
            for group in np.split(who[order], cuts[1:]) if len(lists) else []:
                term = int(lists[order[cuts[len(out["list_term"])]]])
                used, where = np.unique(asked.terms[group], return_inverse=True)
                heavy = np.zeros(len(used), np.int64)
                np.maximum.at(heavy, where.ravel(), asked.weights[group].ravel())
                live = (heavy > 0) & (largest[used] > 0)
                coords, docs = used[live], np.flatnonzero(grid[term])
                part = grid[np.ix_(coords, docs)]
                sorted_docs, starts = _blocks(part, heavy[live])
                out["list_term"].append(np.array([term]))
                out["list_coords"].append(np.array([len(coords)]))
                out["list_blocks"].append(np.array([len(starts)]))
                out["coords"].append(coords)
                out["block_docs"].append(np.diff(np.append(starts, len(docs))))
                out["docs"].append(docs[sorted_docs])
                out["maxima"].append(np.maximum.reduceat(part[:, sorted_docs], starts, axis=1).T.ravel())
            flat = {x: np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32) for x, v in out.items()}
            columns = {"doc_ids": ids, "ptr": ptr.astype(np.int32), "terms": terms.astype(np.int32), "impacts": values.astype(np.int32)} | flat
            one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in columns.values()]
            segment = pa.RecordBatch.from_arrays(one, names=list(columns))
            yield pack(segment) if packed else segment

    return held.mapInArrow(rows, PACKED if packed else SEGMENT)


def _segment_table(segments: DataFrame) -> DataFrame:
    """Packed segments as a table. Rows are megabytes, so a row group is closed by its bytes after any row. Runs a job."""
    path, options = work_path(segments.sparkSession, "segments"), {"parquet.block.size": str(PACKED_GROUP)}
    options |= {f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}
    with shuffle_files_dropped(segments.sparkSession):
        segments.write.options(**options).parquet(path)
    return segments.sparkSession.read.schema(PACKED).parquet(path)


@dataclass
class Looked:
    """What a search of segments cost."""

    blocks: int = 0
    skipped: int = 0
    scored: int = 0


def search_segment(items: Items, segment: dict[str, np.ndarray], bars: np.ndarray, k: int, looked: Looked) -> list:
    """(item, ids, scores): the segment's best k that reach the item's bar."""
    ids = segment["doc_ids"]
    grid = _grid(len(items.number), segment["ptr"], segment["terms"], segment["impacts"])
    needed = items.essential(grid.max(axis=1, initial=0).astype(np.int64), bars)
    by_term: dict[int, list[int]] = {}
    for i, j in zip(*np.nonzero(needed)):
        by_term.setdefault(int(items.terms[i, j]), []).append(int(i))
    left = np.zeros((len(items.texts), len(ids)), bool)
    weights = np.zeros((len(items.texts), len(items.number) + 1))
    np.put_along_axis(weights, items.terms, items.weights.astype(float), 1)
    weights[:, -1] = 0
    at_coord = at_block = at_doc = at_max = 0
    for term, n_coords, n_blocks in zip(segment["list_term"], segment["list_coords"], segment["list_blocks"]):
        coords = segment["coords"][at_coord : at_coord + n_coords]
        sizes = segment["block_docs"][at_block : at_block + n_blocks]
        docs = segment["docs"][at_doc : at_doc + sizes.sum()]
        maxima = segment["maxima"][at_max : at_max + n_coords * n_blocks].reshape(n_blocks, n_coords)
        at_coord, at_block, at_doc, at_max = at_coord + n_coords, at_block + n_blocks, at_doc + len(docs), at_max + maxima.size
        if not (who := by_term.get(int(term))):
            continue
        bounds = maxima @ weights[np.ix_(who, coords)].T
        pass_on = bounds >= bars[who]  # block x item
        looked.blocks += pass_on.size
        looked.skipped += int(pass_on.size - pass_on.sum())
        block, item = np.nonzero(np.repeat(pass_on, sizes, axis=0))
        left[np.asarray(who)[item], docs[block]] = True
    found = []
    for i in np.flatnonzero(left.any(axis=1)):
        docs = np.flatnonzero(left[i])
        scores = _scored(items, i, grid, docs)
        looked.scored += len(docs)
        some = np.flatnonzero(scores >= bars[i])
        best = some[_best(ids[docs[some]], scores[some], k)]
        found.append((i, ids[docs[best]], scores[best]))
    return found


def _searched(segments: DataFrame, items, bars: np.ndarray, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = Looked()
        for batch in batches:
            for body in batch.column(0):
                yield _hits(search_segment(items.value, unpack(body), bars, k, looked))

    return segments.select("body").mapInArrow(rows, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each item; every task passes on k of an item at most."""
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _bars(hits: DataFrame, k: int, bars: np.ndarray) -> np.ndarray:
    """An item's kth score so far, where it has as many; one number per item comes to the driver."""
    raised = bars.copy()
    for item, score in _ranked(hits, k).where(F.col("rank") == k).select("item", "score").collect():
        raised[item] = max(raised[item], score)
    return raised


def search_block(docs: DataFrame, texts: list[bytes], k: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """item (place in ``texts``), rank, doc_id, score. Runs jobs."""
    spark = docs.sparkSession
    items = Items(texts)
    sent = [spark.sparkContext.broadcast(items)]
    held = table(vectors(docs, sent[0], text, id_column), "vectors")
    totals = {r.term: r.n for r in _totals(held).collect()}
    n_docs, n_terms = totals.get(-1, 0), totals.get(-2, 0)
    items.weigh(n_docs, n_terms, np.array([totals.get(i, 0) for i in range(len(items.number))], np.int64))
    sent.append(spark.sparkContext.broadcast(items))
    weighed = sent[1]
    # some documents, by a hash of what they hold
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    drawn = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) < int(share * (1 << 20))
    bars = _bars(_scored_in_full(held.where(drawn), weighed, k), k, np.ones(len(texts), np.int64))
    segments = _segment_table(index_segments(held, weighed, bars, packed=True))
    for part in EARLY_SHARES:
        some = segments.where(F.pmod(F.xxhash64("doc_ids"), F.lit(1 << 20)) < int(part * (1 << 20)))
        bars = _bars(_searched(some, weighed, bars, k), k, bars)
    hits = table(_ranked(_searched(segments, weighed, bars, k), k), "hits")
    for b in sent:
        b.destroy()
    return hits.select("item", "rank", "doc_id", "score")


def top_k(
    docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", id_column: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score of each item's ``k`` best documents with a score above 0. Runs jobs."""
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), text_bytes(item_text).alias("body"))
    distinct = table(asked.select("body").distinct(), "items")
    size = distinct.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    numbered = distinct.withColumn("block", F.pmod(F.xxhash64("body"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        texts = [bytes(r.body) for r in numbered.where(F.col("block") == b).select("body").collect()]
        keys = docs.sparkSession.createDataFrame(list(enumerate(map(bytearray, texts))), "item int, body binary")
        part = search_block(docs, texts, k, text, id_column).join(keys, "item").drop("item")
        found = part if found is None else found.unionByName(part)
    return asked.join(found, "body").select("item_id", "rank", "doc_id", "score")
