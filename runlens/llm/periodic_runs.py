"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of words with smallest period q, of ``min_length`` words and ``min_exponent`` periods at least, that no
neighbouring word extends. The dictionary names, for each power of two, the factors of that many words: the name of a factor
of twice the length is the pair of the names of its halves, ranked by sorting. Sorting by name also puts
each occurrence next to its successor.

Let ``size`` be the power of two with q <= size < 2q. A factor of that size holds a whole rotation of the run's period, and
the rotations of a primitive word differ, so inside the run the factor's successor is exactly q words away. With four
periods or more the first word of the run and the ones q and 2q later start the same factor: three occurrences in arithmetic
progression, of difference at most ``size`` and over half of it. These propose q and no others do at that size, as a smaller
period of the words they cover would bring a nearer successor. Words that start such progressions of one difference stand
next to each other throughout a run and nowhere beside it, so a maximal stretch of them gives the whole run, from its
first word to the last one's end; each run is proposed at one size only. Factors that occur once in a document are
dropped before the next size, which leaves little above four words in ordinary text.

Documents are searched where they are read, some megabytes of text at a time, nothing is shuffled. A document is
one value and is searched by one task, in time n log n and memory some 100 bytes a word.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text. A text of one repeated word is one run
of period 1. Overlapping runs are all reported. Repeated rows and empty tables are as they are. Other columns pass
through; columns called n_words, runs or collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runlens.llm.common import text_bytes

TEXT_BYTES = 4 << 20
KNOWN_WORDS = 500_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _sorted(name: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and positions by name, then position; positions come ascending."""
    if int(name.max()).bit_length() + bits <= 62:  # both fit one integer, which sorts faster
        key = np.sort((name << bits) | at)
        return key >> bits, key & ((1 << bits) - 1)
    order = np.argsort(name, kind="stable")
    return name[order], at[order]


def find_runs(words: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) by start, then period.

    ``words`` holds one number per word, different in different documents; ``ends`` where the word's document ends.
    """
    n, size, found = len(words), 1, []
    bits = n.bit_length()
    at, name = np.arange(n, dtype=np.int64), words.astype(np.int64)
    rank = np.empty(n, np.int64)
    while at.size > 2:
        name, at = _sorted(name, at, bits)
        again = name[1:] == name[:-1]
        gap = np.diff(at)
        # three occurrences in a row, equally far apart
        three = again[1:] & again[:-1] & (gap[1:] == gap[:-1]) & (gap[:-1] <= size) & (2 * gap[:-1] > size)
        if three.any():
            first = np.flatnonzero(three)
            found.append(_stretches(at[first], gap[first], size))
        twice = np.zeros(at.size, bool)
        twice[1:] |= again
        twice[:-1] |= again
        rank.fill(-1)
        rank[at[twice]] = np.concatenate(([0], np.cumsum(~again)))[twice]
        at = np.sort(at[twice])
        at = at[at + 2 * size <= ends[at]]
        at = at[rank[at + size] >= 0]
        name = rank[at] * n + rank[at + size] if n < 1 << 31 else np.unique(np.stack((rank[at], rank[at + size])), axis=1, return_inverse=True)[1].ravel()
        size *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= min_length) & (runs[:, 1] >= min_exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(at: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
    """Neighbouring starts of one period as runs."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(period) != 0)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], at.size) - 1
    return np.stack((at[first], at[last] - at[first] + 2 * period[first] + size, period[first]), axis=1)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def _some(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of some megabytes."""
    first = held = 0
    for i, body in enumerate(bodies):
        held += len(body)
        if held >= TEXT_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(bodies):
        yield first, len(bodies)


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """All columns of ``docs``, n_words, ``runs`` by start, then period (words are numbered from 0), and ``collapsed``: the
    words that no run holds after its first period, joined by one blank.

    ``min_exponent`` is four or more: shorter runs need not show three times in a row.
    """
    if min_exponent < 4:
        raise ValueError("runs of less than four periods are not looked for")
    others = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            bodies = batch.column(batch.num_columns - 1).to_pylist()
            for low, high in _some(bodies):
                if len(number) > KNOWN_WORDS:
                    number.clear()
                words = [b.split() for b in bodies[low:high]]  # at ASCII white space, as bytes do
                sizes = np.array([len(w) for w in words], np.int64)
                ends = np.cumsum(sizes)
                ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(ends[-1]))
                whose = np.repeat(np.arange(high - low), sizes)
                runs = find_runs(whose * len(number) + ids, ends[whose], min_length, min_exponent)
                owner = whose[runs[:, 0]]
                runs[:, 0] -= (ends - sizes)[owner]
                cuts = np.searchsorted(owner, np.arange(high - low + 1))
                kept = [_collapsed(w, runs[a:b]) if a < b else b" ".join(w) for w, a, b in zip(words, cuts, cuts[1:])]
                fields = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(low, high - low).columns[:-1],
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), fields),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    held = docs.select(*named)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in held.schema.fields) + f"n_words bigint, runs {RUNS}, collapsed string"
    done = docs.select(*named, text_bytes(text).alias("__body")).mapInArrow(search, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of most periods, by exact fractions; the first by start, then period, if tied. Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))
