"""SentencePiece encoding and decoding; giant documents are encoded in chunks.

The type of the model file says what its ids are.

**BPE.** Merges are replayed: of all neighbours that join to a piece, those of the highest score are joined first, the
leftmost of equal ones. Two characters that are next to each other in no piece are never joined, so texts are cut there and
the parts replayed. A giant document goes through the scan below: a segmentation is the one of the merges exactly if any two neighbouring
pieces, taken as a text, encode as these two (``fits``). For the first merge over a boundary is, in the whole text as in the
two pieces, the first in order of what can be joined there, after the same merges inside them. That is a max-plus system
with the weights 0 (they fit) and minus infinity over states (characters since the last boundary, length of the piece
before it); from the begin of the text there is one path to each boundary at most. Transfer matrices are sparse and
hold their finite entries only.

**Unigram.** Encoding is the segmentation of largest total score under the model's pieces and scores. Best scores follow a
recurrence that reaches back as far as the longest piece has characters (``width``), so what a chunk needs from
the text before it is one vector: the best score of a piece boundary 0, 1, ... width-1 characters
before its start. A chunk maps that vector linearly in max-plus algebra, by a matrix of width x width:

1. every chunk yields its matrix;
2. matrices are combined associatively, in blocks of blocks, which gives every chunk its entry vector;
3. with exact entry scores a chunk knows, for every exit boundary, where the path entered: a small map;
4. maps are combined the same way from the right, which gives every chunk its exit boundary;
5. every chunk walks back from its exit boundary on its own.

Scores are kept as integers (scaled, if the model's are fractions), so sums are exact and a document has the same
ids however it is cut. Among equal totals the longest last piece wins, at every boundary.

Where no piece reaches across (before a run of word marks), best paths of both sides are independent. Inside a
chunk, units between such places are solved on their own; a worker remembers the first ``CACHED_UNITS``.

Supported models have an identity normaliser; characters without a piece become bytes if the model has byte pieces,
else the unknown id. BPE models must have byte pieces, and no user-defined or unused ones; others are refused.

Defined cases: null and empty texts have no ids. Repeated rows are encoded alike. Rows whose ids are null
keep them. An empty table gives an empty result. Other columns pass through; one that is called like an output is replaced.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runlens.llm.common import giving_back, row_key, table, text_bytes

MARK = "▁"
CHUNK_CHARS = 32_768
FAN = 128
CACHED_UNITS = 250_000
LONGEST_CACHED = 64
LONGEST_IN_LISTS = 48
NONE = -np.inf
_MODELS: dict[str, "Model"] = {}
_KEY = "__key"
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Model:
    """Pieces, integer scores, and the unit cache of one worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        rows = [dict(_fields(v)) for n, v in parts if n == 1]
        pieces = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        normal = dict(next((_fields(v) for n, v in parts if n == 3), ()))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("only identity normalisers that keep white space are supported")
        self.prefix = bool(normal.get(3, 1))
        trainer = dict(next((_fields(v) for n, v in parts if n == 2), ()))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only models of type unigram and BPE are supported")
        self.merges = kind == BPE
        if self.merges and (BYTE not in kinds or USER_DEFINED in kinds or UNUSED in kinds):
            raise ValueError("BPE models must have byte pieces, and no user-defined or unused ones")
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED)]
        scale = 1 if all(float(scores[i]).is_integer() for i in usable) else 1 << 20
        self.piece = {pieces[i]: (i, round(scores[i] * scale)) for i in usable}
        self.width = max(map(len, self.piece))
        # what a model bars with huge penalties does not set the price of an unknown character
        ordinary = [s for _, s in self.piece.values() if s > -(10**8) * scale]
        self.unknown_score = min(ordinary, default=0) - 10 * scale
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k in (NORMAL, USER_DEFINED) else b""
                    for p, k in zip(pieces, kinds, strict=True)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.separable = all(MARK not in p[1:] or not p.strip(MARK) for p in self.piece)
        # every prefix of a piece, with the score if it is a piece itself
        self.prefix_score: dict[str, float] = {}
        for text, (_, score) in self.piece.items():
            for n in range(1, len(text)):
                self.prefix_score.setdefault(text[:n], NONE)
            self.prefix_score[text] = score
        # two characters that are next to each other in no piece have a certain boundary between them
        self.inside = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        # merges in order: equal scores share a rank
        order = {x: n for n, x in enumerate(sorted({scores[i] for i in usable}, reverse=True))}
        self.rank = {pieces[i]: order[scores[i]] for i in usable if len(pieces[i]) > 1} if self.merges else {}
        self.never = len(order)
        self.fitting: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    # -- dynamic program ---------------------------------------------------------------------

    def forward(self, text: str, low: int, high: int, best: dict[int, float]) -> dict[int, int]:
        """Fill ``best`` for boundaries low < p <= high from those given at or before low; returns where each came from."""
        back: dict[int, int] = {}
        for start in sorted(p for p in best if p <= low):
            self._relax(text, start, best, back, low, high)
        for start in range(low + 1, high):
            if start in best:
                self._relax(text, start, best, back, low, high)
        return back

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave two pieces as they are; a single piece if ``left`` is empty."""
        found = self.fitting.get((left, right))
        if found is None:
            want = [0, len(left), len(left) + len(right)] if left else [0, len(right)]
            found = self._merged_ends(left + right) == want
            if len(self.fitting) < CACHED_UNITS:
                self.fitting[left, right] = found
        return found

    def follow(self, text: str, low: int, high: int, states: dict[int, dict[int, int]]) -> None:
        """Add boundaries low < p <= high to ``states``: boundary to lengths of the piece before it, each with a set of origins (bits).

        A length of 0 stands for a boundary that is certain, so that any piece fits after it.
        """
        score_of = self.prefix_score
        for start in [*sorted(p for p in states if p <= low), *range(low + 1, high)]:
            if not (here := states.get(start)):
                continue
            end, score = start + 1, 0
            while end <= high and score is not None:
                if end > low and (end == start + 1 or score > NONE):
                    piece, origins = text[start:end], 0
                    for length, bits in here.items():
                        if bits & ~origins and self.fits(text[start - length : start], piece):
                            origins |= bits
                    if origins:
                        states.setdefault(end, {})[end - start] = origins
                end += 1
                score = score_of.get(text[start:end])

    def _relax(self, text, start, best, back, low, high):
        """Try all pieces that begin at ``start``; a character without a piece is unknown."""
        value, score_of, end = best[start], self.prefix_score, start + 1
        score = score_of.get(text[start], NONE)
        if score == NONE:
            score = self.unknown_score
        while True:
            # starts come in ascending order: on a tie the longer piece is there already
            if low < end <= high and value + score > best.get(end, NONE):
                best[end] = value + score
                back[end] = start
            end += 1
            if end > high:
                return
            score = score_of.get(text[start:end])
            if score is None:
                return

    def ids(self, text: str, ends: list[int]) -> bytes:
        """Ids of the pieces between consecutive boundaries."""
        out = array("I")
        for a, b in zip(ends, ends[1:], strict=False):
            found = self.piece.get(text[a:b])
            if found:
                out.append(found[0])
            elif self.byte_ids:
                out.extend(self.byte_ids[x] for x in text[a:b].encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def unit(self, text: str) -> bytes:
        """Ids of a stretch that no piece leaves, from those of its parts between certain boundaries."""
        inside, parts, at = self.inside, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        got = b"".join([self.known_parts.get(x) or self._part(x) for x in parts])
        if len(text) <= LONGEST_CACHED and len(self.known) < CACHED_UNITS:
            self.known[text] = got
        return got

    def _part(self, text: str) -> bytes:
        if not self.merges:
            ends = self._best_ends(text)
        elif len(text) <= LONGEST_IN_LISTS:
            ends = self._merged_ends(text)
        else:
            ends = self._merged_ends_of_long(text)
        got = self.ids(text, ends)
        if len(text) <= LONGEST_CACHED and len(self.known_parts) < CACHED_UNITS:
            self.known_parts[text] = got
        return got

    def _merged_ends(self, text: str) -> list[int]:
        """Boundaries after all merges; every step looks at all neighbours."""
        rank_of, never = self.rank.get, self.never
        now = list(text)
        ranks = [rank_of(a + b, never) for a, b in zip(now, now[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            now[i : i + 2] = [now[i] + now[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(now[i - 1] + now[i], never)
            if i < len(ranks):
                ranks[i] = rank_of(now[i] + now[i + 1], never)
        return [0, *accumulate(map(len, now))]

    def _merged_ends_of_long(self, text: str) -> list[int]:
        """The same with a heap of (rank, start) in one number; what stands there by now tells which entries still hold."""
        n, width, rank_of = len(text), self.width, self.rank.get
        end = array("q", range(1, n + 1))  # of the symbol that starts here; 0 if none does
        before = array("q", range(-1, n - 1))
        found = ((rank_of(text[i : i + 2]), i) for i in range(n - 1))
        heap = [r * n + i for r, i in found if r is not None]
        heapify(heap)
        while heap:
            rank, left = divmod(heappop(heap), n)
            right = end[left]
            if not right or right == n:
                continue
            stop = end[right]
            if stop - left > width or rank_of(text[left:stop]) != rank:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank_of(text[left : end[stop]])) is not None:
                    heappush(heap, r * n + left)
            first = before[left]
            if first >= 0 and (r := rank_of(text[first:stop])) is not None:
                heappush(heap, r * n + first)
        ends = [0]
        while ends[-1] < n:
            ends.append(end[ends[-1]])
        return ends

    def _best_ends(self, text: str) -> list[int]:
        """``forward`` over the whole of a part, in plain lists."""
        n, score_of = len(text), self.prefix_score
        best, back = [NONE] * (n + 1), [0] * (n + 1)
        best[0] = 0
        for start in range(n):
            value, end = best[start], start + 1
            score = score_of.get(text[start], NONE)
            if score == NONE:
                score = self.unknown_score
            while True:
                if value + score > best[end]:
                    best[end] = value + score
                    back[end] = start
                end += 1
                if end > n:
                    break
                score = score_of.get(text[start:end])
                if score is None:
                    break
        ends = [n]
        while ends[-1]:
            ends.append(back[ends[-1]])
        return ends[::-1]

    def units(self, text: str) -> list[str]:
        """Cut before every run of marks."""
        if not self.separable:
            return [text] if text else []
        if MARK + MARK in text:
            words, out = text.split(MARK), []
            marks = ""
            for i, w in enumerate(words):
                marks += MARK if i else ""
                if w:
                    out.append(marks + w)
                    marks = ""
            return out + [marks] if marks else out
        first, *rest = text.split(MARK)
        return ([first] if first else []) + [MARK + w for w in rest]

    def encode(self, text: str) -> bytes:
        units = self.units(text)
        found = list(map(self.known.get, units))
        if None in found:
            found = [x if x is not None else self.unit(u) for x, u in zip(found, units, strict=True)]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        # the mark that encoding puts in front; what stands for an unknown piece begins with a real blank
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")

    # -- chunks ------------------------------------------------------------------------------

    def cuts(self, text: str, lead: int) -> tuple[int, int] | None:
        """First and last place at or after ``lead`` where a boundary is certain."""
        if not self.separable:
            return None
        first = next((p for p in _mark_starts(text, lead)), None)
        if first is None:
            return None
        last = text.rfind(MARK, lead)
        while last > first and text[last - 1] == MARK:
            last -= 1
        return first, max(first, last)

    def transfer(self, text: str, lead: int) -> np.ndarray:
        """What ``matrix`` is for BPE models: (boundary, length) before text[lead:] to (boundary, length) before its end, four numbers each.

        ``text`` begins with the 2 * width - 1 characters before, if there are as many.
        """
        w, n, cut = self.width, len(text), self.cuts(text, lead)
        entries, states = [], {}
        for s in range(min(w - 1, lead) + 1):
            at = lead - s
            for length in range(min(w, at) + 1):
                piece = text[at - length : at]
                if length < 2 or piece in self.rank and self.fits("", piece):
                    states.setdefault(at, {})[length] = 1 << len(entries)
                    entries.append((s, length))
        if not cut:
            self.follow(text, lead, n, states)
            ends = [(bits, n - p, m) for p, d in states.items() if p > lead and n - p < w for m, bits in d.items()]
        else:
            if cut[0] > lead:
                self.follow(text, lead, cut[0], states)
            through = 0
            for bits in states.get(cut[0], {}).values():
                through |= bits
            tail = {cut[1]: {0: 1}}
            self.follow(text, cut[1], n, tail)
            ends = [(through, n - p, m) for p, d in tail.items() if n - p < w for m in d]
        return np.array([[*e, t, m] for bits, t, m in ends for i, e in enumerate(entries) if bits >> i & 1], np.float64).reshape(-1, 4)

    def _backs(self, text: str, low: int, high: int, best: dict) -> dict[int, int]:
        """Where every boundary came from; ``best`` gets the boundaries that are reached."""
        if not self.merges:
            return self.forward(text, low, high, best)
        self.follow(text, low, high, best)
        return {p: p - next(iter(d)) for p, d in best.items() if p > low}

    def matrix(self, text: str, lead: int) -> np.ndarray:
        """Max-plus matrix of text[lead:]; text[:lead] is what precedes it, ``width`` - 1 characters at most.

        Between the first and the last certain boundary all paths have the same score, which is left out: a constant
        that is common to all entries changes no choice.
        """
        w, n = self.width, len(text)
        cut = self.cuts(text, lead)
        out = np.full((w, w), NONE)
        stop = cut[0] if cut else n
        tail = {cut[1]: 0} if cut else {}
        if cut:
            self.forward(text, cut[1], n, tail)
        for s in range(min(w - 1, lead) + 1):
            best = {lead - s: 0}
            if s or stop > lead:
                self.forward(text, lead, stop, best)
            if cut:
                # the cut may be where the chunk begins
                value = best.get(stop, NONE)
                for p, more in tail.items():
                    if n - p < w:
                        out[s, n - p] = value + more
            else:
                for p, value in best.items():
                    if lead < p and n - p < w:
                        out[s, n - p] = value
        return out

    def walk(self, text: str, lead: int, entry: np.ndarray, exits: list[int]) -> list[list[int]]:
        """Boundaries of the best paths to every exit (characters before the end), from the entry boundary on."""
        n, cut = len(text), self.cuts(text, lead)
        if self.merges:
            start = {lead - s: {int(m): 1} for s, m in enumerate(entry) if m >= 0 and lead - s >= 0}
            certain = {0: 1}
        else:
            start = {lead - s: entry[s] for s in range(len(entry)) if entry[s] > NONE and lead - s >= 0}
            certain = 0
        if not cut:
            best = dict(start)
            back = self._backs(text, lead, n, best)
            return [_path(back, n - t, lead) if n - t in back else [] for t in exits]
        head = dict(start)
        back = self._backs(text, lead, cut[0], head) if cut[0] > lead else {}
        begin = _path(back, cut[0], lead)
        tail = {cut[1]: certain}
        after = self._backs(text, cut[1], n, tail)
        return [begin + [-1] + _path(after, n - t, cut[1]) if n - t in tail else [] for t in exits]

    def encode_chunk(self, text: str, lead: int, entry: np.ndarray, exit_state: int) -> bytes:
        (path,) = self.walk(text, lead, entry, [exit_state])
        if -1 not in path:
            return self.ids(text, path)
        at = path.index(-1)
        begin, end = path[:at], path[at + 1 :]
        return self.ids(text, begin) + self.encode(text[begin[-1] : end[0]]) + self.ids(text, end)

    def entries(self, text: str, lead: int, entry: np.ndarray) -> list[int]:
        """For every exit boundary the entry boundary of its path; -1 if none."""
        return [lead - p[0] if p else -1 for p in self.walk(text, lead, entry, list(range(self.width)))]


def _mark_starts(text: str, lead: int) -> Iterator[int]:
    at = text.find(MARK, lead)
    while at >= 0:
        if at == 0 or text[at - 1] != MARK:
            yield at
        at = text.find(MARK, at + 1)


def _path(back: dict[int, int], end: int, low: int) -> list[int]:
    out = [end]
    while out[-1] > low:
        out.append(back[out[-1]])
    return out[::-1]


def model(path: str) -> Model:
    """One per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


# -- the scan over chunks --------------------------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _apply(vector: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (vector[:, None] + m).max(axis=0)


def _sparse_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of ``transfer`` matrices: their finite entries are 0, so it holds the pairs that meet."""
    left, right = ({} for _ in range(2))
    for *e, t, m in a.reshape(-1, 4).tolist():
        left.setdefault((t, m), []).append(e)
    for *e, t, m in b.reshape(-1, 4).tolist():
        right.setdefault(tuple(e), []).append([t, m])
    met = {(*e, *x) for k in left.keys() & right.keys() for e in left[k] for x in right[k]}
    return np.array(sorted(met), np.float64).ravel()


def _sparse_apply(vector: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Length of the piece before each boundary, -1 if that is none."""
    out = np.full(len(vector), -1.0)
    for s, length, t, after in m.reshape(-1, 4).tolist():
        if vector[int(s)] == length:
            out[int(t)] = after
    return out


def _chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Maps are looked up: a state goes through ``first``, then ``second``."""
    return np.where(first >= 0, second[np.maximum(first, 0).astype(int)], -1)


def _look_up(state: np.ndarray, m: np.ndarray) -> np.ndarray:
    return m[state.astype(int)]


def scan(items: DataFrame, first: list[float], combine: Callable, apply: Callable, square: bool, fan: int = FAN) -> DataFrame:
    """key, n, value to key, n, state: the state before item n, starting from ``first``.

    ``combine`` is associative, so blocks of ``fan`` items are combined in parallel, then blocks of blocks, and
    states come down the same way. No task holds more than ``fan`` values of a document. Runs jobs.
    """
    side = len(first) if square else 0

    def value(x):
        return np.asarray(x, dtype=np.float64).reshape(side, side) if side else np.asarray(x, dtype=np.float64)

    def states(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        rows = rows.sort_values("n")
        out = []
        for x in rows["value"]:
            out.append(np.atleast_1d(state).tolist())
            state = apply(state, value(x))
        return pd.DataFrame({"a": rows["a"], "b": rows["b"], "n": rows["n"], "state": out})

    result = "a bigint, b bigint, n bigint, state array<double>"
    highest = items.agg(F.max("n")).first()[0]
    if highest is None or highest < fan:
        begin = np.asarray(first)
        return items.groupBy("a", "b").applyInPandas(lambda rows: states(rows, begin), result)

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        total = None
        for x in rows["value"]:
            total = value(x) if total is None else combine(total, value(x))
        one = rows.iloc[:1]
        return pd.DataFrame({"a": one["a"], "b": one["b"], "n": one["n"] // fan, "value": [total.ravel().tolist()]})

    blocks = items.withColumn("block", F.floor(F.col("n") / fan))
    above = table(blocks.groupBy("a", "b", "block").applyInPandas(product, "a bigint, b bigint, n bigint, value array<double>"), "blocks")
    entered = table(scan(above, first, combine, apply, square, fan), "block-states").withColumnRenamed("n", "block")

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = np.asarray(right["state"].iloc[0])
        return states(left, state)

    keys = ["a", "b", "block"]
    return blocks.groupBy(*keys).cogroup(entered.groupBy(*keys)).applyInPandas(inside, result)


def _chunk_rows(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = m.normal(body.decode("utf-8", "replace"))
                starts = range(0, len(text), chunk)
                for n, at in enumerate(starts):
                    lead = min(at, 2 * m.width - 1 if m.merges else m.width - 1)
                    part = text[at - lead : at + chunk]
                    yield pa.RecordBatch.from_pylist(
                        [{"a": key["a"], "b": key["b"], "n": n, "last": len(starts) - 1, "lead": lead, "text": part}],
                        schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("lead", pa.int32()), ("text", pa.string())]),
                    )

    return docs.mapInArrow(giving_back(rows), "a bigint, b bigint, n bigint, last bigint, lead int, text string")


def _per_chunk(chunks: DataFrame, path: str, work: Callable, kind: str) -> DataFrame:
    """a, b, n, last and the array that ``work`` makes of each row."""
    names = ["a", "b", "n", "last"]
    inner = pa.list_(pa.float64() if kind == "double" else pa.int32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                made = work(m, one.to_pylist()[0])
                yield pa.RecordBatch.from_arrays(
                    [one.column(one.schema.names.index(n)) for n in names] + [pa.array([made], inner)], names=[*names, "value"]
                )

    return chunks.mapInArrow(giving_back(rows), f"a bigint, b bigint, n bigint, last bigint, value array<{kind}>")


def _scanned_ids(long: DataFrame, path: str, width: int, chunk: int, fan: int) -> DataFrame:
    """``__key``, ids, n_chunks of documents that are cut into chunks. Runs jobs."""
    spread = _chunk_rows(long.dropDuplicates([_KEY]), path, chunk).repartition("a", "b", "n")
    merges = model(path).merges
    chunks = table(spread, "chunks")
    if merges:
        matrices = _per_chunk(chunks, path, lambda m, r: m.transfer(r["text"], r["lead"]).ravel().tolist(), "double")
        first, rule = [0.0] + [-1.0] * (width - 1), (_sparse_times, _sparse_apply, False)
    else:
        matrices = _per_chunk(chunks, path, lambda m, r: m.matrix(r["text"], r["lead"]).ravel().tolist(), "double")
        first, rule = [0.0] + [NONE] * (width - 1), (_times, _apply, True)
    entry = table(scan(table(matrices, "matrices"), first, *rule, fan), "entries")
    entered = table(chunks.join(entry, ["a", "b", "n"]), "entered")
    maps = _per_chunk(entered, path, lambda m, r: [float(x) for x in m.entries(r["text"], r["lead"], np.asarray(r["state"]))], "double")
    # from the right: the exit boundary of a chunk is the entry boundary of the next one
    backward = table(maps.withColumn("n", F.col("last") - F.col("n")), "maps")
    leaving = scan(backward, [0.0], _chain, _look_up, False, fan).withColumnRenamed("state", "exit")
    ends = table(leaving, "exits").withColumnRenamed("n", "m")
    both = entered.withColumn("m", F.col("last") - F.col("n")).join(ends, ["a", "b", "m"])
    coded = _per_chunk(
        both, path, lambda m, r: list(array("I", m.encode_chunk(r["text"], r["lead"], np.asarray(r["state"]), int(r["exit"][0])))), "int"
    )
    return _joined(coded)


def _joined(coded: DataFrame) -> DataFrame:
    """Ids of chunks to ids of documents."""
    parts = coded.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("parts"))
    return parts.select(
        F.struct("a", "b").alias(_KEY), F.flatten("parts.value").alias("__ids"), F.size("parts").alias("__n_chunks")
    )


def _with_ids(rows: DataFrame, path: str) -> DataFrame:
    """Encode documents of one chunk; the last column, ``__body``, gives way to ``__ids``."""
    rest = [f for f in rows.schema.fields if f.name != "__body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                names = batch.schema.names
                bodies = batch.column(names.index("__body")).to_pylist()
                packed = [m.encode(m.normal(b.decode("utf-8", "replace"))) for b in bodies]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(f.name)) for f in rest] + [int_lists(packed)], names=[f.name for f in rest] + ["__ids"]
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "__ids array<int>"
    return rows.mapInArrow(giving_back(run), schema)


def int_lists(packed: list[bytes]) -> pa.ListArray:
    flat = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def encode(
    docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", chunk_chars: int = CHUNK_CHARS, fan: int = FAN, keep_text: bool = True
) -> DataFrame:
    """All columns of ``docs``, and ``ids`` (array<int>) and ``n_chunks``. Runs jobs for long documents.

    Without ``keep_text`` the text is left out: it then goes to the Python workers once and does not come back.
    """
    m = model(path)
    if chunk_chars < m.width:
        raise ValueError(f"chunks must be as long as the longest piece, {m.width} characters")
    columns = [c for c in docs.columns if c not in ("ids", "n_chunks")]
    named = {c: f"c{i}" for i, c in enumerate(columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    kept = {c: n for c, n in named.items() if keep_text or c != text}
    body = F.coalesce(F.col(named[text]), F.lit(""))
    giant = F.char_length(body) >= chunk_chars
    short = _with_ids(plain.where(~giant).select(*kept.values(), text_bytes(named[text]).alias("__body")), path).withColumn("__n_chunks", F.lit(1))
    keyed = plain.where(giant).withColumn(_KEY, row_key(named[id_column], named[text]))
    found = _scanned_ids(keyed.select(_KEY, text_bytes(named[text]).alias("body")), path, m.width, chunk_chars, fan)
    long = keyed.select(*kept.values(), _KEY).join(found, _KEY).drop(_KEY)
    return short.unionByName(long).select(
        *[F.col(n).alias(c) for c, n in kept.items()], F.col("__ids").alias("ids"), F.col("__n_chunks").alias("n_chunks")
    )


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; null ids give null, bytes that are no UTF-8 become replacement characters."""
    columns = [f for f in rows.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                names = batch.schema.names
                lists = batch.column(names.index(ids))
                ends, there = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
                flat = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).tobytes()
                at = 4 * (ends.astype(np.int64) - ends[0])
                texts = [m.decode(flat[at[i] : at[i + 1]]) if there[i] else None for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(f.name)) for f in columns] + [pa.array(texts, pa.string())],
                    names=[f.name for f in columns] + [out],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns) + f"`{out}` string"
    return rows.mapInArrow(giving_back(run), schema)
