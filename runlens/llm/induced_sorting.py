"""Suffix array of one shard by induced sorting, and common prefixes in text order. Numpy only.

Suffixes are classified as L (larger than the next one) or S (smaller). The leftmost S of a run, LMS for short, cuts the
text into substrings; their order induces that of all L suffixes in one pass over the buckets upwards and that
of all S suffixes in one pass downwards. A bucket (one symbol) is handled in batches, so work is linear in vector
operations. Equal substrings get equal names; if names repeat, the string of names, which is at most
half as long, is sorted itself: its alphabet is as large as itself, so that is done by doubling ranks, and only as far
as ``depth`` symbols of the text, beyond which order does not matter here.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (small positive integers), sorted by their first ``depth`` symbols at least."""
    t = np.append(text, 0).astype(np.uint16)
    if len(t) == 1:
        return np.empty(0, np.int32)
    small = _small(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    by_substring = _induce(t, small, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = by_substring[is_lms[by_substring]]
    names = np.cumsum(_differ(t, ordered, lms)) - 1
    if names[-1] + 1 < len(lms):
        place = np.empty(len(t), np.int32)
        place[lms] = np.arange(len(lms))
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ordered]] = names
        ordered = lms[_sort_names(reduced, depth)]
    return _induce(t, small, ordered)[1:]


def _small(t: np.ndarray) -> np.ndarray:
    """True for S. Within a run of equal symbols the symbol after the run decides."""
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _deal(rows: np.ndarray, symbols: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append rows to the buckets of their symbols, keeping their order."""
    if not len(rows):
        return
    order = np.argsort(symbols, kind="stable")
    rows, symbols = rows[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for at, part in zip(np.concatenate([[0], cuts]), np.split(rows, cuts), strict=True):
        buckets[symbols[at]].append(part)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the order of ``lms`` induces."""
    size = int(t.max()) + 1
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(lms, t[lms], seeds)
    done: list[np.ndarray] = []
    for c in range(size):
        batch, out = _join(large[c]), []
        while len(batch):
            out.append(batch)
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            same = t[before] == c
            _deal(before[~same], t[before[~same]], large)
            batch = before[same]
        done.append(_join(out))
        before = _join(seeds[c])
        before = before[before > 0] - 1
        _deal(before, t[before], large)
    downwards: list[list[np.ndarray]] = [[] for _ in range(size)]
    downwards[0].append(np.array([len(t) - 1], np.int32))
    parts: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        batch, out = _join(downwards[c]), []
        while len(batch):
            out.append(batch)
            before = batch[batch > 0] - 1
            before = before[small[before]]
            same = t[before] == c
            _deal(before[~same], t[before[~same]], downwards)
            batch = before[same]
        parts.append(_join(out)[::-1])
        parts.append(done[c])
        before = done[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        _deal(before, t[before], downwards)
    return np.concatenate(parts[::-1])


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _differ(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Whether each LMS substring, up to and with the next LMS position, differs from the one sorted before it."""
    ends = np.append(lms[1:], lms[-1])
    length = np.zeros(len(t), np.int32)
    length[lms] = ends - lms
    out = np.ones(len(ordered), bool)
    out[1:] = length[ordered[1:]] != length[ordered[:-1]]
    open_ = np.flatnonzero(~out)
    k = 0
    while len(open_):
        a, b = ordered[open_], ordered[open_ - 1]
        differs = t[a + k] != t[b + k]
        out[open_[differs]] = True
        open_ = open_[~differs & (length[a] > k)]
        k += 1
    return out


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of the names; every name stands for two symbols of the text or more."""
    rank, n, span = names, len(names), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        span *= 2
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if new[-1] == n - 1 or span * 2 > depth + 2:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new


def repeated_starts(raw: bytes, order: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """True where the ``length`` bytes from a valid start also begin at another valid start.

    Common prefixes are taken in text order (permuted), each with the suffix sorted just before it, eight bytes at a time
    and no further than ``length``.
    """
    before = np.full(len(raw), -1, np.int32)
    before[order[1:]] = order[:-1]
    a = np.flatnonzero(valid & (before >= 0))
    b = before[a]
    a, b = a[valid[b]], b[valid[b]]
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)) if length >= 8 and len(raw) >= 8 else None
    steps = [*range(0, length - 7, 8), length - 8] if words is not None else range(length)
    bytes_ = words if words is not None else np.frombuffer(raw, np.uint8)
    for k in steps:
        same = bytes_[a + k] == bytes_[b + k]
        a, b = a[same], b[same]
    out = np.zeros(len(raw), bool)
    out[a] = True
    out[b] = True
    return out
