"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

A window of m characters of an item that occurs in a document with at most k edits shares m - q + 1 - k q of its q-grams
with it, on diagonals at most k apart. Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half,
so that the diagonals of any such occurrence lie in one band. Windows begin at every character of the item; those that
reach the count in a band are aligned, all at once. Windows that occur as they are come first, by their hashes: what lies
inside a stretch found so far needs no pairs of places and no alignment, so that repetitive texts cost little. Pairs of
places are made for a part of the text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import SLICE, give_back, halves, id_text

#: Production parameters: q-gram length, window of an item, edits allowed in a window.
Q, WINDOW, EDITS = 10, 64, 4
#: Windows of an item that are aligned at once.
WINDOWS = 4096
#: Pairs of an item's and a text's places that are held at once, about.
PAIRS = 1 << 20
#: Pairs from which windows that occur as they are are looked for first.
EXACT_FIRST = 1 << 16
#: Text of the items that one pass over the documents takes, at most: so much is broadcast.
ITEM_BYTES = 8 << 20
_HASH, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 22


def fold(text: str) -> str:
    """Lower case, character by character, so that offsets stay; every white space is a space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for blank in "\t\n\x0b\x0c\r\x85\xa0\u2028\u2029":
        low = low.replace(blank, " ")
    return low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from those of powers of two."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, size = None, 0, 1
    with np.errstate(over="ignore"):
        part = points.astype(np.uint64) * _MIX
        part ^= part >> np.uint64(31)
        while size <= q:
            if q & size:
                out = part[at : at + n].copy() if out is None else out * _power(size) + part[at : at + n]
                at += size
            if size * 2 <= q:
                part = part[:-size] * _power(size) + part[size:]
            size *= 2
        out *= _MIX
        return out ^ out >> np.uint64(32)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_HASH), k, 1 << 64))


def needed(length: int, q: int, window: int, edits: int) -> tuple[int, int, int]:
    """Window, edits and shared q-grams of an item: one shorter than a window is a window, with its share of the edits."""
    m = min(window, length)
    k = edits * m // window
    return m, k, max(1, m - q + 1 - k * q)


class Items:
    """The q-grams of all items, sorted by hash, each once for an item, and a bit table that rules most grams out."""

    def __init__(self, items: list[tuple[int, str]], q: int):
        self.ids, self.q = [i for i, _ in items], q
        self.points = [codes(fold(t)) for _, t in items]
        per_item = [np.unique(grams(p, q)) for p in self.points]
        h = np.concatenate([*per_item, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(x) for x in per_item])
        order = np.argsort(h, kind="stable")
        self.h, self.item = h[order], item[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self._need: dict[tuple, np.ndarray] = {}
        self._places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._windows: dict[tuple[int, int], np.ndarray] = {}

    def need(self, *sizes: int) -> np.ndarray:
        """The shared q-grams that each item needs."""
        if sizes not in self._need:
            self._need[sizes] = np.array([needed(len(p), *sizes)[2] for p in self.points])
        return self._need[sizes]

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of one item's q-grams, sorted, and their places."""
        if k not in self._places:
            h = grams(self.points[k], self.q)
            order = np.argsort(h, kind="stable")
            self._places[k] = h[order], order
        return self._places[k]

    def windows(self, k: int, m: int) -> np.ndarray:
        """Hashes of one item's windows of m characters."""
        if (k, m) not in self._windows:
            self._windows[k, m] = np.unique(grams(self.points[k], m))
        return self._windows[k, m]


@lru_cache(maxsize=4)
def prepared(items: tuple[tuple[int, str], ...], q: int) -> Items:
    return Items(list(items), q)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int] | None:
    """Fewest edits and end of an occurrence of pattern in text along diagonals low to high, or None beyond limit.

    Row by row over the band: column d is the diagonal low + d; its text place is row + low + d.
    """
    width, n = high - low + 1, len(text)
    big = limit + 1
    start = np.arange(low, high + 1)
    cost = np.where((start >= 0) & (start <= n), 0, big)
    steps = np.arange(width)
    for row in range(len(pattern)):
        at = row + low + steps
        inside = (at >= 0) & (at < n)
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == pattern[row]
        diagonal = np.where(inside, cost + ~same, big)
        above = np.append(cost[1:], big) + 1
        best = np.minimum(diagonal, above)
        best = np.where((at + 1 >= 0) & (at + 1 <= n), best, big)
        cost = np.minimum(np.minimum.accumulate(best - steps) + steps, big)
        if cost.min() > limit:
            return None
    d = int(cost.argmin())
    return (int(cost[d]), len(pattern) + low + d) if cost[d] <= limit else None


def align_windows(item: np.ndarray, windows: np.ndarray, m: int, text: np.ndarray, low: int, high: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """align() of all windows (their starts) of m characters at once: fewest edits, above limit if there are more, and ends.

    The diagonals low to high are text place less item place.
    """
    width, n, big = high - low + 1, len(text), limit + 1
    steps = np.arange(width)
    at = windows[:, None] + low + steps
    cost = np.where((at >= 0) & (at <= n), 0, big)
    for row in range(m):
        inside = (at >= 0) & (at < n)
        same = inside & (text[np.clip(at, 0, n - 1)] == item[windows + row][:, None])
        best = np.where(inside, cost + ~same, big)
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        at = at + 1
        best = np.where((at >= 0) & (at <= n), best, big)
        cost = np.minimum(np.minimum.accumulate(best - steps, axis=1) + steps, big)
    d = cost.argmin(axis=1)
    return cost[np.arange(len(windows)), d], windows + m + low + d


class Stretches:
    """Disjoint stretches of a text in order, each with the edits of its first window."""

    def __init__(self):
        self.all: list[tuple[int, int, int]] = []

    def add(self, found: list[tuple[int, int, int]]) -> None:
        merged: list[tuple[int, int, int]] = []
        for s, e, d in sorted(self.all + found):
            if merged and s <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(e, merged[-1][1]), merged[-1][2]
            else:
                merged.append((s, e, d))
        self.all = merged

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not self.all:
            return np.zeros(len(start), bool)
        s, e = (np.array([x[k] for x in self.all]) for k in (0, 1))
        at = np.searchsorted(s, start, "right") - 1
        return (at >= 0) & (e[at] >= end)


def matches(text: str, items: Items, q: int = Q, window: int = WINDOW, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits of the first window) for each stretch of text that items' windows occur in."""
    points = codes(fold(text))
    h = grams(points, q)
    at = np.flatnonzero(items.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(at):
        return []
    first, last = (np.searchsorted(items.h, h[at], side) for side in ("left", "right"))
    n = last - first
    item = items.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    count = np.bincount(item, minlength=len(items.ids))
    wanted = count >= items.need(q, window, edits)
    if not wanted.any():
        return []
    pos = np.repeat(at, n)
    some = wanted[item]
    item, pos = item[some], pos[some]
    order = np.argsort(item, kind="stable")
    item, pos = item[order], pos[order]
    cuts = np.flatnonzero(np.append(True, np.diff(item) != 0))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(item)), strict=True):
        found = occurrences(int(item[a]), items, points, pos[a:b], h[pos[a:b]], q, window, edits)
        out += [(int(item[a]), s, e, d) for s, e, d in found.all]
    return out


def occurrences(k: int, items: Items, points: np.ndarray, at: np.ndarray, h: np.ndarray, q: int, window: int, edits: int) -> Stretches:
    """All occurrences of one item's windows with edits; at are the places of q-grams of the item in the text, h their hashes.

    Where pairs of places are many, windows that occur as they are come first, and places of the text from which an
    occurrence can only lie inside a known stretch are left out. The rest is taken in parts with so many pairs of places;
    parts overlap by the longest occurrence.
    """
    m, limit, need = needed(len(items.points[k]), q, window, edits)
    known, reach = Stretches(), m + 2 * limit + q
    # An occurrence holds so many places of grams within its length.
    near = at[need - 1 :] - at[: len(at) - need + 1] <= reach
    if not near.any():
        return known
    own, place = items.places(k)
    first, last = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
    n = last - first
    if n.sum() > EXACT_FIRST:
        exact = np.flatnonzero(np.isin(grams(points, m), items.windows(k, m)))
        if len(exact):
            known.add([(int(x[0]), int(x[-1]) + m, 0) for x in np.split(exact, np.flatnonzero(np.diff(exact) > m) + 1)])
        left = ~known.inside(at - reach, at + reach)
        at, n, first = at[left], n[left], first[left]
    i = 0
    while i < len(at) and len(at) - i >= need:
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), PAIRS, "right")) + i)
        end = int(np.searchsorted(at, at[j - 1] + reach, "right"))
        part = slice(i, end)
        pos = np.repeat(at[part], n[part])
        entry = np.arange(len(pos)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(first[part], n[part])
        region(items.points[k], points, place[entry], pos, known, q, window, edits)
        i = j
        if i < len(at):
            left = ~known.inside(at[i:] - reach, at[i:] + reach)
            at, n, first, i = at[i:][left], n[i:][left], first[i:][left], 0
    return known


def region(item: np.ndarray, points: np.ndarray, place: np.ndarray, pos: np.ndarray, known: Stretches, q: int, window: int, edits: int) -> None:
    """Adds to known where windows of one item align with a part of one document, given their pairs of equal q-grams."""
    m, k, need = needed(len(item), q, window, edits)
    diagonal, step = pos - place, k + 1
    bands = np.concatenate([diagonal // step, diagonal // step - 1])
    place = np.concatenate([place, place])
    order = np.argsort(bands, kind="stable")
    bands, place = bands[order], place[order]
    heads = np.flatnonzero(np.append(True, np.diff(bands) != 0))
    for a, b in zip(heads, np.append(heads[1:], len(bands)), strict=True):
        if b - a < need:
            continue
        low, high = int(bands[a]) * step, int(bands[a]) * step + 2 * step - 1
        # Distinct shared places before each place of the item, so that each window's count is one difference.
        shared = np.zeros(max(len(item) - q + 1, 0) + 1, np.int64)
        shared[place[a:b] + 1] = 1
        shared = np.cumsum(shared)
        count = shared[m - q + 1 :] - shared[: len(shared) - (m - q + 1)]
        windows = np.flatnonzero(count >= need)
        windows = windows[~known.inside(windows + low - 2 * k, windows + m + high + 2 * k)]
        for i in range(0, len(windows), WINDOWS):
            w = windows[i : i + WINDOWS]
            cost, end = align_windows(item, w, m, points, low - k, high + k, k)
            hit = cost <= k
            if hit.any():
                known.add(list(zip(np.maximum(0, end - m - cost)[hit].tolist(), end[hit].tolist(), cost[hit].tolist(), strict=True)))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark's rows, streamed in blocks of at most block_bytes of text."""
    block, size = [], 0
    rows = benchmark.where(F.length(text_col) > 0).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r.t) * 4 > block_bytes:
            yield tuple(block)
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t) * 4
    if block:
        yield tuple(block)


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, edits: int = EDITS, block_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits: the stretches of documents that hold windows of a benchmark item.

    Windows begin at every character of an item; edits are those of the stretch's first window.
    Case and the kind of white space do not count. Items shorter than a window must occur whole, with their share of the
    edits; items or texts shorter than a q-gram never match. Null and empty texts match nothing. Repeated rows give
    repeated results, an empty table on either side none; other columns are not looked at. The items travel with the
    tasks in blocks of block_bytes; a larger benchmark takes as many passes over the documents.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start int, end int, edits int"
    out = spark.createDataFrame([], schema)
    texts = id_text(docs, id_col, text_col)
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        out = out.unionByName(texts.mapInArrow(_search(sent, q, window, edits), schema))
    return out


def _search(sent, q: int, window: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = prepared(sent.value, q)
        for batch in (part for whole in batches if whole.num_rows for part in halves(whole, SLICE)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, items.ids[k], s, e, d) for k, s, e, d in matches(text, items, q, window, edits)]
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])
        give_back()

    return run
