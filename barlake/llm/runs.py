"""Periodic runs of words: stretches that repeat a block of words four times or more, found by Lyndon words.

A run begins with Lyndon words, in one of the two orders of the alphabet, that are each the longest one at their place.
The longest Lyndon word at a place ends before the next smaller suffix, so a stack of suffixes in each order, with the
lengths to which neighbours on it match, names all runs. Lengths are reused: inside a stretch that matched before they
are those of its earlier copy, and matching goes on only past the furthest word seen. Words are only compared, never
hashed, and there is no suffix structure.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import map_rows

#: A run has so many words and periods at least.
LEAST, TIMES = 6, 4
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def one_order(x: list[bytes], up: bool, out: list[tuple[int, int, int]]) -> None:
    """Adds (start, length, period) of the runs whose Lyndon words follow one order of the words: up, or its reverse.

    prev and after hold the nearest smaller suffix on either side, back and ahead how many words those share with it,
    near how many a suffix shares with the one before it. The words from b to e equal those from a on.
    """
    n = len(x)
    prev, after, back, ahead, near = [-1] * n, [n] * n, [0] * n, [0] * n, [0] * n
    told: list[int] = []
    a = b = e = 0
    for i in range(1, n):
        j, m = i - 1, 0
        if i < e:
            m = near[i - b + a]
            if m >= e - i:
                m = e - i
                while i + m < n and x[i + m] == x[j + m]:
                    m += 1
                if i + m > e:
                    a, b, e = j, i, i + m
            near[i] = m
        elif x[i] == x[j]:
            m = 1
            while i + m < n and x[i + m] == x[j + m]:
                m += 1
            a, b, e = j, i, i + m
            near[i] = m
        while i + m == n or (x[i + m] < x[j + m]) == up:
            after[j], ahead[j], q = i, m, i - j
            if m > (TIMES - 2) * q:
                # The first Lyndon word of a run begins in its first period, so little is left to its left.
                told = told or [0] * n
                if told[q] != i + m:
                    told[q], s = i + m, j
                    while s and x[s - 1] == x[s - 1 + q]:
                        s -= 1
                    if i + m - s >= max(LEAST, TIMES * q):
                        out.append((s, i + m - s, q))
            r, j = back[j], prev[j]
            if j < 0:
                m = 0
                break
            if r < m:
                m = r
                break
            if r == m:
                start = m
                if i < e and j >= b:
                    k, p = i - b + a, j - b + a
                    known = ahead[p] if after[p] == k else back[k] if prev[k] == p else m
                    m = max(m, min(known, e - i))
                    if m < e - i and known > start:
                        continue
                while i + m < n and x[i + m] == x[j + m]:
                    m += 1
                if i + m > e and m:
                    a, b, e = j, i, i + m
        prev[i], back[i] = j, m


def runs(x: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period, of all runs of the words x."""
    out: list[tuple[int, int, int]] = []
    if len(x) >= LEAST:
        one_order(x, True, out)
        one_order(x, False, out)
        out.sort()
    return [r for k, r in enumerate(out) if not k or r != out[k - 1]]


def collapsed(x: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """x with one period left of each run."""
    if not found:
        return x
    keep = bytearray(b"\1") * len(x)
    for s, size, q in found:
        keep[s + q : s + size] = bytes(size - q)
    return [w for w, k in zip(x, keep, strict=True) if k]


def planted(x: list[bytes], doc_id: int | None) -> list[bytes]:
    """x, where one id in ten makes the words from a place on repeat a period; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not x:
        return x
    g, n = h // 10, len(x)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return x[:a] + (x[a : a + p] * ((n - a) // p + 1))[: n - a]


def find(df: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_runs, the longest run (start, length, period and exponent in thousandths, ties to
    the smallest start, then period; four nulls without one), the digest of all runs, and the text with one period left of
    each, its words joined by one space.

    Words are what ASCII white space parts. Rows are judged each by itself, whether or not they share an id or have one;
    null and empty texts have no words and no runs; an empty table gives no rows; other columns are not looked at. plant
    makes texts repeat before they are looked at, for measurements. A text costs time in proportion to its words, however
    it repeats, and is held by one task.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = (text.as_py() or "").encode().split()
            if plant:
                x = planted(x, i)
            found = runs(x)
            s, size, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
            told = (i, len(found), s, size, q, 1000 * size // q if found else None, digest, b" ".join(collapsed(x, found)).decode())
            for name, v in zip(out, told, strict=True):
                out[name].append(v)
        return out

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, COLUMNS)
