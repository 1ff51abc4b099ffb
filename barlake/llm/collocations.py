"""Phrases whose words stand together more often than apart: candidates from sketches, counted exactly by automata.

The texts are read four times. The first two passes fill count-min sketches of word pairs, and of longer phrases that begin
with a pair that may be frequent; a cell's sum is an upper bound of each of its phrases' counts, so no frequent phrase is
lost. The third tells the phrases of the cells that reach the bound: of each cell those of one block of text, its witness.
The fourth counts these phrases and their words where their cells lie, byte by byte: a cell whose phrases' counts fall short
of its sum has others, which are then told and counted without a witness. So the first phrases of each language are known.
The last runs Aho-Corasick automata of these and of their parts, each between spaces, over every text and counts all matches,
overlapping ones too; their number does not grow with the texts. Tasks send sums only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.llm.common import SLICE, Scratch, halves

#: Least count of a phrase, number of words at most, phrases told per language, and the share that makes a longer one cover it.
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Cells of the sketch as a power of two; bytes of sketch that one task sums; cells, phrases with cells, and patterns of
#: automata that are broadcast at once.
CELLS, PART_BYTES, CELLS_AT_ONCE, PHRASES_AT_ONCE, PATTERNS_AT_ONCE = 44, 32 << 20, 4_000_000, 2_000_000, 400_000
#: Bits of a phrase's number that one task sums, and bytes from which phrases are compared one by one.
SUMMED_BITS, LONG = 16, 256
#: Entries that a task gathers before it sums and sends them, phrases it remembers, and bytes of text looked at together.
GATHER, TOLD, BLOCK = 4_000_000, 300_000, 1 << 20

BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Base of the hash of bytes, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def spaced(texts: Iterable[bytes]) -> bytes:
    """The words of texts, lower-cased, with one space on both sides of each; a line feed stands for a word between pieces."""
    out = b" " + b"\n".join(texts).translate(TABLE).replace(b"\n", b" \n ") + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """text in blocks of some size bytes, parted between pieces; a longer piece is one block."""
    low = 0
    while low < len(text) - 1:
        end = text.rfind(b" \n ", low, low + size)
        if end < 0 or low + size >= len(text):
            end = text.find(b" \n ", low + size)
        end = len(text) - 1 if end < 0 else end
        yield text[low : end + 1]
        low = end + 2


@lru_cache(2)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Grams:
    """The words of a block, and a cell of the sketch for each phrase of k of them."""

    def __init__(self, block: bytes, lang: str):
        buffer = np.frombuffer(block, np.uint8)
        at = np.flatnonzero(buffer == 32)
        self.block, self.starts, self.ends = block, at[:-1] + 1, at[1:]
        self.breaks = np.concatenate([[0], np.cumsum(buffer[self.starts] == 10)])
        self.n_words = len(self.starts) - int(self.breaks[-1])
        size = 1 << max(20, int(len(buffer)).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(buffer)])])
        self.back, self.seed = powers(INVERSE, size), np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def places(self, k: int) -> np.ndarray:
        """Words with which a phrase of k words of one piece begins."""
        return np.flatnonzero(self.breaks[k:] == self.breaks[: max(0, len(self.breaks) - k)])

    def cells(self, at: np.ndarray, k: int) -> np.ndarray:
        start = self.starts[at]
        return mixed((self.sums[self.ends[at + k - 1]] - self.sums[start]) * self.back[start] + self.seed) >> np.uint64(64 - CELLS)

    def phrases(self, at: np.ndarray, k: int, cells: np.ndarray) -> set[tuple[bytes, int, int]]:
        return {(self.block[a:b], k, c) for a, b, c in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist(), cells.tolist(), strict=True)}


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, spaced texts) of slices of the batches."""
    for batch in batches:
        for part in halves(batch, SLICE) if batch.num_rows else ():
            each: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                each.setdefault(lang, []).append((text.as_py() or "").encode())
            for lang in each:
                yield lang, spaced(each[lang])
    pa.default_memory_pool().release_unused()


#: Cell, count and witness, the least of 16 bits of the hashes of the blocks that have a phrase of the cell.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(parts: list[Entries]) -> Entries:
    """Distinct cells in order, the sums of their counts, and their witnesses."""
    c, n, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(c):
        return c, n, w
    order = np.argsort(c, kind="stable")
    c = c[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[first], np.add.reduceat(n[order].astype(np.int64), first), np.minimum.reduceat(w[order], first)


def witness(block: bytes) -> int:
    return xxhash.xxh64_intdigest(block) & 0xFFFF


def sketch(docs: DataFrame, pick: Callable[[Grams], Iterator[np.ndarray]], part_bits: int, count_words: bool) -> DataFrame:
    """(part, lang, cells, counts, witnesses, n): of each task's phrases, the sums of the cells in each part of the sketch;
    with count_words also the number of words of each language, part -1."""
    shift = np.uint64(CELLS - part_bits)
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("cells", pa.binary()), ("counts", pa.binary()), ("witnesses", pa.binary()), ("n", pa.int64())])

    def told(entries: Entries) -> Iterator[pa.RecordBatch]:
        c, n, w = entries
        part = (c >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(c) else [0]
        low = (c & ((np.uint64(1) << shift) - np.uint64(1))).astype("<u4")
        rows = [{"part": int(part[a]), "lang": None, "cells": low[a:b].tobytes(), "counts": n[a:b].astype("<u4").tobytes(), "witnesses": w[a:b].astype("<u2").tobytes(), "n": None} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, words = [], 0, {}
        for lang, text in by_lang(batches):
            for block in blocks(text):
                grams, mark = Grams(block, lang), witness(block)
                words[lang] = words.get(lang, 0) + grams.n_words
                for found in pick(grams):
                    c, n = np.unique(found, return_counts=True)
                    parts.append((c, n.astype(np.int64), np.full(len(c), mark, np.uint16)))
                    size += len(c)
                if size > GATHER:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
                    if size > GATHER // 2:
                        yield from told(parts[0])
                        parts, size = [], 0
        if size:
            yield from told(summed(parts))
        if count_words:
            yield pa.RecordBatch.from_pylist([{"part": -1, "lang": k, "n": v} for k, v in words.items()], schema=schema)

    return docs.mapInArrow(run, "part int, lang string, cells binary, counts binary, witnesses binary, n long")


def heavy(sums: DataFrame, least: int, part_bits: int) -> DataFrame:
    """(part, cells, sums, witnesses, n): the cells that reach least. A part is some PART_BYTES of sums, for one task."""
    shift = CELLS - part_bits

    def one(key: tuple, table: pa.Table) -> pa.Table:
        columns = [[np.frombuffer(x.as_buffer(), kind) for x in table.column(name)] for name, kind in (("cells", "<u4"), ("counts", "<u4"), ("witnesses", "<u2"))]
        c, n, w = summed(list(zip(*columns, strict=True)))
        c, n, w = c[n >= least].astype(np.uint64) + (np.uint64(key[0].as_py()) << np.uint64(shift)), n[n >= least], w[n >= least]
        binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": binary(c, "<u8"), "sums": binary(n, "<i8"), "witnesses": binary(w, "<u2"), "n": pa.array([len(c)], pa.int64())})

    return sums.where("part >= 0").select("part", "cells", "counts", "witnesses").groupBy("part").applyInArrow(one, "part int, cells binary, sums binary, witnesses binary, n long")


def rounds(found: DataFrame, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted cells of found and their witnesses, as many parts at a time as at_once allows, so that each is bounded."""
    group, size = [], 0
    for part, n in sorted((r.part, r.n) for r in found.where("n > 0").groupBy("part").agg(F.sum("n").alias("n")).collect()):
        if group and size + n > at_once:
            yield cells_of(found, group)
            group, size = [], 0
        group.append(part)
        size += n
    if group:
        yield cells_of(found, group)


def cells_of(found: DataFrame, parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rows = found.where(F.col("part").between(parts[0], parts[-1])).select("cells", "witnesses").collect()
    cells, marks = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((0, "<u8"), (1, "<u2")))
    order = np.argsort(cells)
    return cells[order], marks[order]


class Known:
    """Cells in order, with a table that tells of most others at one look that they are not among them."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.table = cells, None

    def __getstate__(self) -> np.ndarray:
        return self.cells

    def __setstate__(self, cells: np.ndarray) -> None:
        self.__init__(cells)

    def among(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of cells that are known, and where these stand."""
        if self.table is None:
            self.low = np.uint64((1 << max(10, (4 * len(self.cells)).bit_length())) - 1)
            self.table = np.zeros(int(self.low) + 1, bool)
            self.table[self.cells & self.low] = True
        i = np.flatnonzero(self.table[cells & self.low])
        at = np.searchsorted(self.cells, cells[i])
        at[at == len(self.cells)] = 0
        good = self.cells[at] == cells[i]
        return i[good], at[good]


def longer_phrases(docs: DataFrame, pairs: DataFrame, longest: int, part_bits: int) -> DataFrame | None:
    """Sums of the phrases of three words and more that begin with a pair of a heavy cell."""
    out = None
    for known in rounds(pairs, CELLS_AT_ONCE):
        shared = docs.sparkSession.sparkContext.broadcast(Known(known[0]))

        def pick(grams: Grams, shared=shared) -> Iterator[np.ndarray]:
            at = grams.places(2)
            at = at[shared.value.among(grams.cells(at, 2))[0]]
            for k in range(3, longest + 1):
                at = at[at + k < len(grams.breaks)]
                at = at[grams.breaks[at + k] == grams.breaks[at]]
                yield grams.cells(at, k)

        part = sketch(docs, pick, part_bits, False)
        out = part if out is None else out.unionByName(part)
    return out


def told_phrases(docs: DataFrame, found: DataFrame, longest: int, by_witness: bool = True) -> DataFrame:
    """(lang, phrase, k, cell) of the phrases whose cells are in found and, unless told otherwise, whose block is the witness
    of their cell; a task tells a phrase once, unless it has very many."""
    out = None
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("cell", pa.int64())])
    for known in rounds(found, CELLS_AT_ONCE):
        shared = docs.sparkSession.sparkContext.broadcast((Known(known[0]), known[1]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            told: dict[str, set] = {}
            some, marks = shared.value
            for lang, text in by_lang(batches):
                seen, new = told.setdefault(lang, set()), set()
                for block in blocks(text):
                    grams, mark = Grams(block, lang), witness(block) if by_witness else None
                    for k in range(2, longest + 1):
                        at = grams.places(k)
                        cells = grams.cells(at, k)
                        good, where = some.among(cells)
                        good = good if mark is None else good[marks[where] == mark]
                        new |= grams.phrases(at[good], k, cells[good])
                new -= seen
                rows = list(new)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([p.decode() for p, _, _ in rows], pa.string()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([c for _, _, c in rows], pa.int64())], schema=schema)
                seen |= new
                if sum(map(len, told.values())) > TOLD:
                    told = {}

        part = docs.mapInArrow(run, "lang string, phrase string, k int, cell long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def short_cells(found: DataFrame, pairs: bool, counts: DataFrame, least: int) -> DataFrame:
    """found's rows cut down to the cells whose sum the counts (k, cell, f) of the phrases told so far miss by least or more:
    only there can a frequent phrase be missing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells, sums in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                c, n = np.frombuffer(cells.as_buffer(), "<i8"), np.frombuffer(sums.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part), pa.int32()), pa.array(c), pa.array(n)], names=["part", "cell", "whole"])

    each = found.select("part", "cells", "sums").mapInArrow(rows, "part int, cell long, whole long")
    known = counts.where("k = 2" if pairs else "k > 2").groupBy("cell").agg(F.sum("f").alias("f"))
    short = each.join(known, "cell", "left").where(F.col("whole") - F.coalesce("f", F.lit(0)) >= least)

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        cells = np.sort(table.column("cell").to_numpy()).astype("<i8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary()), "witnesses": pa.array([bytes(2 * len(cells))], pa.binary()), "n": pa.array([len(cells)], pa.int64())})

    return short.select("part", "cell").distinct().groupBy("part").applyInArrow(packed, "part int, cells binary, witnesses binary, n long")


def with_cells(phrases: DataFrame) -> DataFrame:
    """phrases (lang, phrase, k, cell) with the cells of single words, which have none so far."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            cells, each = rows["cell"], {}
            for i, (lang, cell) in enumerate(zip(rows["lang"], cells, strict=True)):
                if cell is None:
                    each.setdefault(lang, []).append(i)
            for lang, places in each.items():
                grams = Grams(b" " + b" \n ".join(rows["phrase"][i].encode() for i in places) + b" ", lang)
                for i, cell in zip(places, grams.cells(grams.places(1), 1).tolist(), strict=True):
                    cells[i] = cell
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return phrases.select("lang", "phrase", "k", "cell").mapInArrow(run, "lang string, phrase string, k int, cell long")


class Patterns:
    """Phrases, whose numbers are their places, to be found by their cells. Of several of one cell each is in a layer of its own."""

    def __init__(self, table: pa.Table):
        phrases = pa.concat_arrays([x.cast(pa.large_binary()) for x in table.column("phrase").chunks])
        cells, langs = table.column("cell").to_numpy().astype(np.uint64), table.column("lang").combine_chunks().dictionary_encode()
        self.langs = {x: k for k, x in enumerate(langs.dictionary.to_pylist())}
        self.lang = langs.indices.to_numpy().astype(np.int32)
        # Phrase p is text[start[p] : start[p + 1]]. Eight more bytes, as the last ones are read by eights.
        self.start = np.frombuffer(phrases.buffers()[1], np.int64)[phrases.offset :][: len(phrases) + 1].copy()
        self.text = phrases.buffers()[2].slice(int(self.start[0]), int(self.start[-1] - self.start[0])).to_pybytes() + bytes(8)
        self.start -= self.start[0]
        order = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], cells[order][1:] != cells[order][:-1]]))
        layer = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.layers = [(Known(cells[order[layer == k]]), order[layer == k].astype(np.int32)) for k in range(int(layer.max(initial=-1)) + 1)]

    def found(self, grams: Grams, lang: str, longest: int) -> Iterator[np.ndarray]:
        """The numbers of the phrases in a block, overlapping ones too."""
        block, text = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (grams.block + bytes(8), self.text))
        for k in range(1, longest + 1):
            at = grams.places(k)
            cells = grams.cells(at, k)
            for known, numbers in self.layers:
                i, p = known.among(cells)
                p, start = numbers[p], grams.starts[at[i]]
                size = self.start[p + 1] - self.start[p]
                good = (grams.ends[at[i] + k - 1] - start == size) & (self.lang[p] == self.langs[lang])
                p, start, size = p[good], start[good], size[good]
                yield p[equal(block, start, text, self.start[p], size, grams.block, self.text)]


def equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray, bytes_a: bytes, bytes_b: bytes) -> np.ndarray:
    """Whether the bytes from at_a on and those from at_b on are equal, size of them; a and b are their eights from each byte on."""
    same = np.ones(len(size), bool)
    for i in np.flatnonzero(size > LONG).tolist():
        same[i] = bytes_a[at_a[i] : at_a[i] + size[i]] == bytes_b[at_b[i] : at_b[i] + size[i]]
    i, done = np.flatnonzero(size <= LONG), 0
    while len(i):
        rest = np.minimum(size[i] - done, 8).astype(np.uint64)
        apart = (a[at_a[i] + done] ^ b[at_b[i] + done]) << (np.uint64(64) - np.uint64(8) * rest)
        same[i[apart != 0]] = False
        done += 8
        i = i[(apart == 0) & (size[i] > done)]
    return same


def summing(pids: Broadcast) -> Callable[[tuple, pa.Table], pa.Table]:
    """Sums of one part of a round's phrases: pid and f."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        f = np.zeros(1 << SUMMED_BITS, np.int64)
        for places, counts in zip(rows.column("places"), rows.column("counts"), strict=True):
            f[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<i8")
        at = np.flatnonzero(f)
        return pa.table({"pid": pa.array(pids.value[(key[1].as_py() << SUMMED_BITS) + at], pa.int64()), "f": pa.array(f[at], pa.int64())})

    return one


def matched(docs: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """phrases (lang, phrase, k, cell, pid) with f, the places in docs where each stands; those without any are left out.

    PHRASES_AT_ONCE of them are looked for at once. Tasks send their sums in parts of numbers that lie together.
    """
    n_rounds, out = -(-phrases.count() // PHRASES_AT_ONCE), None
    for r in range(n_rounds):
        table = phrases.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(n_rounds)) == r).select("lang", "phrase", "cell", "pid").toArrow()
        if not len(table):
            continue
        context = docs.sparkSession.sparkContext
        shared, pids = context.broadcast(Patterns(table)), context.broadcast(table.column("pid").to_numpy())
        del table

        def run(batches: Iterator[pa.RecordBatch], r=r, shared=shared) -> Iterator[pa.RecordBatch]:
            patterns, held, size, sums = shared.value, [], 0, np.zeros(len(shared.value.lang), np.int64)

            def add() -> None:
                if held:
                    np.add(sums, np.bincount(np.concatenate(held), minlength=len(sums)), out=sums)
                held.clear()

            for lang, text in by_lang(batches):
                for block in blocks(text) if lang in patterns.langs else ():
                    for p in patterns.found(Grams(block, lang), lang, longest):
                        held.append(p)
                        size += len(p)
                    if size > GATHER:
                        add()
                        size = 0
            add()
            for low in range(0, len(sums), 1 << SUMMED_BITS):
                own = sums[low : low + (1 << SUMMED_BITS)]
                at = np.flatnonzero(own)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([low >> SUMMED_BITS], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], names=["round", "part", "places", "counts"])

        part = docs.mapInArrow(run, "round int, part int, places binary, counts binary").groupBy("round", "part").applyInArrow(summing(pids), "pid long, f long")
        out = part if out is None else out.unionByName(part)
    return phrases.withColumn("f", F.lit(0).cast("long")).limit(0) if out is None else phrases.join(out, "pid")


#: The automata of one round, which a worker keeps for its next tasks.
_KEPT: dict[str, dict[str, tuple]] = {}


def automata(key: str, patterns: Broadcast) -> dict[str, tuple]:
    """Of each language an automaton of its patterns, with a space on both sides, and their numbers."""
    if key not in _KEPT:
        import ahocorasick

        _KEPT.clear()
        table, each = pa.ipc.open_stream(patterns.value).read_all(), {}
        for lang, phrase, pid in zip(table.column("lang").to_pylist(), table.column("phrase"), table.column("pid").to_pylist(), strict=True):
            machine, pids = each.setdefault(lang, (ahocorasick.Automaton(), []))
            machine.add_word(f" {phrase.as_py()} ", len(pids))
            pids.append(pid)
        for machine, _ in each.values():
            machine.make_automaton()
        _KEPT[key] = {lang: (machine, np.array(pids, np.int64)) for lang, (machine, pids) in each.items()}
    return _KEPT[key]


def counted(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """patterns (lang, phrase, pid and more) with f, the matches of each in docs, summed over the tasks."""
    n_rounds, out = -(-patterns.count() // PATTERNS_AT_ONCE), None
    for r in range(n_rounds):
        mine = patterns.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(n_rounds)) == r).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, mine.schema) as writer:
            writer.write_table(mine)
        shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch], key=uuid.uuid4().hex, shared=shared) -> Iterator[pa.RecordBatch]:
            machines, sums = automata(key, shared), {}
            for lang, text in by_lang(batches):
                if lang not in machines:
                    continue
                machine, pids = machines[lang]
                for block in blocks(text):
                    found = np.fromiter(map(itemgetter(1), machine.iter(block.decode())), np.int64)
                    more = np.bincount(found, minlength=len(pids))
                    sums[lang] = sums[lang] + more if lang in sums else more
            for lang, f in sums.items():
                at = np.flatnonzero(f)
                yield pa.RecordBatch.from_arrays([pa.array(machines[lang][1][at], pa.int64()), pa.array(f[at], pa.int64())], names=["pid", "f"])

        part = docs.mapInArrow(run, "pid long, f long")
        out = part if out is None else out.unionByName(part)
    return patterns.join(out.groupBy("pid").agg(F.sum("f").alias("f")), "pid") if n_rounds else patterns.withColumn("f", F.lit(0).cast("long"))


def ranked(f: DataFrame, n: DataFrame, least: int, top: int, cover: int, only: DataFrame | None = None) -> DataFrame:
    """The first top phrases of each language. f: lang, phrase, f of all phrases that may be frequent and of their words; or of
    those in only (lang, phrase), which no longer phrase covers, and of their parts.

    Products are decimals of 38 digits, so none overflows.
    """
    big = lambda c: c.cast("decimal(19,0)")
    words = F.split("phrase", " ")
    good = f.withColumn("words", words).withColumn("k", F.size("words")).where((F.col("k") > 1) & (F.col("f") >= least))
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = good.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, value: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.withColumns({"a19": big(F.col("a")), "lr": big(F.col("l")) + big(F.col("r"))}).withColumn("score", F.expr("(2000000 * a19) div lr"))
    scored = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    inner = good.where("k > 2").select("lang", F.col("f").alias("longer"), "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", joined(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big(F.col("longer")) < cover * big(F.col("a"))))
    free = free if only is None else free.join(only, ["lang", "phrase"], "left_semi")
    order = W.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    out = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")


def with_parts(phrases: DataFrame) -> DataFrame:
    """phrases (lang, phrase) and the parts before and after each of their cuts."""
    cuts = phrases.withColumn("words", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ").alias("phrase")
    return phrases.unionByName(cuts.select("lang", joined(F.lit(1), F.col("cut")))).unionByName(cuts.select("lang", joined(F.col("cut") + 1, F.size("words") - F.col("cut")))).distinct()


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first top phrases of each language, by score, count and phrase.

    A phrase is 2 to longest words of one piece, a stretch without [.,;:!?] or a line's end, found least times or more. a is
    its count, n the words of its language, l and r the counts of its two parts at the cut whose floor(2000000 * a / (l + r)),
    the score, is lowest, at the earliest such cut. Phrases inside a longer one with cover % of their count or more go.

    Every row counts, repeated ones too; null texts are empty, a null language is und; without frequent phrases, as in an
    empty table, there are no rows; other columns are not looked at. What tasks send is a sum for each cell or pattern, so a
    hot phrase is one entry of each; sums of sketches are shared out by cells in parts whose number follows the size of the
    texts. What is broadcast is bounded: beyond CELLS_AT_ONCE cells, PHRASES_AT_ONCE phrases or PATTERNS_AT_ONCE patterns the texts are read again. All
    frequent phrases are matched by their cells; automata count those that come first, so their number follows that of languages.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A cell's place in its part has 32 bits.
    part_bits = max(CELLS - 32, min(24, int(size // PART_BYTES).bit_length()))
    work = Scratch(df.sparkSession)
    numbered = lambda phrases, name: work.write(phrases.withColumn("pid", F.monotonically_increasing_id()), name)
    sums = work.write(sketch(docs, lambda g: iter([g.cells(g.places(2), 2)]), part_bits, True), "pairs")
    n = work.write(sums.where("part < 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    pairs = work.write(heavy(sums, least, part_bits), "heavy-pairs")
    work.drop("pairs")
    if (more := longer_phrases(docs, pairs, longest, part_bits)) is None:
        return ranked(df.sparkSession.createDataFrame([], "lang string, phrase string, f long"), n, least, top, cover)
    longer = work.write(heavy(more, least, part_bits), "heavy-phrases")
    found = work.write(told_phrases(docs, pairs.unionByName(longer), longest), "phrases")
    single = lambda phrases: phrases.where("k = 2").select("lang", F.explode(F.split("phrase", " ")).alias("phrase"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("cell")).distinct()
    f = work.write(matched(docs, numbered(with_cells(found.unionByName(single(found))), "patterns"), longest), "counts")
    short = work.write(short_cells(pairs, True, f, least).unionByName(short_cells(longer, False, f, least)), "short")
    if not short.isEmpty():
        rest = work.write(told_phrases(docs, short, longest, False), "rest")
        new = rest.unionByName(single(rest)).join(f.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        f = work.write(f.unionByName(matched(docs, numbered(with_cells(new), "new-patterns"), longest)), "all-counts")
    first = work.write(ranked(f.select("lang", "phrase", "f"), n, least, top, cover).select("lang", "phrase"), "first")
    return ranked(counted(docs, numbered(with_parts(first), "first-patterns")).select("lang", "phrase", "f"), n, least, top, cover, first)


ORACLE_SQL = f"""WITH piece AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM piece),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT * FROM g WHERE k > 1 AND f >= {LEAST}),
cut AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cut.lang, cut.g, a, cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.g = cut.g[1 : cut] JOIN g y ON y.lang = cut.lang AND y.g = cut.g[cut + 1 : cut.k]
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, cut) = 1),
part AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS f FROM (SELECT lang, g, f, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) r(m) WHERE m < k) GROUP BY ALL),
free AS (SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM s LEFT JOIN part ON part.lang = s.lang AND part.g = s.g WHERE part.f IS NULL OR 100::HUGEINT * part.f < {COVER} * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= {TOP}"""
