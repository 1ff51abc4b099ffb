"""SimHash near-duplicates by anchor points: replicas of a fingerprint meet at code words near it.

The 64 bits are split into three blocks of at most 23 bits. Of two fingerprints at most 4 bits apart some block differs
in one bit at most. The anchors of a block are the words of the perfect Golay code of length 23, whose covering radius
is 3: a fingerprint goes to every anchor within 3 + 1 bits of its block, so any such pair meets at an anchor. There all
64 bits are compared. A crowded anchor is refined by further anchors: the bits outside its block are split into three
parts again, of which one differs in one bit at most, and the words of the perfect Hamming code of length 15, whose
covering radius is 1, are the anchors of a part. So no cell grows with the input beyond what is near its anchors.

A task compares a cell's fingerprints by runs of bits that they have in common, so that its time grows little faster than
the cell; only cells that are large for one task are refined, since their rows are many times those before.

near_copies() is for cleaning, where copies with several words changed count: the fingerprint of 4-word shingles moves by
more than 4 bits for most of them, one of single words by fewer. Each text has ROUNDS of the latter, searched by the same
anchors, and a sketch of its 5-word shingles, by which the pairs that an anchor brings together are judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import Scratch, give_back, id_text, map_rows

THRESHOLD = 4
SHINGLE = 4
#: Fingerprints of a cell beyond which it is refined, at each depth, which makes some 22 rows of each. Large groups of near
#: copies crowd every cell they are in, and cost little there, so deeper cells may hold more.
CROWDED = (250_000, 500_000)
#: Within a cell: fingerprints beyond which only those with a run of bits in common are compared, size of the groups of such
#: that are compared all at once, and pairs that are compared together.
SPLIT, SHIFTED, MATRIX = 500, 100, 1 << 17
#: Of near_copies(): fingerprints a text, and the least cosine of the sets of 5-word shingles that two linked texts have.
ROUNDS, SIMILAR = 5, 0.8
#: The sketch by which that cosine is told: 256 bits, in longs, two of which differ in as great a share of the bits as the
#: angle is of half a turn.
SKETCH = tuple(f"s{k}" for k in range(4))
APART = math.floor(math.acos(SIMILAR) / math.pi * 64 * len(SKETCH))


class Code:
    """A perfect cyclic code, by length, generator polynomial and covering radius."""

    def __init__(self, length: int, generator: int, radius: int):
        self.length, self.generator, self.radius = length, generator, radius
        self.check = generator.bit_length() - 1

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        """Remainders of the polynomials in words after division by the generator."""
        rest = words.astype(np.int64)
        for bit in range(self.length - 1, self.check - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (self.generator << (bit - self.check)), rest)
        return rest

    @lru_cache(maxsize=4)  # noqa: B019
    def offsets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns of up to radius + 1 bits by syndrome: word ^ pattern is an anchor if both have one syndrome.

        Returned are the patterns, sorted by syndrome, and for each syndrome where its patterns begin and how many they are.
        """
        found = np.array([sum(1 << b for b in bits) for k in range(self.radius + 2) for bits in combinations(range(self.length), k)], dtype=np.int64)
        s = self.syndromes(found)
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=1 << self.check)
        return found[order], np.cumsum(count) - count, count

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the word and the anchor, for every anchor within radius + 1 bits."""
        patterns, first, count = self.offsets()
        s = self.syndromes(words)
        n = count[s]
        which = np.repeat(np.arange(len(words)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
        return which, words[which] ^ patterns[place]


#: The codes of each depth.
CODES = (Code(23, 0b101011100011, 3), Code(15, 0b10011, 1), Code(15, 0b10011, 1))


def parts(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Bits in three runs of nearly equal length."""
    n = len(bits)
    cuts = [0, -(-n // 3), -(-n // 3) + (n - -(-n // 3) + 1) // 2, n]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def gather(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= (fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << k
    return out


def anchors(fps: np.ndarray, depth: int = 0, taken: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and the cell, part and anchor in one number, of every replica.

    taken are the numbers of the parts that the cells so far were of.
    """
    bits, at, keys, code = tuple(range(64)), [], [], CODES[depth]
    for k in taken:
        gone = set(parts(bits)[k])
        bits = tuple(b for b in bits if b not in gone)
    for k, part in enumerate(parts(bits)):
        which, word = code.anchors(gather(fps, part))
        at.append(which)
        keys.append(k << code.length | word)
    return np.concatenate(at), np.concatenate(keys)


def schema_of(carry: tuple[str, ...]) -> str:
    return ", ".join(f"{name} long" for name in ("cell", "fp", *carry))


def replicas(fps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(cell, fp) of the first depth, and the columns to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4_000):
                cols = [np.array(c.slice(i, 4_000).to_numpy()) for c in batch.columns]
                at, key = anchors(cols[0].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[at]) for c in cols)], names=["cell", "fp", *carry])
        pa.default_memory_pool().release_unused()

    return fps.select("fp", *carry).mapInArrow(run, schema_of(carry))


def refined(cells: DataFrame, depth: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(cell, fp) one depth further: the number of a cell goes on from that of the cell it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                cell, *cols = (np.array(c.slice(i, 2_000).to_numpy()) for c in batch.columns)
                # The parts taken so far, from the first on, stand above each depth's anchor.
                rest, taken = cell.copy(), np.zeros(len(cell), np.int64)
                for d in range(depth - 1, -1, -1):
                    taken = taken * 3 + (rest >> CODES[d].length & 3)
                    rest >>= CODES[d].length + 2
                for t in np.unique(taken):
                    own = taken == t
                    way = tuple(int(t) // 3**d % 3 for d in range(depth))
                    at, key = anchors(cols[0][own].view(np.uint64), depth, way)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[own][at] << (CODES[depth].length + 2) | key), *(pa.array(c[own][at]) for c in cols)], names=["cell", "fp", *carry])
        pa.default_memory_pool().release_unused()

    return cells.select("cell", "fp", *carry).mapInArrow(run, schema_of(carry))


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle of size words, or of the whole sequence where there are fewer."""
    from xxhash import xxh64_intdigest

    runs = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)] or [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, 42) for s in runs), np.uint64, len(runs))


def words_of(text: str) -> list[bytes]:
    # On bytes, lower() changes A-Z alone and split() divides at the six blanks alone.
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str) -> int:
    """Bits that over half of the shingles' hashes have set."""
    words = words_of(text)
    return majority(shingles(words, SHINGLE)) if words else 0


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes, made from one by the last steps of SplitMix64."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def marks(text: str) -> list[int]:
    """The fingerprints of the set of words, then the sketch of the set of 5-word shingles; all zero without words."""
    words = words_of(text)
    if not words:
        return [0] * (ROUNDS + len(SKETCH))
    single, runs = np.unique(shingles(words, 1)), np.unique(shingles(words, 5))
    return [majority(mixed(single, k)) for k in range(ROUNDS)] + [majority(mixed(runs, k)) for k in range(len(SKETCH))]


def sketch_names(sketches: np.ndarray) -> np.ndarray:
    """One number for each sketch (row)."""
    name = np.zeros(len(sketches), np.uint64)
    for k in range(sketches.shape[1]):
        name = mixed(name ^ sketches[:, k], k)
    return name


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def rows(batch):
        fp = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": fp.view(np.int64)}

    return map_rows(id_text(df, id_col, text_col), rows, "doc_id long, fp long")


def groups(key: str, values: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal keys in batches sorted by key, with their rows of values; only one run is held at a time."""
    last, held = None, []
    for batch in batches:
        k, v = batch.column(key).to_numpy(), np.stack([batch.column(c).to_numpy() for c in values], axis=1)
        if not len(k):
            continue
        cuts = np.flatnonzero(np.diff(k)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if held and k[a] != last:
                yield last, np.concatenate(held)
                held = []
            last = k[a]
            held.append(v[a:b])
    if held:
        yield last, np.concatenate(held)


def bits_apart(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def near(fps: np.ndarray, sketches: np.ndarray | None, x: np.ndarray, y: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the pairs that link."""
    i, j = np.nonzero(bits_apart(fps[x][:, None], fps[y]) <= threshold)
    if sketches is None or not len(i):
        return i, j
    good = alike(sketches, x[i], y[j])
    return i[good], j[good]


def alike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (columns) are at most APART bits apart."""
    return sum(bits_apart(s[i], s[j]).astype(np.int64) for s in sketches) <= APART


def reached(fps: np.ndarray, sketches: np.ndarray | None, left: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member) of the components that links among left make.

    A breadth-first search of one component at a time, in which what is reached is compared with what is not: members of a
    dense group are reached from its first member at once and then cost one comparison with what is left. First members
    are tried many at once, as most link with nothing.
    """
    still, out = np.zeros(len(fps), bool), []
    still[left] = True
    while len(left) > 1:
        size = max(1, MATRIX // len(left))
        i, j = near(fps, sketches, left[:size], left, threshold)
        i, j = i[j > i], j[j > i]
        for k in np.unique(i).tolist():
            root = left[k]
            if not still[root]:
                continue
            still[root] = False
            queue, others = [left[j[i == k]]], left
            queue[0] = queue[0][still[queue[0]]]
            still[queue[0]] = False
            while queue:
                got = queue.pop()
                if not len(got):
                    continue
                out.append((got, np.full(len(got), root)))
                at = 0
                while at < len(got) and len(others := others[still[others]]):
                    block = got[at : at + max(1, MATRIX // len(others))]
                    at += len(block)
                    new = others[np.unique(near(fps, sketches, block, others, threshold)[1])]
                    still[new] = False
                    queue.append(new)
        left = left[size:]
        left = left[still[left]]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)


def split(fps: np.ndarray, sketches: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect, of a large cell: of threshold + 1 runs of bits one is equal in any pair
    within threshold, so only fingerprints with such a run in common are compared."""
    cuts, out = [64 * k // (threshold + 1) for k in range(threshold + 2)], []
    for low, high in zip(cuts, cuts[1:], strict=False):
        value = (fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)).astype(np.uint16 if high - low <= 16 else np.uint64)
        order = np.argsort(value, kind="stable")
        value = value[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        n = np.diff(np.append(first, len(value)))
        for a, size in zip(first[n > SHIFTED].tolist(), n[n > SHIFTED].tolist(), strict=True):
            out.append(reached(fps, sketches, order[a : a + size], threshold))
        # The many small groups at once: each row with the row d further on, as long as that is of its group.
        end = np.repeat(np.where(n > SHIFTED, 0, first + n), n)
        ordered, at = fps[order], np.arange(len(order))
        for d in range(1, SHIFTED):
            at = at[at + d < end[at]]
            if not len(at):
                break
            hit = at[bits_apart(ordered[at], ordered[at + d]) <= threshold]
            i, j = order[hit], order[hit + d]
            good = slice(None) if sketches is None else alike(sketches, i, j)
            out.append((j[good], i[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def stars(fps: np.ndarray, sketches: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the components that links within one anchor make; with sketches (rows are their
    longs) a link is a pair whose sketches are at most APART bits apart too, and nodes are the sketches' names."""
    whole = len(fps) > SPLIT
    i, j = split(fps, sketches, threshold) if whole else reached(fps, sketches, np.arange(len(fps)), threshold)
    if not len(i):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    at, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    names = fps[at] if sketches is None else sketch_names(sketches[:, at].T)
    # Each takes the least name among its neighbours' and its own until none changes.
    root = names.copy()
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    return names[names != root], root[names != root]


def compare(cells: DataFrame, threshold: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b) between the fingerprints that share a cell, as stars; with a sketch carried, between the sketches' names."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v in groups("cell", ["fp", *carry], batches):
            columns = np.ascontiguousarray(v.T).view(np.uint64)
            a, b = stars(columns[0], columns[1:] if carry else None, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
        if carry:
            give_back()
        else:
            pa.default_memory_pool().release_unused()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def links(scratch: Scratch, distinct: DataFrame, threshold: int = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges that connect all fingerprints (column fp) within threshold bits: per cell, stars instead of pairs."""
    if threshold > THRESHOLD:
        raise ValueError(f"three parts find pairs at most {THRESHOLD} bits apart")
    cells, keys, found = replicas(distinct, carry), replicas(distinct), []
    for depth, limit in enumerate(CROWDED, 1):
        # A cell holds a row once, so few rows crowd none.
        if depth == 1 and distinct.count() <= limit:
            break
        crowded = scratch.write(keys.groupBy("cell").count().where(F.col("count") > limit).select("cell"), f"crowded-{depth}")
        if crowded.isEmpty():
            break
        found.append(compare(cells.join(crowded, "cell", "left_anti"), threshold, carry))
        cells, keys = (refined(x.join(crowded, "cell", "left_semi"), depth, more) for x, more in ((cells, carry), (keys, ())))
    return reduce(DataFrame.unionByName, [*found, compare(cells, threshold, carry)]).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for every node of edges (a, b).

    Each round a node takes the smallest label among its own and its neighbours', and then the label of that label.
    Only labels are shuffled and joined; each round's are written to the shared folder and those before it dropped.
    """
    edges = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels-0")
    for k in count(1):
        near = edges.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = labels.join(near, "node").join(hop, "label", "left")
        new = scratch.write(new.select("node", F.least("label", "seen", F.coalesce("further", "label")).alias("label"), F.col("label").alias("old")), f"labels-{k}")
        scratch.drop(f"labels-{k - 1}")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            scratch.drop("edges")
            return labels


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes as edges (member a, root b), but few where a member has many roots: of each member
    the edge to its least root, and edges between that root and its others, which are alike for many members."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    between = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.withColumnRenamed("m", "b").unionByName(between).distinct()


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Words are runs without blanks, A-Z in lower case; shingles are 4 words, repeats count. A text of fewer words is one
    shingle; null, empty and blank texts have fingerprint zero, which links like any other. Equal fingerprints, and so
    exact copies, are one node in the search. Rows that repeat an id count once as a node; an empty table gives no
    rows; other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    docs = scratch.write(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = scratch.write(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    label = components(scratch, links(scratch, nodes, threshold)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    low = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return docs.join(named.join(low, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id and component_id (the smallest doc_id reachable over links, itself included).

    Texts are linked if some fingerprint of their words differs in THRESHOLD bits at most and their sketches tell of
    SIMILAR 5-word shingles. Texts with equal sketches, and so exact copies, are one node, as are all null, empty and blank
    texts. A text of fewer words than a shingle is one shingle. An empty table gives no rows; other columns are not
    looked at. The fingerprints are searched one after another, so that the rows of one search alone are on disk.
    """
    scratch, names = Scratch(df.sparkSession), [f"f{k}" for k in range(ROUNDS)] + list(SKETCH)

    def rows(batch):
        found = np.array([marks(t) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(names))
        give_back()
        return {"doc_id": batch.column(0), "node": sketch_names(found[:, ROUNDS:]).view(np.int64)} | {n: found[:, k].view(np.int64) for k, n in enumerate(names)}

    schema = ", ".join(f"{n} long" for n in ("doc_id", "node", *names))
    docs = scratch.write(map_rows(id_text(df, id_col, text_col), rows, schema), "marks")
    found = [scratch.write(links(scratch, docs.select(F.col(f"f{k}").alias("fp"), *SKETCH).distinct(), carry=SKETCH), f"links-{k}") for k in range(ROUNDS)]
    every = scratch.write(reduce(DataFrame.unionByName, found).distinct(), "links")
    labels = components(scratch, contracted(every))
    named = docs.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return docs.select("doc_id", "node").join(named.join(low, "label").select("node", "component_id"), "node").select("doc_id", "component_id")
