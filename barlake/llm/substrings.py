"""Removal of repeated byte strings by prefix doubling over sampled suffixes.

Prefix doubling ranks suffixes by a short prefix and then, round by round, by pairs of ranks at growing offsets, until a
suffix is unique or the threshold is passed. Here Spark groups and joins the rows (rank, document, place) of each round,
and only undecided rows go on. Two things differ from the textbook:

* Positions are sampled. Ranking every byte would send some 15 bytes for each byte of text through each shuffle. Of each
  window of THRESHOLD bytes only the minimiser, the leftmost smallest of its hashed GRAM-byte strings, takes part. Equal
  windows have equal minimisers at equal places, so the windows of a document that share one, a run, are ranked together
  by what they have in common: the bytes from the minimiser on.
* Ranks are hashes of the pair instead of numbers in sorted order: equality is all that counts, and no global numbering
  is needed.

Round 0 ranks a run by its GRAM bytes. A rank that no second document has is unique and done. Runs of equal rank whose
whole stretch of bytes, named by pairs of the GRAM-byte ranks that lie in it, is equal are copies: those of larger
documents go. What is left, as at the ends of a copied
passage, is doubled: the windows of a run are halved by where the minimiser lies in them, and each half is ranked by the
pair of its parent's rank and the rank of as many bytes at an offset, so that the ranked string grows until it is the
window itself. The rows of these rounds carry their 80 bytes at most and need Spark's own functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.llm.common import SLICE, Scratch, halves

THRESHOLD, GRAM = 50, 20
#: Text bytes that a task samples or cuts at a time.
STEP = 2 << 20
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: A place in a document and a length, in one number.
RANGE = 1 << 32
SAMPLE = "rank long, span long, id long, tag long, place long"
#: Ranks that over one in so many of a sample's rows have are hot, and so at most that many ranks are; the sample is that
#: of every so-many-th document.
HOT, HOT_SAMPLE = 5_000, 50


def gram_hashes(buf: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place on; gram is 8 at least. Salts give independent hashes."""
    n = len(buf) - gram + 1
    words = np.ndarray((len(buf) - 7,), np.uint64, buffer=np.ascontiguousarray(buf), strides=(1,))
    h = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for k, at in enumerate([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
            h += words[at : at + n]
            h *= _C[k % 3]
            h ^= h >> np.uint64(29 + k % 3)
        h *= _C[0]
        h ^= h >> np.uint64(32)
    return h


def leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the smallest of the next width values is, the leftmost of equals."""
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        less = h[step:] < h[:-step]
        at = np.where(less, at[step:], at[:-step])
        h = np.where(less, h[step:], h[:-step])
        span += step
    return at


def pieces(texts: list[bytes], threshold: int, step: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of some step bytes: numbers, offsets and bytes. A longer text comes in pieces that overlap so far
    that each window lies whole in one of them and begins in just one."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - threshold + 1), step):
            part = text[at : at + step + threshold - 1] if len(text) > step else text
            if size + len(part) > step and held[0]:
                yield held
                held, size = ([], [], []), 0
            for x, y in zip(held, (k, at, part), strict=True):
                x.append(y)
            size += len(part)
    if held[0]:
        yield held


def runs(parts: list[bytes], threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(part, first window, number of windows, offset of the minimiser, rank of its gram, name of all its bytes), a row for each run.

    A run is the windows of one part that share a minimiser; windows begin at offsets into the part.
    """
    buf = np.frombuffer(b"".join(parts), np.uint8)
    if len(buf) < threshold:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    sizes = np.array([len(t) for t in parts], np.int64)
    ends = np.cumsum(sizes)
    h = gram_hashes(buf, gram)
    at = leftmost_smallest(h, threshold - gram + 1)
    part = np.repeat(np.arange(len(parts)), sizes)
    start = np.arange(len(at))
    start = start[start + threshold <= ends[part[: len(at)]]]
    if not len(start):
        return runs([], threshold, gram)
    key, of = at[start], part[start]
    head = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(of) != 0)))
    count = np.diff(np.append(head, len(start)))
    back = key[head] - start[head]
    span = names(h, start[head], count - 1 + threshold, gram, 2 * threshold - gram)
    with np.errstate(over="ignore"):
        span ^= back.astype(np.uint64) * _C[1]
    return of[head], start[head] - (ends - sizes)[of[head]], count, back, h[key[head]], span


def names(h: np.ndarray, start: np.ndarray, length: np.ndarray, gram: int, longest: int) -> np.ndarray:
    """Names of stretches of bytes: gram ranks at growing offsets, each paired with the name so far."""
    name = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for offset in range(0, longest, gram):
            name = (name ^ h[start + np.minimum(offset, length - gram)]) * _C[offset // gram % 3]
            name ^= name >> np.uint64(31)
    return name


def sampler(threshold: int, gram: int) -> Callable:
    """A row for each run of the texts: rank of its gram, name of its bytes, document, and its place.

    A place is the first window, the number of windows and the minimiser's offset in one number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in halves(whole, SLICE) if whole.num_rows else ():
                ids, tags = (batch.column(k).to_numpy() for k in (0, 1))
                for numbers, offsets, parts in pieces(batch.column(2).to_pylist(), threshold, STEP):
                    of, first, count, back, rank, span = runs(parts, threshold, gram)
                    if len(of):
                        doc = np.array(numbers)[of]
                        place = (first + np.array(offsets)[of]) << 16 | count << 8 | back
                        cols = (rank.view(np.int64), span.view(np.int64), ids[doc], tags[doc], place)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def shared(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows whose rank another document has too; of hot ranks all, dealt over many tasks, as some document will have it."""
    # One number deals and sorts the rows, which Spark then sorts by radix. Where that of a hot row happens to be another's
    # rank, that rank is kept too, and judged() tells it.
    dealt = rows.join(F.broadcast(hot), "rank", "left").withColumns({"key": F.when(F.col("hot"), F.xxhash64("id", "place")).otherwise(F.col("rank")), "held": F.when(F.col("hot"), F.col("rank"))})
    same = W.partitionBy("key")
    dealt = dealt.drop("rank", "hot").withColumns({"_low": F.min("id").over(same), "_high": F.max("id").over(same)})
    return dealt.where("held IS NOT NULL OR _low < _high").withColumn("rank", F.coalesce("held", "key")).select(rows.columns)


def judged(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """rows (rank, span, id, ...) that are not decided to stay, with covered: a smaller id has the same rank and span.

    The others share their rank with another document whose span differs, and go on. Counts are added up before they
    are shuffled, so a rank that a third of all rows have is one row of each task.
    """
    spans = scratch.write(rows.groupBy("rank", "span").agg(F.min("id").alias("_first"), F.max("id").alias("_last")), f"{name}-spans")
    ranks = spans.groupBy("rank").agg(F.min("_first").alias("_low"), F.max("_last").alias("_high"), (F.count("*") > 1).alias("_several")).where("_low < _high")
    both = spans.join(ranks.select("rank", "_several"), "rank").where("_several OR _first < _last").select("rank", "span", "_first", "_several")
    told = rows.join(both.hint("shuffle_hash"), ["rank", "span"]).withColumn("covered", F.col("id") > F.col("_first")).where("covered OR _several")
    told = scratch.write(told.drop("_first", "_several", "span"), name)
    scratch.drop(f"{name}-spans")
    return told


def piece(start: Column, length: Column | int) -> Column:
    """Bytes of a row's stretch, from a place counted from 0."""
    return F.substring(F.col("bytes"), (start + 1).cast("int"), F.lit(length).cast("int") if isinstance(length, int) else length.cast("int"))


def halved(rows: DataFrame, size: int, threshold: int, reach: int) -> DataFrame:
    """Each row's windows, those whose minimiser lies p to p + size - 1 bytes in, in two halves with their pairs of ranks.

    bytes begin back bytes before the minimiser; low and high bound the row's windows. The windows of a half share the
    bytes from p before the minimiser on: those of the parent and as many again, shifted to one side.
    """
    half = size // 2
    out = rows.select("id", "tag", "first", "back", "low", "high", "rank", "bytes", "p", F.explode(F.array(F.col("p"), F.col("p") + half)).alias("c"))
    out = out.where((F.col("c") <= F.col("high")) & (F.col("c") + half > F.col("low")) & (F.col("c") <= reach))
    q, end = F.least(F.col("p") + size - 1, F.lit(reach)), F.least(F.col("c") + half - 1, F.lit(reach))
    length = threshold - (q - F.col("p"))
    other = F.when(F.col("c") == F.col("p"), F.col("back") + threshold - end - length).otherwise(F.col("back") - F.col("c"))
    low, high = F.greatest("c", "low"), F.least(end, F.col("high"))
    span = F.xxhash64(low, high, piece(F.col("back") - high, threshold + high - low))
    return out.select("id", "tag", "first", "back", low.alias("low"), high.alias("high"), F.xxhash64("c", "rank", F.xxhash64(piece(other, length))).alias("rank"), span.alias("span"), "bytes", F.col("c").alias("p"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed: texts take less room in the shuffles."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for batch in halves(whole, SLICE) if whole.num_rows else ():
            k = batch.num_columns - 1
            yield batch.set_column(k, batch.schema.field(k), pa.array([packer.compress(x.as_py()) for x in batch.column(k)], pa.binary()))


def _stretches(threshold: int) -> Callable:
    """The bytes of the undecided runs of each document, from its packed text."""
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("back", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("rank", pa.int64()), ("bytes", pa.binary()), ("p", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def send(rows: list[tuple]) -> pa.RecordBatch:
            ids, tags, places, ranks, whole = ([r[k] for r in rows] for k in range(5))
            n = [len(x) for x in places]
            place = np.concatenate(places)
            first, count, back = place >> 16, place >> 8 & 255, place & 255
            cols = (np.repeat(ids, n), np.repeat(tags, n), first, back, back - count + 1, back, np.concatenate(ranks), [x for w in whole for x in w], np.zeros(len(place), np.int32))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

        unpack, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy() for k in (0, 1))
            for k in range(batch.num_rows):
                text, place, rank = unpack.decompress(batch.column(2)[k].as_py()), batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()
                for at in range(0, len(place), 10_000):
                    p = place[at : at + 10_000]
                    whole = [text[x >> 16 : (x >> 16) + (x >> 8 & 255) - 1 + threshold] for x in p.tolist()]
                    held.append((ids[k], tags[k], p, rank[at : at + 10_000], whole))
                    size += len(p)
                    if size >= 10_000:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its ranges."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            i, text, ranges = (c[k] for c in batch.columns)
            text = unpack.decompress(text.as_py())
            if ranges.is_valid:
                at = ranges.values.to_numpy()
                start, end = at // RANGE, at // RANGE + at % RANGE
                edge = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                step = np.diff(gone.astype(np.int8), prepend=0, append=0)
                row = i.as_py(), len(text), np.flatnonzero(step == 1), np.flatnonzero(step == -1), np.frombuffer(text, np.uint8)[~gone].tobytes()
            else:
                row = i.as_py(), len(text), [], [], text
            out.append(row)
            size += len(text)
            if size > STEP:
                yield send(out)
                out, size = [], 0
    if out:
        yield send(out)


def remove_repeats(df: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_bytes, starts and ends of the removed runs of bytes, kept (the other bytes).

    A byte goes if a string of threshold bytes that covers it also starts in a document with a smaller doc_id; the
    strings are those of the input. Texts are UTF-8; null texts are empty; texts shorter than threshold stay whole.
    A null doc_id counts as larger than all others. Rows that repeat an id do not cover each other, and neither do rows
    without one; each is judged by itself. An empty table gives no rows; other columns are not looked at. A text may
    have 2 GB. gram is 8 bytes at least and less than 256 shorter than threshold.
    """
    if not 8 <= gram <= threshold < gram + 256:
        raise ValueError("gram is 8 bytes at least and less than 256 shorter than threshold")
    largest, reach = (1 << 63) - 1, threshold - gram
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    # Rows of equal id and text share their ranges; so an id and a hash of the text name a row.
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(largest)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    sampled = lambda x: x.mapInArrow(sampler(threshold, gram), SAMPLE)
    some = sampled(rows.where(F.pmod("tag", F.lit(HOT_SAMPLE)) == 0)).groupBy("rank").agg(F.count("*").alias("n"))
    some = scratch.write(some.where("n > 1"), "sampled-ranks")
    total = (some.agg(F.sum("n")).first()[0] or 0) + 1
    hot = some.where(F.col("n") * HOT > total).select("rank", F.lit(True).alias("hot"))
    common = scratch.write(shared(sampled(rows), hot), "shared-runs")
    told = judged(scratch, common, "told-runs")
    scratch.drop("sampled-ranks", "shared-runs")
    place = lambda bits, mask: F.shiftright("place", bits).bitwiseAND(mask)
    found = told.where("covered").select("id", "tag", (F.shiftright("place", 16) * F.lit(RANGE) + place(8, 255) - 1 + threshold).alias("range"))
    covered = [found]
    packed = rows.mapInArrow(_packed, "id long, tag long, text binary")
    left = told.where("NOT covered").groupBy("id", "tag").agg(F.collect_set(F.struct("place", "rank")).alias("x"))
    left = packed.join(left, ["id", "tag"]).select("id", "tag", "text", "x.place", "x.rank")
    open_rows = scratch.write(left.mapInArrow(_stretches(threshold), "id long, tag long, first int, back int, low int, high int, rank long, bytes binary, p int"), "stretches")
    size, before = 1 << reach.bit_length(), "stretches"
    while size > 1 and not open_rows.isEmpty():
        told = judged(scratch, halved(open_rows, size, threshold, reach), f"told-{size}")
        scratch.drop(before)
        start = F.col("first") + F.col("back") - F.col("high")
        found = told.where("covered").select("id", "tag", (start * F.lit(RANGE) + F.col("high") - F.col("low") + threshold).alias("range"))
        covered.append(scratch.write(found, f"covered-{size}"))
        open_rows, before, size = told.where("NOT covered"), f"told-{size}", size // 2
    scratch.drop(before)
    ranges = reduce(DataFrame.unionByName, covered).groupBy("id", "tag").agg(F.collect_set("range").alias("ranges"))
    out = packed.join(ranges, ["id", "tag"], "left").select("id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != largest, F.col("doc_id")))
