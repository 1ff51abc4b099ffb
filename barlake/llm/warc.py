"""WARC archives of individually compressed records with an embedded Zstandard dictionary.

An archive is a concatenation of frames: a skippable frame that holds the dictionary, then one compressed frame for each
record. Spark's text writer lays the frames down, so files reach any store that Spark can write, under its commit
protocol. The writer puts a separator after each row; an empty skippable frame, which every decoder steps over, serves.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import SLICE, halves, materialise, shared_dir

#: Skippable frames: of the dictionary, as the Zstandard WARC format has it, and the empty one between rows.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
#: Equal payloads from so many bytes on are stored once.
MIN_PAYLOAD = 1000
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 256 << 20
#: Bounds of what a task holds back to train its dictionary on, and of the dictionary.
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 4 << 20, 2000, 64 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    target = "".join(c for c in (url or "") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(sample: list[bytes]):
    """A dictionary from records; where they are too few or too alike to train on, their own bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 8)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary's frame, then each record's. Only the sample is held back."""
    import zstandard

    head, size = [], 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES or len(head) >= SAMPLE_RECORDS:
            break
    if not head:
        return
    trained = train(head)
    raw = trained.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=6, dict_data=trained)
    for r in head:
        yield packer.compress(r)
    del head
    for r in records:
        yield packer.compress(r)


def write(pages: DataFrame, path: str) -> None:
    """One archive file for each partition of pages, whose columns are page_id, url, html and refers_to.

    The session's maxRecordsPerFile is set aside: a file that began later would have no dictionary.
    """
    schema = pa.schema([("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in (part for whole in batches if whole.num_rows for part in halves(whole, SLICE)):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)

        out, size = [], 0
        for f in frames(each()):
            out.append(f)
            size += len(f)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)

    rows = pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii")).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive."""
    import zstandard

    if not data:
        return
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    plain = io.BufferedReader(opener.stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = plain.read(int(head["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to, html.

    The digest of every response is taken anew from the payload read and must equal the one in its header.
    html is null for revisits.
    """
    from hashlib import sha1

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def row(head: dict[str, str], block: bytes) -> tuple:
        payload = block[len(HTTP) :] if head["WARC-Type"] == "response" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if payload is not None and sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {head['Page-ID']}: the payload does not have its digest")
        refers = head.get("Refers-To-Page")
        return int(head["Page-ID"]) if head["Page-ID"] else None, int(head["Payload-Length"]), digest, head["WARC-Type"], int(refers) if refers else None, None if payload is None else payload.decode("utf-8", "surrogatepass")

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for head, block in parse(data.as_py()):
                    held.append(row(head, block))
                    size += len(block)
                    if size > SLICE:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, fields)


def archive(pages: DataFrame, path: str | None = None, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write pages (page_id, url, html) as archives and return their folder.

    Of pages with equal payloads of min_payload bytes or more, that with the largest page_id is the response and the
    others are revisits of it; rows that repeat this page are responses too. Null html is an empty payload, a null url
    an empty target. An empty table gives archives without records. Other columns are not looked at.

    A reader takes an archive whole, so where the session's shuffle partitions are too few to keep archives at about
    archive_bytes of payloads, more are made.
    """
    path = path or shared_dir(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    keys = materialise(rows.select("page_id", F.octet_length("html").cast("long").alias("size"), "digest"), "warc-keys")
    large = keys.where(F.col("size") >= min_payload)
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(first, "digest").where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").dropDuplicates(["page_id", "digest"])
    files = -(-(keys.agg(F.sum("size")).first()[0] or 0) // archive_bytes)
    if files > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows, revisits = (x.repartition(files, "page_id", "digest") for x in (rows, revisits))
    write(rows.join(revisits, ["page_id", "digest"], "left"), path)
    return path


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY s)
SELECT page_id, n AS payload_bytes, p.s AS payload_digest,
       CASE WHEN f.r IS NOT NULL AND f.r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.r IS NOT NULL AND f.r <> page_id THEN f.r END AS refers_to
FROM p LEFT JOIN f ON p.s = f.s AND p.n >= 1000
"""
