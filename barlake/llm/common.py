"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Bytes of the rows that a Python function gets at once.
SLICE = 4 << 20
#: Column of the row numbers that keyed() gives.
ROW = "__row"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share.

    The cluster names its shared folder in spark.checkpoint.dir. Only where that is unset and all runs on this machine,
    as in local tests, is a temporary folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Folders of one operator's steps, each dropped once no later step reads it. Those of its result stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
        conf, clean = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        path, before = shared_dir(self.spark, name), conf.get(clean, "false")
        conf.set(clean, "true")  # the shuffles have done their work once the rows are written
        try:
            df.write.parquet(path)
        finally:
            conf.set(clean, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder that stays, and read back."""
    return Scratch(df.sparkSession).write(df, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, name: str, key: str = ROW) -> DataFrame:
    """df, written once, with a number for each row in column key: rows without an id and equal rows can be told apart.

    The numbers are unique and stay as written; no rows are brought together to number them.
    """
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), name)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as long, and the text, null as empty: extra columns of any name stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def halves(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows, in order, in slices of limit bytes at most; a longer row is a slice of its own."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
        return
    middle = batch.num_rows // 2
    yield from halves(batch.slice(0, middle), limit)
    yield from halves(batch.slice(middle), limit)


def give_back() -> None:
    """Free memory that a worker's allocators keep goes back to the system: workers live on beside what comes next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, limit: int = SLICE) -> DataFrame:
    """mapInArrow with a function that turns a batch of some limit bytes into a dict of columns.

    The schema is a DDL string. Spark's batches hold up to 10,000 rows, whatever their length; slices keep the Python
    objects of one call small.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in halves(batch, limit) if batch.num_rows else ():
                cols = rows(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)
                del cols
        # Spark keeps more workers than run at once and hands tasks to each in turn, so what one keeps counts several times.
        give_back()

    return df.mapInArrow(run, schema)


class Covered:
    """The union of spans, asked whether another span meets it."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def holds(self, start: int, end: int) -> bool:
        """Whether the span lies inside the union."""
        k = bisect_right(self.starts, start)
        return k > 0 and end <= self.ends[k - 1]


def span_list(spans: list[tuple[int, int, str]], order: dict[str, int]) -> str:
    """kind:start:end, comma-joined, by start and then by the kind's place in order."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


