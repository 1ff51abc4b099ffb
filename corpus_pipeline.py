"""Corpus preparation: quality rules, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
Stages act by row: rows without a doc_id, or with one that repeats, are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, common, decontaminate, quality, secrets, simhash


#: Rows of the batches that Spark hands to Python at once: batches of whole texts stand in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session's batches have BATCH_ROWS rows at most; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows, numbered by common.keyed(), whose numbers are in keys."""
    return rows.join(keys.select(common.ROW), common.ROW, "left_semi").drop(common.ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, without the lines that are common in their source; n_chars as the text now is.

    Null and empty texts have no words and go; a null source is a source of its own; null and repeated ids are judged row
    by row; an empty table gives no rows."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that with the smallest doc_id, null ids last, of equal ids any one.

    Equal rows are one group, and so are all rows whose text has no words; an empty table gives no rows."""
    small_batches(spark)
    rows = common.keyed(docs, "near-rows")
    found = simhash.near_copies(rows, id_col=common.ROW).select(F.col("doc_id").alias(common.ROW), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(common.ROW).alias("row"))
    first = found.join(rows.select(common.ROW, "doc_id"), common.ROW).groupBy("component_id").agg(F.min(rank).alias("first"))
    return only(rows, first.select(F.col("first.row").alias(common.ROW)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark: null and empty texts stay, each row is judged by itself, and an empty
    benchmark takes none."""
    small_batches(spark)
    # Rows of equal texts share a verdict, so a hash of the text names them.
    rows = docs.withColumn(common.ROW, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=common.ROW)
    return rows.join(found.select(F.col("doc_id").alias(common.ROW)).distinct(), common.ROW, "left_anti").drop(common.ROW)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark in text, and n_chars as the text now is; null texts stay null."""
    small_batches(spark)
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, and the digest of the decoded text, for each row.

    Null and empty texts have no tokens; ids may be null or repeat."""
    small_batches(spark)
    done = bpe.encode_decode(docs, cache_size=100_000, slice_bytes=1 << 20)  # beside what the stages before left in a worker
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("encoding", encoding),
]

#: Fingerprints, edit distances and subword merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, name.replace(" ", "-"))
    return docs
