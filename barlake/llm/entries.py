"""The numbered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, collocations, common, decontaminate, licences, pii, quality, runs, secrets, sharding, simhash, substrings, toxicity, warc


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.split(spans, ","), lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.documents(spark, sf_dir))
    return found.select("doc_id", *(count_kind("base", k) for k in ("assign", "access", "hex")), F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(common.documents(spark, sf_dir))
    return found.select("doc_id", *(count_kind("base", k) for k in ("email", "ip", "card", "phone")), F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(common.documents(spark, sf_dir))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = common.documents(spark, sf_dir), common.shared_dir(spark, "shards")
    sharding.write_shards(docs, path)
    return sharding.read_assignments(spark, path, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(common.documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(spark, path).drop("html")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn_lexicon(docs, labels)
    scored = toxicity.score(docs, lexicon, toxicity.learn_shifts(docs, labels, lexicon))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(common.documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.documents(spark, sf_dir))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(common.documents(spark, sf_dir), plant=True)
    return found.withColumn("collapsed_sha256", F.sha2(F.encode("collapsed", "UTF-8"), 256)).drop("collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_licences": op11_licences,
    "op12_collocations": op12_collocations,
    "op13_runs": op13_runs,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op3_sharding": sharding.ORACLE_SQL, "op5_quality": quality.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op11_licences": licences.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
