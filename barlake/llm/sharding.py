"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split further.

DataFrame functions only. Of the documents just (doc_id, n_bytes, hash) takes part in the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from barlake.llm.common import materialise

BITS = 60
#: Bits that one round adds to the directory: 4,096 cells under each open bucket at most.
ROUND = 12
#: Production limit of a shard's text bytes.
LIMIT = 1 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text: rows that differ can be told apart by some prefix."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def assign(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_bytes, depth, shard (the first depth bits of the hash), page, shard_bytes.

    A shard is the shortest prefix whose rows fit in limit bytes. Rows that are equal in id and text share all bits: a
    bucket of one hash value that is still too large is cut into pages of whole rows, each within the limit, numbered
    by the partition they were written in so that no task sees the whole group; every other shard has page 0. A single row above the
    limit is a shard or page by itself. Pages are numbered once and written, so that a task that runs again numbers no row
    anew. Null texts have 0 bytes. An empty table gives no rows; other columns are not
    looked at.
    """
    return place(df, limit, id_col, text_col).select("doc_id", "n_bytes", "depth", "shard", "page", "shard_bytes")


def place(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The columns of assign(), and with whole each row of df beside them as the struct row.

    The rounds look at hashes and sizes only. The cells they pick are few, so that rows find their shard by their own hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), row_hash(F.col(id_col), text).alias("h"), *([F.struct(*df.columns).alias("row")] if whole else []))
    rows = materialise(wide.drop("row"), "shard-rows")
    wide = wide if whole else rows
    done, open_rows, base, any_over = [], rows, 0, False
    while True:
        deep = base + ROUND
        open_rows, wide = (x.withColumn("cell", prefix(F.col("h"), deep)) for x in (open_rows, wide))
        cells = open_rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        spread = cells.select("*", F.explode(F.sequence(F.lit(base + (base > 0)), F.lit(deep))).alias("depth"))
        spread = spread.withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int")))
        sums = spread.groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fit = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "p", "shard_bytes", (F.col("lo") == F.col("hi")).alias("one"))
        pick = spread.join(fit, ["depth", "p"]).groupBy("cell").agg(F.min_by(F.struct("depth", "p", "shard_bytes", "one"), "depth").alias("s"))
        pick = materialise(pick.select("cell", "s.*"), "shard-cells")
        any_over = any_over or not pick.where(F.col("one") & (F.col("shard_bytes") > limit)).isEmpty()
        done.append(wide.join(pick, "cell").drop("cell"))
        base = deep
        if deep >= BITS or cells.join(pick, "cell", "left_anti").isEmpty():
            break
        open_rows, wide = (x.join(pick, "cell", "left_anti") for x in (open_rows, wide))
    out = reduce(DataFrame.unionByName, done)
    row = ["row"] if whole else []
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("p"), F.col("depth").cast("int"), F.lit("0")))
    out = out.select(*row, "doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", "h", (F.col("one") & (F.col("shard_bytes") > limit)).alias("over"))
    cols = [*row, "doc_id", "n_bytes", "depth", "shard", "page", "shard_bytes"]
    fitting = out.where(~F.col("over")).withColumn("page", F.lit(0).cast("long")).select(*cols)
    if not any_over:
        return fitting
    paged = materialise(out.where("over").withColumn("number", F.monotonically_increasing_id()), "shard-pages")
    paged = paged.withColumn("part", F.shiftright("number", 33))
    per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    turn = F.row_number().over(W.partitionBy("h", "part").orderBy("number")) - 1
    paged = paged.withColumn("page", F.col("part") * (1 << 32) + F.floor(turn / per_page) + 1)
    paged = paged.withColumn("shard_bytes", F.sum("n_bytes").over(W.partitionBy("h", "page")))
    return fitting.unionByName(paged.select(*cols))


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of df as Parquet, in one folder with one file for each shard and page: column shard, s<bits>-<page>.

    Each row goes with its own assignment, not by its id: rows without an id, with one that repeats and equal rows all
    arrive, and a file has more than limit bytes of text only if it is a single row.
    """
    placed = place(df, limit, id_col, text_col, whole=True)
    placed = placed.select("row.*", F.concat_ws("-", F.concat(F.lit("s"), "shard"), F.col("page").cast("string")).alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def read_assignments(spark: SparkSession, path: str, schema: StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of assign(), as the written shards show them; schema is that of the rows."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("shard", StringType())])).parquet(path)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col("shard").alias("folder"))
    sums = rows.groupBy("folder").agg(F.sum("n_bytes").alias("shard_bytes"))
    bits = F.regexp_extract("folder", "^s([01]*)-", 1)
    return rows.join(sums, "folder").select("doc_id", "n_bytes", F.length(bits).cast("int").alias("depth"), bits.alias("shard"), F.regexp_extract("folder", "-([0-9]+)$", 1).cast("long").alias("page"), "shard_bytes")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS nb,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT d.*, s.depth, h >> CAST({BITS} - s.depth AS INTEGER) AS p FROM d, range(0, {BITS + 1}) s(depth)),
g AS (SELECT depth, p, sum(nb) AS b FROM p GROUP BY depth, p HAVING sum(nb) <= {LIMIT} OR min(h) = max(h)),
m AS (SELECT p.doc_id, p.nb, p.h, min_by(struct_pack(depth := g.depth, p := g.p, b := g.b), g.depth) AS s
      FROM p JOIN g ON p.depth = g.depth AND p.p = g.p GROUP BY p.doc_id, p.nb, p.h)
SELECT doc_id, nb AS n_bytes, CAST(s.depth AS INTEGER) AS depth,
       CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.p), CAST(s.depth AS INTEGER), '0') END AS shard,
       CASE WHEN s.b > {LIMIT} THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS page, CAST(s.b AS BIGINT) AS shard_bytes
FROM m
"""
