"""Quality rules: word and repetition counts of each document, and the frequency of its lines across documents.

DataFrame functions only. Arrays that several parts of an expression need are bound once by let().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import ROW, keyed, materialise

BLANKS = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
#: A line in more than so many documents of one host is boilerplate.
MAX_DOCUMENTS = 20
#: A document that keeps less than this share of its words is depleted.
MIN_KEPT = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of size words that the text has twice or more."""

    def covered(s: Column) -> Column:
        equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, j: equal(x, j - 1) | equal(x, j + 1))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(size), i - acc["at"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-size).alias("at"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def of_windows(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) > size, let(windows, of_windows)).otherwise(F.lit(0)).cast("long")


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANKS, " "))))


def host_key(host: Column) -> Column:
    """A text for each host; none equals that of a null host."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def counted(rows: DataFrame, row: Column, host_col: str, id_col: str, text_col: str, name: str) -> DataFrame:
    """What the rules need of each row, in one pass over the texts: counts, and the key and number of words of each line."""
    docs = rows.select(row.alias(ROW), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), host_key(F.col(host_col)).alias("host"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"), F.transform(x, lambda y: F.struct(line_key(y).alias("k"), F.size(words_of(y)).alias("n"))).alias("all")))
    found = docs.select(
        ROW, "doc_id", "host", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return materialise(found, name)


def common_lines(found: DataFrame, max_documents: int) -> DataFrame:
    """(row, key, words) of the lines that go: those in more than max_documents rows of a host, but for the first row.

    The first is that with the smallest doc_id, null ids last, of equal ids that with the smallest number. Lines are
    counted before they are shuffled, so that one which a third of all documents have is one row of each task.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    once = found.select("host", rank.alias("rank"), F.explode(F.array_distinct(F.transform("l.all", lambda x: x["k"]))).alias("k"))
    common = once.groupBy("host", "k").agg(F.count("*").alias("documents"), F.min("rank").alias("first")).where(F.col("documents") > max_documents)
    each = found.select("host", ROW, F.inline("l.all"))
    return each.join(common.select("host", "k", F.col("first.row").alias("first_row")), ["host", "k"]).where(F.col(ROW) != F.col("first_row")).select(ROW, "k", "n")


def judged(found: DataFrame, gone: DataFrame, min_kept: float) -> DataFrame:
    flat = found.select(ROW, "doc_id", "w.n_words", "word_chars", "n_symbols", F.col("l.n_dup").alias("n_dup_lines"), "w.n_repeat_words")
    out = flat.join(gone, ROW, "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_common_words") >= F.lit(min_kept) * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", kept)


def assess(df: DataFrame, host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words,
    base_failed, kept.

    A line is common if more than max_documents documents of its host have it. It is removed from all but the first of
    them, by doc_id, so that of a group of copies one stays whole. kept is false for documents that fail the base rules
    or keep less than min_kept of their words.

    A row is a document: rows that repeat an id, or have none, are counted and judged each by itself. Null texts are empty
    and fail for want of words; a null host is a host of its own. An empty table gives no rows; other columns are not
    looked at.
    """
    found = counted(df, F.monotonically_increasing_id(), host_col, id_col, text_col, "quality-counts")
    gone = common_lines(found, max_documents).groupBy(ROW).agg(F.sum("n").alias("n_common_words"))
    return judged(found, gone, min_kept).drop(ROW)


def cleaned(df: DataFrame, host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of df that assess() keeps, all columns, their text without the common lines; chars_col as the text now is.

    Lines keep their order; a row without common lines stays as it is. An empty table gives no rows.
    """
    rows = keyed(df, "quality-rows")
    found = counted(rows, F.col(ROW), host_col, id_col, text_col, "quality-counts")
    gone = common_lines(found, max_documents).groupBy(ROW).agg(F.sum("n").alias("n_common_words"), F.collect_set("k").alias("__keys"))
    kept = rows.join(judged(found, gone, min_kept).where("kept").select(ROW, "__keys"), ROW)
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains("__keys", line_key(x))), "\n")
    out = kept.withColumn(text_col, F.when(F.col("__keys").isNull(), F.col(text_col)).otherwise(rest))
    if chars_col:
        out = out.withColumn(chars_col, F.when(F.col("__keys").isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(df.schema[chars_col].dataType)))
    return out.select(df.columns)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '-') AS host,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
wk AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wk) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, range(0, 5) r(o) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, unnest(l) AS x FROM d),
nl AS (SELECT doc_id, host, t, lower(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k,
              len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '')) AS n FROM ln),
com AS (SELECT host, k, min(doc_id) AS first_id FROM nl GROUP BY host, k HAVING count(DISTINCT doc_id) > {max_documents}),
gone AS (SELECT nl.doc_id, sum(n) AS n FROM nl JOIN com USING (host, k) WHERE nl.doc_id <> first_id GROUP BY nl.doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_common_words >= {min_kept} * n_words AS kept FROM f
""".format(max_documents=MAX_DOCUMENTS, min_kept=MIN_KEPT)
