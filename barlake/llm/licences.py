"""Licence scans: notices found by their rarest words, whose places must agree, and by key phrases that must be there.

DataFrame functions only. Of each template the words that fewest documents have, those of highest inverse document
frequency, are indexed with their places in it. The places of these words in a text, less those in a template, are offsets;
enough different words of a template at one offset, give or take a slack, are a candidate, and its key phrases must stand
where the offset puts them. Short phrases are found by their one rarest word, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import id_text
from barlake.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template in the index, the share of them that makes a candidate, and the slack of an offset in words.
RARE, SHARE, SLACK = 8, 0.6, 16

# Phrases that name a licence by themselves.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices that licences ask for, and the key phrases without which a notice is not that licence's.
NOTICES = (
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge", "deal in the software without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "held liable for any damages")),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, str, int], ...]  # place in the template, phrase, number of words

    @classmethod
    def of(cls, label: str, text: str, keys: Sequence[str]) -> Template:
        at = lambda k: f" {text} ".index(f" {k} ")
        return cls(label, tuple(text.split()), tuple((text[: at(k)].count(" "), k, len(k.split())) for k in keys))


TEMPLATES = tuple(Template.of(*x) for x in NOTICES)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS), "")


def texts_of(items: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in items))


def document_counts(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many rows of docs (text) have each word of the vocabulary, which is that of the templates and so bounded."""
    seen = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), texts_of(vocabulary))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r.w: r["count"] for r in seen.groupBy("w").count().collect()}


def stretch(words: Column, start: Column, size: Column | int) -> Column:
    """The words from start on, which may lie before the text, joined by spaces."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(size + F.least(start, F.lit(0)), F.lit(0))), " ")


@dataclass(frozen=True)
class Index:
    """Rare words and the places they have in templates and phrases."""

    templates: Sequence[Template]
    phrases: Sequence[tuple[str, str]]
    counts: dict[str, int]
    rare: int
    share: float
    slack: int

    def rarest(self, words: Sequence[str], n: int) -> list[str]:
        return sorted(set(words), key=lambda w: (self.counts[w], w))[:n]

    def anchors(self) -> list[tuple[str, int, str, str, int]]:
        """Rarest word, its place, phrase, label and number of words of each phrase."""
        out = []
        for phrase, label in self.phrases:
            words = phrase.split()
            w = self.rarest(words, 1)[0]
            out.append((w, words.index(w), phrase, label, len(words)))
        return out

    def postings(self) -> dict[str, list[tuple[int, int, int]]]:
        """Of each rare word its templates, places in them, and its number among their rare words."""
        out: dict[str, list[tuple[int, int, int]]] = {}
        for t, template in enumerate(self.templates):
            for k, w in enumerate(self.rarest(template.words, self.rare)):
                for place, x in enumerate(template.words):
                    if x == w:
                        out.setdefault(w, []).append((t, place, k))
        return out

    def sizes(self) -> list[int]:
        return [len(self.rarest(t.words, self.rare)) for t in self.templates]

    def needs(self) -> list[int]:
        return [max(2, -int(-self.share * n // 1)) for n in self.sizes()]


def notices(words: Column, hits: Column, index: Index) -> Column:
    """Array of (t, matched): the templates that the text has and how many of their rare words agree in place.

    Offsets fall into cells of slack words, in two rows of cells that lie half a cell apart. A number stands for template,
    row, cell and rare word, so that sorted distinct numbers have the words of a cell beside each other.
    """
    postings = index.postings()
    struct = lambda t, p, k: F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).alias("p"), F.lit(k).cast("long").alias("k"))
    table = F.create_map(*(x for w, all_ in postings.items() for x in (F.lit(w), F.array(*(struct(*y) for y in all_)))))
    cell = lambda x, p, row: F.floor((x["i"] - p["p"] + row * index.slack // 2) / index.slack).cast("long")
    number = lambda x, p, row: ((p["t"] * 2 + row) * F.lit(1 << 32) + cell(x, p, row) + F.lit(1 << 31)) * 16 + p["k"]
    numbers = F.flatten(F.transform(hits, lambda x: F.flatten(F.transform(F.element_at(table, x["w"]), lambda p: F.array(number(x, p, 0), number(x, p, 1))))))
    needs, sizes = F.array(*(F.lit(x) for x in index.needs())), F.array(*(F.lit(x) for x in index.sizes()))
    template = lambda g: F.shiftright(g, 33).cast("int")

    def cells(g: Column) -> Column:
        same = lambda j, d: F.coalesce(F.get(g, j + d) == F.get(g, j), F.lit(False))
        first = lambda j: ~same(j, F.lit(-1)) & same(j, F.get(needs, template(F.get(g, j))) - 1)
        found = F.filter(F.sequence(F.lit(0), F.size(g) - 1), first)
        matched = lambda j: sum((same(j, F.lit(d)).cast("int") for d in range(1, index.rare)), F.lit(1))
        low = lambda v: ((F.shiftleft(F.lit(1).cast("long"), 32) - 1).bitwiseAND(v) - F.lit(1 << 31)) * index.slack - F.shiftright(v, 32).bitwiseAND(F.lit(1).cast("long")) * (index.slack // 2)
        return F.transform(found, lambda j: F.struct(template(F.get(g, j)).alias("t"), low(F.get(g, j)).cast("int").alias("low"), matched(j).alias("matched")))

    key = lambda x: F.struct(F.lit(x[0]).alias("at"), F.lit(f" {x[1]} ").alias("phrase"), F.lit(x[2]).alias("n"))
    keys = F.array(*(F.array(*(key(x) for x in t.keys)) for t in index.templates))
    there = lambda c, k: F.concat(F.lit(" "), stretch(words, c["low"] + k["at"], index.slack - 1 + k["n"]), F.lit(" ")).contains(k["phrase"])
    kept = lambda found: F.filter(found, lambda c: F.forall(F.get(keys, c["t"]), lambda k: there(c, k)))
    share = lambda c: F.struct(c["t"].alias("t"), (c["matched"] / F.get(sizes, c["t"])).alias("share"))
    of_cells = lambda g: F.transform(kept(cells(g)), share)
    nothing = F.array().cast("array<struct<t int, share double>>")
    return F.when(F.size(hits) > 0, let(F.transform(F.sort_array(F.array_distinct(numbers)), lambda v: F.shiftright(v, 4)), of_cells)).otherwise(nothing)


def places(words: Column, hits: Column, index: Index) -> Column:
    """Array of (start, label) of the phrases."""
    out = []
    for w, at, phrase, label, n in index.anchors():
        mine = F.filter(hits, lambda x: (x["w"] == w) & (x["i"] >= at) & (stretch(words, x["i"] - at, n) == phrase))
        out.append(F.transform(mine, lambda x: F.struct((x["i"] - at).cast("long").alias("start"), F.lit(label).alias("label"))))
    return F.concat(*out)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, rare: int = RARE, share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word and last_word of the phrases' places, base_labels, labels,
    score.

    labels are those of the phrases and of the notices that the text has; score is 1 with a phrase, else the largest share
    of a notice's rare words that agree in place, 0 without a notice. Two passes over the texts: one counts the documents of
    each licence word, whose number the templates bound; one judges each text by itself, so no group of copies, no frequent
    word and no source gathers anywhere. Rows that repeat an id, or have none, are judged each by itself; null texts are
    empty, have no words and score 0; an empty table gives no rows; other columns are not looked at.
    """
    docs = id_text(df, id_col, text_col)
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p, _ in phrases for w in p.split()})
    index = Index(templates, phrases, document_counts(docs, vocabulary), rare, share, slack)
    wanted = sorted({*index.postings(), *(a[0] for a in index.anchors())})
    anchor_words, rare_words = {a[0] for a in index.anchors()}, set(index.postings())

    def of_hits(words: Column) -> Column:
        each = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*wanted))
        hits = F.when(F.size(F.array_intersect(words, texts_of(wanted))) > 0, each).otherwise(F.array().cast("array<struct<w string, i int>>"))
        only = lambda h, some: F.filter(h, lambda x: x["w"].isin(*sorted(some)))
        told = lambda h: F.struct(F.size(words).cast("long").alias("n_words"), places(words, only(h, anchor_words), index).alias("places"), notices(words, only(h, rare_words), index).alias("notices"))
        return let(hits, told)

    found = docs.select("doc_id", let(words_of(F.col("text")), of_hits).alias("f")).select("doc_id", "f.*")
    label = lambda n: F.get(texts_of([t.label for t in templates]), n["t"])
    starts, base = F.transform("places", lambda x: x["start"]), F.transform("places", lambda x: x["label"])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("notices", label))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def oracle_sql(templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, rare: int = RARE, share: float = SHARE, slack: int = SLACK) -> str:
    """The same in DuckDB SQL, by joins."""
    rows = lambda items: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in x) + ")" for x in items)
    return f"""WITH phrase(phrase, label) AS (VALUES {rows(phrases)}),
tw(t, label, place, w) AS (VALUES {rows((t, x.label, k, w) for t, x in enumerate(templates) for k, w in enumerate(x.words))}),
tk(t, k_at, phrase, n) AS (VALUES {rows((t, *k) for t, x in enumerate(templates) for k in x.keys)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
docs_of AS (SELECT w, count(DISTINCT doc_id) AS c FROM word WHERE w IN (SELECT w FROM tw) GROUP BY w),
rare AS (SELECT t, label, w FROM (SELECT DISTINCT t, label, w FROM tw) LEFT JOIN docs_of USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(c, 0), w) <= {rare}),
need AS (SELECT t, label, count(*) AS size, greatest(2, CAST(ceil({share} * count(*)) AS BIGINT)) AS need FROM rare GROUP BY ALL),
cell AS (SELECT doc_id, t, p.p, CAST(floor((i - place + p.p * {slack // 2}) / {slack}) AS BIGINT) AS cell, count(DISTINCT w) AS matched
  FROM word JOIN (SELECT t, place, w FROM tw SEMI JOIN rare USING (t, w)) USING (w), range(2) p(p) GROUP BY ALL),
cand AS (SELECT doc_id, t, label, cell * {slack} - p * {slack // 2} AS low, matched / size AS share FROM cell JOIN need USING (t) WHERE matched >= need),
seen AS (SELECT doc_id, t, low, share, label, phrase FROM cand JOIN tk USING (t) JOIN d USING (doc_id)
  WHERE contains(' ' || array_to_string(w[greatest(low + k_at, 0) + 1 : low + k_at + {slack} - 1 + n], ' ') || ' ', ' ' || phrase || ' ')),
good AS (SELECT doc_id, t, label, low, share FROM seen JOIN (SELECT t, count(*) AS all_keys FROM tk GROUP BY t) USING (t) GROUP BY ALL HAVING count(*) = any_value(all_keys)),
place AS (SELECT doc_id, label, i FROM word x JOIN d USING (doc_id) JOIN phrase ON x.w = split_part(phrase, ' ', 1) WHERE array_to_string(d.w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM good) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


ORACLE_SQL = oracle_sql()
