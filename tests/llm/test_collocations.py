import random
import re
from collections import Counter

import pytest
from conftest import SMALL, against_oracle

from barlake.llm import collocations, entries

ODD = [(None, None), ("en", None), ("en", ""), ("en", " \n\t.;\r\n"), (None, "no lang at all. " * 40), ("und", "no lang at all. " * 5), ("de", "A  b\tC d e! " * 35), ("de", "a b c d e" * 2), ("x", "z " * 5000), ("é", "Ärger ärger\x0bÄrger\x1cärger nbsp\xa0x " * 50)]
SCHEMA = "lang string, text string, phrase string, f int, pid string, part int"


def by_hand(docs, least=30, longest=4, top=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    good = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), b in good.items():
        for k in range(2, len(p)):
            covered |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * b >= cover * f[lang, p[i : i + k]]}
    out = []
    for (lang, p), a in good.items():
        if (lang, p) not in covered:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    told = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        told += [(x[0], r, *x[1:]) for r, x in enumerate(mine, 1)]
    return sorted(told)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


def test_collocations_equal_sql(spark):
    against_oracle(spark, entries.op12_collocations, collocations.ORACLE_SQL)


def test_collocations_query_equals_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in entries.op12_collocations(spark, SMALL).collect())
    assert got == by_hand(docs) and got


def test_odd_and_empty_tables(spark):
    df = spark.createDataFrame([(lang, t, "p", 1, "q", 2) for lang, t in ODD * 2], SCHEMA)
    got = mined(df)
    assert got == by_hand(ODD * 2) and {x[0] for x in got} >= {"und", "de", "x", "é"}
    assert mined(df.limit(0)) == [] and mined(df.where("text = ''")) == []


@pytest.mark.parametrize("cells, patterns", [(4_000_000, 400_000), (40, 60)])
def test_rounds_change_nothing(spark, monkeypatch, cells, patterns):
    monkeypatch.setattr(collocations, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(collocations, "PATTERNS_AT_ONCE", patterns)
    r = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["a", "aa", "é"]
    docs = [(r.choice(["en", "de", None]), " ".join(r.choices(words, weights=range(15, 0, -1), k=r.randint(0, 300))).replace("w3 w4", "w3. w4")) for _ in range(60)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    assert mined(df, least=12, top=50) == by_hand(docs, least=12, top=50)


def test_blocks_part_between_pieces():
    r = random.Random(4)
    for _ in range(200):
        texts = ["".join(r.choices("aB \t.\n", k=r.randint(0, 60))).encode() for _ in range(r.randint(0, 6))]
        whole = collocations.spaced(texts)
        pieces = [p for t in texts for p in re.split(rb"[.,;:!?\x0A-\x0D]", t.lower()) if p.split()]
        for size in (1, 7, 40, 1000):
            parts = list(collocations.blocks(whole, size))
            assert [p.split() for b in parts for p in b.split(b"\n") if p.split()] == [p.split() for p in pieces]
            assert all(b[:1] == b[-1:] == b" " for b in parts)


def test_scores_of_counts_beyond_64_bits(spark):
    f = spark.createDataFrame([("en", "a b", 9 * 10**18), ("en", "a", 9 * 10**18 + 1), ("en", "b", 9 * 10**18 + 5)], "lang string, phrase string, f long")
    n = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    (row,) = collocations.ranked(f, n, 30, 2000, 80).collect()
    assert row.score == 2000000 * 9 * 10**18 // (18 * 10**18 + 6)


def test_phrases_without_a_witness_are_told_all_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    honest, r = collocations.heavy, random.Random(6)
    blind = lambda *a: honest(*a).withColumn("witnesses", F.when(F.col("part") % 2 == 0, F.expr("unhex(repeat('FFFF', int(n)))")).otherwise(F.col("witnesses")))
    monkeypatch.setattr(collocations, "heavy", blind)
    docs = [("en", " ".join(r.choices("abcdefg", k=200))) for _ in range(30)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert mined(df) == by_hand(docs)


def test_parts_of_what_is_told_are_not_told_themselves(spark):
    """q1 q2 is covered by w q1 q2, which does not come first, and is a part of q1 q2 z, which does."""
    docs = [("en", x) for x, n in (("w q1 q2", 65), ("w q1 q2 z", 25), ("q1 q2 z", 10), ("w. " * 20, 100)) for _ in range(n)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    (row,) = got = mined(df, top=1)
    assert got == by_hand(docs, top=1) and row[2] == "q1 q2 z"


def test_rounds_of_phrases_change_nothing(spark, monkeypatch):
    r = random.Random(9)
    docs = [(r.choice(["en", "de"]), " ".join(r.choices(["a", "b", "cc", "é"], k=100))) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "PHRASES_AT_ONCE", 50)
    monkeypatch.setattr(collocations, "SUMMED_BITS", 3)
    assert mined(df) == by_hand(docs)


def test_automata_do_not_grow_with_the_frequent_phrases(spark, monkeypatch):
    honest, r, sizes = collocations.counted, random.Random(7), []

    def counted(docs, patterns):
        sizes.append(patterns.count())
        return honest(docs, patterns)

    monkeypatch.setattr(collocations, "counted", counted)
    docs = [("en", " ".join(r.choices([f"w{k}" for k in range(30)], k=2000))) for _ in range(30)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert mined(df, top=5) == by_hand(docs, top=5) and len(sizes) == 1 and sizes[0] <= 5 * 7


@pytest.mark.parametrize("cells", [1, 4, 1 << 44])
def test_phrases_of_one_cell_are_told_apart_by_their_bytes(monkeypatch, cells):
    honest, r = collocations.Grams.cells, random.Random(8)
    monkeypatch.setattr(collocations.Grams, "cells", lambda self, at, k: honest(self, at, k) % collocations.np.uint64(cells))
    words = ["a", "aa", "abcdefgh", "abcdefghi", "é", "x" * 300, "x" * 299 + "y", "abcdefghabcdefgh"]
    block = collocations.spaced(" ".join(r.choices(words, k=3)).encode() + b"." for _ in range(400))
    pieces = [p.split() for p in block.decode().split("\n")]
    f = Counter(" ".join(w[i : i + k]) for w in pieces for k in range(1, 5) for i in range(len(w) - k + 1))
    asked = [*f, "b", "aa b"]
    cell = lambda p: int(collocations.Grams(f" {p} ".encode(), "en").cells(collocations.np.array([0]), len(p.split()))[0])
    table = collocations.pa.table({"lang": ["en", "de"] * len(asked), "phrase": [p for p in asked for _ in "12"], "cell": [cell(p) for p in asked for _ in "12"]})
    patterns = collocations.Patterns(table)
    found = Counter(x for p in patterns.found(collocations.Grams(block, "en"), "en", 4) for x in p.tolist())
    assert found == {2 * k: f[p] for k, p in enumerate(asked) if f[p]}
