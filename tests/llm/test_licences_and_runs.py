import hashlib
import random
import zlib

import pytest
from conftest import SMALL, against_oracle

from barlake.llm import common, entries, licences, runs

LONG = "Long words run on and on without an end in sight. " * 400
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "short"), (5, LONG), (5, LONG), (6, LONG), (7, "a " * 60), (8, "\x00\x1c\x85 é 日本語"), (None, "no id at all no id at all no id at all no id at all")]
SCHEMA = "doc_id long, text string, w string, i int, t int, places string, notices string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", None) for i, t in ODD], SCHEMA)


@pytest.mark.parametrize("f", [licences.scan, runs.find])
def test_odd_and_empty_tables(odd, f):
    got = f(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert f(odd.limit(0)).count() == 0


# --- licences


def test_licences_equal_sql(spark):
    against_oracle(spark, entries.op11_licences, licences.ORACLE_SQL)


def words_by_hand(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_phrases_equal_brute_force(spark):
    text = "Under the MIT-License, under THE mit license: CC-BY-NC-BY-NC cc by nc. Apache License, Version 2 and ünder the mit license; mit"
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(100, text), (101, "license mit the under"), (102, "cc by " * 500 + "nc"), (103, "KUnder the mit license")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = words_by_hand(t)
        starts = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want = len(w), len(starts), min(starts)[0] if starts else None, max(starts)[0] if starts else None, ",".join(sorted({x for _, x in starts}))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert (got[i].score == 1.0) == bool(starts)
    assert got[100].n_base == 5 and got[101].n_base == 0 and got[102].n_base == 1


def test_notices(spark):
    mit = licences.TEMPLATES[[t.label for t in licences.TEMPLATES].index("mit")]
    text = " ".join(mit.words)
    filler = "lorem ipsum dolor sit amet " * 40
    rows = [(1, filler + text.upper() + " " + filler), (2, text.replace("obtaining", "who obtains").replace("charge to", "charge - to")), (3, text.replace("without restriction", "with care")), (4, " ".join(reversed(text.split()))), (5, " ".join(sorted(text.split()))), (6, filler), (7, "Released under the GNU General Public License, version 3."), (8, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "", 5: "", 6: "", 7: "gpl-3", 8: "gpl-3"}
    assert got[1].score == 1.0 and 0.6 <= got[2].score <= 1.0 and got[6].score == 0.0 and got[1].n_base == 0


def test_each_template_is_found_in_its_own_text(spark):
    rows = [(k, f"x y z {' '.join(t.words)} x y z") for k, t in enumerate(licences.TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(licences.TEMPLATES[k].label in labels for k, labels in got.items())


# --- runs


def runs_by_hand(x):
    out = set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            size = i + q - s
            smaller = any(all(x[k] == x[k + d] for k in range(s, s + size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.add((s, size, q))
            i += s == i
    return sorted(out)


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(3000):
        x, letters = [], [b"a", b"b", b"c"][: r.randint(1, 3)]
        while len(x) < r.randint(0, 90):
            x += [r.choice(letters) for _ in range(r.randint(1, 7))] * r.randint(1, 8)
            x *= r.choice([1, 1, 1, 5])
        assert runs.runs(x[:300]) == runs_by_hand(x[:300])


def test_time_follows_the_words():
    import time

    def took(n):
        began = time.process_time()
        for x in ([b"a"] * n, [b"a", b"b"] * (n // 2), [bytes([97 + bin(k).count("1") % 2]) for k in range(n)], [b"a"] * (n // 2) + [b"b"] + [b"a"] * (n // 2)):
            runs.runs(x)
        return time.process_time() - began

    assert took(80_000) < 8 * took(20_000) + 1


def test_runs_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in entries.op13_runs(spark, SMALL).collect()}
    docs = [(r.doc_id, r.text) for r in common.documents(spark, SMALL).select("doc_id", "text").collect()]
    assert len(got) == len(docs)
    for i, t in docs:
        x = (t or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and x:
            g, n = h // 10, len(x)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[k] if k < a else x[a + (k - a) % p] for k in range(n)]
        found = runs_by_hand(x)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert got[i] == (len(found), *told, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(w for k, w in enumerate(x) if k not in gone)))
    assert sum(v[0] for v in got.values()) > 5
