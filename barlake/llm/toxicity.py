"""Toxicity by a grammar of weighted finite-state transducers over clauses, with weights learnt from labelled documents.

A lexicon turns the words of a clause into labels: insult, act, intent, target, negation, report, other. Three transducers
mark what their context says of insults and acts: "~" in the scope of a negation, "^" after a verb of reporting, "@" with a
target in the clause, before or after. A last one matches marked insults, and threats of an intent with an act on a target.
compose() makes one machine of the four; the reading of a clause is its path of the largest weight. Insults weigh their
log odds, marks shift them. A document's score is that of its matched words, not of its length: each distinct word counts
once, by its best clause, and the further ones count less and less.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import id_text, map_rows

#: Labelled rows that weights are learnt from, at most: those with the smallest hashes of their ids. The lexicon is bounded by them.
MAX_LABELLED = 20_000
#: Standard deviations of the lower bound of an entry's log odds, and the least bound that makes an entry.
CAUTION, MIN_WEIGHT = 1.6, 1.5
#: Log odds of a document in which nothing matches, and the share that each further matched word counts.
BIAS, FURTHER = -4.5, 0.7
#: Shifts of log odds by marks, before any label is seen, and the labelled documents that this belief is worth.
SHIFTS, BELIEF = {"~": -3.0, "^": -2.5, "@": 0.5}, 50
#: Weight of a threat: an intent, an act at most so many words on, and a target.
THREAT, WITHIN = 4.0, 3

# Closed-class words of the grammar in the languages served.
WORDS = {
    "negation": "not never no nobody isn aren wasn don nicht kein keine nie nunca jamás jamais pas aucun",
    "report": "said says wrote reported quoted claimed called sagte schrieb berichtete dit écrit rapporte dijo escribió",
    "target": "you your yours u du dich dein ihr euch tu toi vous ton votre tú ti usted ustedes vosotros",
    "intent": "will gonna shall going werde werden vais allons voy vamos",
    "act": "kill hurt destroy beat burn shoot stab hang töten verletzen schlagen verbrennen tuer frapper brûler matar golpear quemar",
}
CLOSED = {w: label for label, words in WORDS.items() for w in words.split()}

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of longer words that are weighed beside whole words.
PREFIXES = (4, 5, 6)


@dataclass
class Machine:
    """A weighted transducer: arcs by (state, label) as (label put out, weight, next state); state 0 is the first."""

    arcs: dict[tuple, list[tuple[str, float, int]]] = field(default_factory=lambda: defaultdict(list))
    final: set = field(default_factory=set)

    def arc(self, state, label: str, out: str, to, weight: float = 0.0) -> None:
        self.arcs[state, label].append((out, weight, to))

    def read(self, state, label: str) -> list[tuple]:
        return self.arcs.get((state, label), [])


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that reads what a reads and puts out what b makes of a's output; only states in reach."""
    out, seen, todo = Machine(), {(0, 0): 0}, [(0, 0)]
    labels = defaultdict(set)
    for state, label in a.arcs:
        labels[state].add(label)
    while todo:
        x, y = todo.pop()
        here = seen[x, y]
        if x in a.final and y in b.final:
            out.final.add(here)
        for label in sorted(labels[x]):
            for middle, w, x2 in a.read(x, label):
                for made, v, y2 in b.read(y, middle):
                    if (x2, y2) not in seen:
                        seen[x2, y2] = len(seen)
                        todo.append((x2, y2))
                    out.arc(here, label, made, seen[x2, y2], w + v)
    return out


LABELS = ("insult", "act", "intent", "target", "negation", "report", "other")
MARKED = ("insult", "act")


def marks(*done: str) -> list[str]:
    """Labels as they are once some of the marks may have been put on insults and acts."""
    out = list(LABELS)
    for mark in done:
        out += [x + mark for x in out if x.startswith(MARKED)]
    return out


def negation(scope: int = 3) -> Machine:
    """Marks what stands within so many words after a negation."""
    m = Machine(final=set(range(scope + 1)))
    for state in range(scope + 1):
        for x in LABELS:
            m.arc(state, x, x + "~" if state and x in MARKED else x, scope if x == "negation" else max(0, state - 1))
    return m


def reported() -> Machine:
    """Marks what follows a verb of reporting."""
    m = Machine(final={0, 1})
    for state in (0, 1):
        for x in marks("~"):
            m.arc(state, x, x + "^" if state and x.startswith(MARKED) else x, 1 if x == "report" else state)
    return m


def targeted() -> Machine:
    """Marks all in a clause that has a target. States: 0 no claim yet, 1 none claimed, 2 claimed, 3 claimed and seen."""
    m = Machine(final={0, 1, 3})
    for x in marks("~", "^"):
        marked = x + "@" if x.startswith(MARKED) else x
        for state, to in ((0, 1), (1, 1)):
            m.arc(state, x, x, to)
        for state in (0, 2, 3):
            m.arc(state, x, marked, 3 if x == "target" or state == 3 else 2)
    return m


def matches(shifts: dict[str, float]) -> Machine:
    """Puts out "match" for an insult or a threat, each by the shifts of its marks, and "skip" else, at no weight."""
    m = Machine(final=set(range(WITHIN + 2)))
    for state in range(WITHIN + 2):
        on = max(0, state - 1)
        for x in marks("~", "^", "@"):
            to = WITHIN + 1 if x == "intent" else on
            m.arc(state, x, "skip", to)
            by = sum(shifts[c] for c in x if c in shifts)
            if x.startswith("insult"):
                m.arc(state, x, "match", to, by)
            if x.startswith("act") and state and "@" in x:
                m.arc(state, x, "match", to, by - shifts["@"] + THREAT)
    return m


def grammar(shifts: dict[str, float]) -> Machine:
    return compose(compose(compose(negation(), reported()), targeted()), matches(shifts))


def best(machine: Machine, clause: list[tuple[str, str, float]]) -> tuple[float, list[tuple[str, float]]]:
    """Largest weight of a path over (word, label, weight), and the words it matches with their weights, all above 0."""
    live: dict = {0: (0.0, None)}
    for word, label, weight in clause:
        new: dict = {}
        for state, (total, path) in live.items():
            for made, w, to in machine.read(state, label):
                gain = w + weight if made == "match" else 0.0
                if made == "match" and gain <= 0:
                    continue
                if to not in new or total + gain > new[to][0]:
                    new[to] = (total + gain, (path, word, gain) if made == "match" else path)
        live = new
    total, path = max((v for s, v in live.items() if s in machine.final), key=lambda v: v[0])
    found = []
    while path:
        path, word, gain = path
        found.append((word, gain))
    return total, found[::-1]


class Grammar:
    """The composed machine with a lexicon of words, and of beginnings of words that end in a star."""

    def __init__(self, lexicon: dict[str, float], shifts: dict[str, float] = SHIFTS):
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.machine = grammar(shifts)
        self.memo: dict[str, tuple[str, float]] = {}

    def label(self, word: str) -> tuple[str, float]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            w = max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) > n), 0.0)
            found = self.memo[word] = (CLOSED[word], 0.0) if word in CLOSED else ("insult", w) if w else ("other", 0.0)
        return found

    def clauses(self, text: str) -> list[list[tuple[str, str, float]]]:
        """The labelled clauses that could match: with an insult, or with an act."""
        distinct = {w: self.label(w) for w in set(_WORD.findall(text))}
        if not any(label in MARKED for label, _ in distinct.values()):
            return []
        out: list[list[tuple[str, str, float]]] = []
        clause: list[tuple[str, str, float]] = []
        for t in [*_TOKEN.findall(text), "."]:
            if t in ".!?;\n":
                if any(label in MARKED for _, label, _ in clause):
                    out.append(clause)
                clause = []
            else:
                clause.append((t, *distinct[t]))
        return out

    def matched(self, text: str) -> dict[str, float]:
        """Distinct matched words with the largest weight that a clause gives them."""
        out: dict[str, float] = {}
        for clause in self.clauses(text.lower()):
            for word, w in best(self.machine, clause)[1]:
                out[word] = max(w, out.get(word, 0.0))
        return out

    def score(self, text: str) -> float:
        weights = sorted(self.matched(text).values(), reverse=True)
        return 1 / (1 + math.exp(-min(50.0, BIAS + sum(w * FURTHER**k for k, w in enumerate(weights[:60])))))

    def kinds(self, text: str) -> str:
        """The marks, and "=" for none, that insults bear in text."""
        found = set()
        for clause in self.clauses(text.lower()):
            live = {0}
            marking = self.marking
            target = any(label == "target" for _, label, _ in clause)
            for _, label, _ in clause:
                (made, _, to), *_ = marking.read(live.pop(), label)
                live.add(to)
                if made.startswith("insult"):
                    found |= set(made[len("insult") :]) | ({"@"} if target else set()) or {"="}
        return "".join(sorted(found))

    @property
    def marking(self) -> Machine:
        if not hasattr(self, "_marking"):
            self._marking = compose(negation(), reported())
        return self._marking


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and y of the rows to learn from: ids whose crc32 mod 4 is not 2, max_labelled at most. Null labels and ids
    are left out; of an id with several labels the largest counts."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Words, and beginnings of words marked by a star, with the lower bound of their log odds for label 1.

    Counts are document frequencies over labelled(), added up by Spark; so many pairs of an id and a label are broadcast,
    and the entries that reach MIN_WEIGHT are as bounded. No labels, or none that is 1, give no entries; a repeated id
    counts each of its rows.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stem = lambda n: F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    stems = F.array_distinct(F.flatten(F.array(*map(stem, PREFIXES))))
    seen = id_text(docs).join(F.broadcast(labelled(labels, max_labelled)), "doc_id").select("y", words.alias("words")).select("y", F.explode(F.concat(F.array(F.lit("")), "words", stems)).alias("w"))
    counts = seen.groupBy("w").agg(F.sum("y").cast("double").alias("t"), F.sum(1 - F.col("y")).cast("double").alias("c"))
    total = F.broadcast(counts.where("w = ''").select(F.col("t").alias("bad"), F.col("c").alias("good")))
    odds = F.log((F.col("t") + 0.5) / (F.col("bad") + 1)) - F.log((F.col("c") + 0.5) / (F.col("good") + 1)) - CAUTION * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best_words = counts.where("w != '' AND t > 1").crossJoin(total).select("w", odds.alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
    return {r.w: r.weight for r in best_words.collect()}


def learn_shifts(docs: DataFrame, labels: DataFrame, lexicon: dict[str, float], max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """What a mark adds to the log odds of an insult: those of labelled documents with such insults against those with
    unmarked ones, drawn to SHIFTS as by BELIEF documents."""
    if not lexicon:
        return dict(SHIFTS)
    g = Grammar(lexicon)
    rows = id_text(docs).join(F.broadcast(labelled(labels, max_labelled)), "doc_id").select("y", "text")
    kinds = map_rows(rows, lambda b: {"y": b.column(0).cast("int32"), "kinds": [g.kinds(t) for t in b.column(1).to_pylist()]}, "y int, kinds string")
    found = {(r.kinds, r.y): r["count"] for r in kinds.groupBy("kinds", "y").count().collect()}
    odds, n = {}, {}
    for mark in ("=", *SHIFTS):
        t, c = (sum(k for (kinds, y), k in found.items() if mark in kinds and y == want) for want in (1, 0))
        odds[mark], n[mark] = math.log((t + 0.5) / (c + 0.5)), t + c
    return {m: max(-5.0, min(2.0, (BELIEF * s + n[m] * (odds[m] - odds["="])) / (BELIEF + n[m]))) if n["="] else s for m, s in SHIFTS.items()}


def score(docs: DataFrame, lexicon: dict[str, float], shifts: dict[str, float] = SHIFTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and score in (0, 1). Only the text is looked at.

    Null and empty texts get the score of a document without matches. Texts of any length are read whole; repeated
    rows give repeated results, an empty table none; other columns are not looked at.
    """

    def rows(batch):
        return {"doc_id": batch.column(0), "score": [g.score(t) for t in batch.column(1).to_pylist()]}

    g = Grammar(lexicon, shifts)
    return map_rows(id_text(docs, id_col, text_col), rows, "doc_id long, score double")
