"""Personal data: patterns on the text as it is, and again on a normalised copy that keeps source offsets."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

from pyspark.sql import DataFrame

from barlake.llm.common import Covered, id_text, map_rows, span_list

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The lookbehind changes no match, as a match takes digits to the end of their run; it spares long runs a try at each digit.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of the address pattern, looked for around each at-sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[tuple[int, int, str]]:
    """Identifiers of all kinds: leftmost non-overlapping per kind, failing matches dropped, no retries."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# Letters and signs that look alike.
HOMOGLYPHS = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧοｏ＠．․。＋－‐‑–—−   　",
    "ABEKMHOPCTXaeopcyxijsABEZHIKMNOPTYXoo@...+------    ",
)
#: Code points that may have a compatibility form with a sign of identifiers. Latin-1 stays as it is, as do raised and
#: lowered digits, which mostly number footnotes, and the large blocks of ideographs and syllables, which have none.
FOLDABLE = (range(0x100, 0x2070), range(0x20A0, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000))


def folded() -> dict[int, str]:
    """Characters with one sign of identifiers as their compatibility form, and the decimal digits of all scripts."""
    out = {}
    for c in chain(*FOLDABLE):
        x = chr(c)
        value = unicodedata.decimal(x, None)
        form = str(value) if value is not None else unicodedata.normalize("NFKC", x)
        if len(form) == 1 and form != x and (form in LOCAL or form in "@()"):
            out[c] = form
    return out


def spans_of(points: list[int]) -> str:
    """The inside of a regular expression's class for sorted code points."""
    out, k = [], 0
    while k < len(points):
        last = k
        while last + 1 < len(points) and points[last + 1] == points[last] + 1:
            last += 1
        out.append(re.escape(chr(points[k])) + (f"-{re.escape(chr(points[last]))}" if last > k else ""))
        k = last + 1
    return "".join(out)


#: What a character stands for: its compatibility form, or the letter or sign that it looks like.
PLAIN = folded() | {c: chr(x) for c, x in HOMOGLYPHS.items()}
# Spelled digits, and words for the at-sign and the dot.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = "at|arroba|arobase|chez|klammeraffe"
DOT_WORDS = "dot|punto|point|punkt"

_NUMBER = frozenset("0123456789+().-")
INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile("[" + spans_of(sorted(PLAIN)) + INVISIBLE + "]")
#: Numbers of characters in markup, and names of the two signs.
_ENTITY = re.compile(r"&(?:#(?:[0-9]{2,3}|x[0-9a-f]{2})|commat|period);", re.I)
_DOTTED = re.compile(rf"\b(?:{DOT_WORDS})\b|[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]|[\[({{<]\s?(?:{AT_WORDS}|@)\s?[\])}}>]", re.I)
_SPELLED = re.compile(r"\b(?:%s)(?:[\s,.-]+(?:%s|[0-9]+)){2,}\b" % (("|".join(sorted(DIGIT_WORDS, key=len, reverse=True)),) * 2), re.I)
_PLUS = re.compile(r"\bplus\b[\s-]+(?=[0-9])", re.I)
# The lookbehinds here and below let a long run be tried once, from its beginning, not from each of its characters.
_AT_BRACKET = re.compile(rf"(?<!\s)\s*[\[({{<]\s?(?:{AT_WORDS}|@)\s?[\])}}>]\s*", re.I)
_DOT_BRACKET = re.compile(rf"(?<!\s)\s*[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]\s*", re.I)
# Last labels that make a run of bare words with "dot" a domain.
LAST_LABELS = "com|org|net|edu|gov|info|biz|io|co|dev|app|eu|de|fr|es|uk|us|ca|at|ch|it|nl|mx|ar"
_LABEL, _DOT = "[A-Za-z0-9-]+", rf"\s+(?:{DOT_WORDS})\s+"
#: Bare words count only as a whole address: prose has "at" and "dot" too.
_BARE_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]+{_DOT})?[A-Za-z0-9._%+-]+(?:\s+(?:{AT_WORDS})\s+|@)(?:{_LABEL}(?:{_DOT}|\.))+(?:{LAST_LABELS})\b", re.I)
_BARE_IP = re.compile(rf"\b[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}\b", re.I)
_BARE_DOT, _BARE_AT = re.compile(_DOT, re.I), re.compile(rf"\s+(?:{AT_WORDS})\s+", re.I)
#: The same with any last label and with plain dots, to be weighed; and, as a sign, what follows the first part of one.
_WEIGHED = re.compile(rf"(?<![A-Za-z0-9._%+-])((?:[A-Za-z0-9._%+-]+{_DOT})?[A-Za-z0-9._%+-]+)(\s+(?:{AT_WORDS})\s+|@)((?:{_LABEL}(?:{_DOT}|\.))+[A-Za-z]{{2,}})\b", re.I)
_AT_DOMAIN = re.compile(rf"\s(?:{AT_WORDS})\s+(?:{_LABEL}(?:{_DOT}|\.))+[A-Za-z]{{2,}}\b", re.I)
_INNER_DOT = re.compile(r"\.[A-Za-z0-9-]")
_SURE_AT = re.compile(r"\s*(?:arroba|arobase|klammeraffe|@)\s*", re.I)
#: Evidence for and against an address in bare words. Country labels that are words of prose speak for nothing.
_LAST = frozenset((LAST_LABELS + "|ac|ad|ae|al|ar|au|ba|bd|bg|bo|br|by|cl|cn|cr|cu|cy|cz|dk|ec|ee|eg|fi|ge|gr|gt|hk|hr|hu|id|ie|il|ir|jp|ke|kr|kz|lb|li|lk|lt|lu|lv|ma|md|mt|ng|np|nz|pa|pe|ph|pk|pl|pt|py|qa|ro|rs|ru|sa|sg|si|sk|sv|th|tn|tr|tw|ua|uy|ve|vn|za|name|online|shop|site|store|tech|xyz|cloud|email|mail").split("|"))
_PROVIDERS = re.compile(r"(?:gmail|googlemail|gmx|yahoo|ymail|hotmail|outlook|live|aol|icloud|proton|protonmail|posteo|mail|email|web|freenet|t-online|orange|wanadoo|laposte|free|libero)\.[a-z.]+", re.I)
_CUE = re.compile(r"mail|contact|write to|reach|address|kontakt|schreib|adress|correo|courriel|escrib|écri", re.I)
_PROSE = frozenset(
    "a about again all also am an and any app are as at available away be been best blog both but by call came can check click code come could data day days did do docs does down each else end events even everyone file find for found free from get go goes going good had has have he hello help her here hers him his home host how i if in info information into is it items its job jobs join just keep last later learn less link live located look made make many may me meet met more most much my near new news no not now of off on once one online only open or order other our out over own page part people place play please post price prices read register sale same saw say see seen sell she shop sign site sites so sold some speak staff start started stay still stop store stuff such talk team than that the their them then there these they this those time to today together too try up us used user users very via video visit was watch we well were what when where which who why will with work works would yet you your"
    " aber als am auf auch aus bei bis da dann das dem den der des die doch dort ein eine einen einer er es für hat haben hier ich ihr im ist jetzt kann man mehr mit nach nicht noch nur oder sein sich sie sind so und uns vom von vor war wie wir wird zu zum zur"
    " au aux avec ce ces cette chez comme dans de du elle elles en est et eux il ils je la le les leur lui mais moi ne nous on ou par pas passe pour que qui reste sa se ses son sont sur toi tout tu un une va vous y final"
    " al como con cual del desde donde el ella en era es esta este hay la las lo los mas mi muy no nos para pero por porque que se ser si sin sobre su sus te un una y ya".split()
)
#: Words joined to the address by one sign, the same before and after each; and letters set apart by spaces.
_LINKED = re.compile(rf"(?<![A-Za-z0-9._%+~*-])([A-Za-z0-9.%+]+(?:[_-][A-Za-z0-9.%+]+)*?)([-_*~])(?:{AT_WORDS})\2((?:[A-Za-z0-9]+\2(?:{DOT_WORDS})\2)+(?:{LAST_LABELS}))(?![A-Za-z0-9_~*-])", re.I)
_LINK = re.compile(rf"([-_*~])(?:{AT_WORDS})\1[A-Za-z0-9]+\1(?:{DOT_WORDS})\1", re.I)
_APART = re.compile(r"(?<!\s[A-Za-z0-9._+-]\x20)(?<!\S)((?:[A-Za-z0-9._+-]\x20){2,}@)((?:\x20[A-Za-z0-9.-])+)(?!\S)")
_AT_APART = re.compile(r"(?<=\x20[A-Za-z0-9._+-]\x20)@(?=\x20[A-Za-z0-9-]\x20)")


def _entity(m: re.Match) -> str:
    """The character, where it is one of ASCII that shows."""
    name = m[0][1:-1].lower()
    code = {"commat": 64, "period": 46}.get(name) or (int(name[2:], 16) if name[1] == "x" else int(name[1:]))
    return chr(code) if 32 < code < 127 else m[0]


def _linked(m: re.Match) -> str:
    return m[1] + "@" + re.sub(rf"{re.escape(m[2])}(?:{DOT_WORDS}){re.escape(m[2])}", ".", m[3], flags=re.I)


def _apart(m: re.Match) -> str | tuple[str, int]:
    """The letters pushed together, to the end of the longest known last label, and that end; what prose follows stays."""
    local, domain = m[1].replace(" ", ""), m[2].replace(" ", "")
    for end in range(len(domain), max(3, len(domain) - 3), -1):
        if domain[:end].rpartition(".")[2].lower() in _LAST:
            return local + domain[:end], m.end() - 2 * (len(domain) - end)
    return m[0]


def _prose(word: str) -> bool:
    """A word that prose has before "at", or a number."""
    return word.lower() in _PROSE or word.isdecimal() or re.fullmatch("[A-Za-z]{2,}(?:ed|ing)", word) is not None


def _address(local: str, at: str, domain: str, before: str) -> bool:
    """Whether bare words are an address, by the weight of what speaks for it.

    An unmistakable sign, a form that no word of prose has, or two of: no word of prose as name, a known last label,
    "dot" in words, a provider of mail, a mention of mail before it.
    """
    plain, labels = _BARE_DOT.sub(".", domain), re.split(r"\.", _BARE_DOT.sub(".", domain))
    if any(_prose(x) and not x.isdecimal() for x in labels[:-1]) or (labels[-1].lower() in _PROSE and labels[-1].lower() not in _LAST):
        return False
    weight = 2 if re.search(r"[a-z0-9][._%+-][a-z0-9]|[a-z][0-9]", _BARE_DOT.sub(".", local), re.I) else -3 if _prose(local) else 1
    weight += 2 * (_SURE_AT.fullmatch(at) is not None)
    weight += labels[-1].lower() in _LAST and labels[-1].lower() not in _PROSE
    weight += re.search(r"\sdot\s", domain, re.I) is not None
    return weight + (_PROVIDERS.fullmatch(plain) is not None) + (_CUE.search(before) is not None) >= 2


def _joined(m: re.Match) -> str:
    """The address of bare words; one with a plain domain after a bare "at" is left to be weighed."""
    dots = _BARE_DOT.search(m[0])
    return _BARE_AT.sub("@", _BARE_DOT.sub(".", m[0])) if dots else m[0]


def _weighed(m: re.Match) -> str:
    """The longest part of bare words, from their beginning, that is an address; the rest stays as it is."""
    local, at, domain = m[1], m[2], m[3]
    before = m.string[max(0, m.start() - 60) : m.start()]
    ends = [x.start() for x in re.finditer(rf"{_DOT}|\.", domain, re.I)][1:] + [len(domain)]
    # An address that is whole without words for dots is found as it is, and prose goes on after it.
    whole = re.match(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", domain) if at == "@" else None
    if whole and not _BARE_DOT.search(local):
        return m[0]
    for end in reversed(ends[-8:]):
        if re.search("[A-Za-z]{2,}$", domain[:end]) and _address(local, at, domain[:end], before):
            return _BARE_DOT.sub(".", local) + "@" + _BARE_DOT.sub(".", domain[:end]) + domain[end:]
    return m[0]


class Aligned:
    """A rewritten text with, for each of its characters, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """One transducer: each match becomes to(match); the parts between stay. Where to(match) is a pair, its second
        value is where the part that it rewrites ends."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if m.end() == m.start():
                continue
            made = to(m)
            new, last = made if isinstance(made, tuple) else (made, m.end())
            out += [self.text[at : m.start()], new]
            start += self.start[at : m.start()] + [self.start[m.start()]] * len(new)
            end += self.end[at : m.start()] + [self.end[last - 1]] * len(new)
            at = last
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end = start + self.start[at:], end + self.end[at:]


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    return PLAIN[ord(c)]


def _digits(m: re.Match) -> str:
    return "".join(DIGIT_WORDS.get(w.lower(), w) for w in re.split(r"[\s,.-]+", m[0]) if w)


def _windows(text: str, signs: list[tuple[int, int]], reach: int = 160) -> list[tuple[int, int]]:
    """Disjoint stretches of the text around signs, each widened to the ends of the runs, without blanks or of digits
    and blanks, that it would cut."""
    near: list[list[int]] = []
    for a, b in sorted((max(0, a - reach), min(len(text), b + reach)) for a, b in signs):
        if near and a <= near[-1][1]:
            near[-1][1] = max(near[-1][1], b)
        else:
            near.append([a, b])

    def cuts(i: int) -> bool:
        """Whether a run goes on over place i."""
        x, y = text[i - 1], text[i]
        if not x.isspace() and not y.isspace():
            return True
        if x.isspace():
            return y in _NUMBER and i > 1 and text[i - 2] in _NUMBER
        return x in _NUMBER and i + 1 < len(text) and text[i + 1] in _NUMBER

    out: list[list[int]] = []
    for k, (a, b) in enumerate(near):
        floor = out[-1][1] if out else 0
        top = near[k + 1][0] if k + 1 < len(near) else len(text)
        while a > floor and cuts(a):
            a -= 1
        while b < top and cuts(b):
            b += 1
        if out and a <= floor:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def disguised(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that appear only once the text is normalised, in source offsets; spans inside base ones are left out.

    The transducers run around each sign of a disguise, not over prose without any; what is around a sign ends where
    no identifier is cut.
    """
    signs = [m.span() for p in (_ODD, _DOTTED, _SPELLED, _ENTITY, _LINK, _AT_APART) for m in p.finditer(text)]
    if signs or _INNER_DOT.search(text):
        signs += [m.span() for m in _AT_DOMAIN.finditer(text)]
    if not signs:
        return []
    out, known = [], {k: Covered((s, e) for s, e, kind in base if kind == k) for k in KINDS}
    for a, b in _windows(text, signs):
        part = Aligned(text[a:b])
        part.rewrite(_ENTITY, _entity)
        part.rewrite(_ODD, _plain)
        part.rewrite(_SPELLED, _digits)
        part.rewrite(_PLUS, lambda m: "+")
        part.rewrite(_AT_BRACKET, lambda m: "@")
        part.rewrite(_DOT_BRACKET, lambda m: ".")
        part.rewrite(_LINKED, _linked)
        part.rewrite(_APART, _apart)
        part.rewrite(_BARE_ADDRESS, _joined)
        part.rewrite(_WEIGHED, _weighed)
        part.rewrite(_BARE_IP, _joined)
        for s, e, kind in find(part.text):
            s, e = a + part.start[s], a + part.end[e - 1]
            if not known[kind].holds(s, e):
                out.append((s, e, kind))
    return out


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, base (spans of the plain patterns), spans (those and the disguised ones), redacted.

    Offsets are code points of the source text. Null and empty texts have no spans; texts of any length are read
    whole; repeated rows give repeated results, an empty table none; other columns are not looked at. A disguised
    span inside a plain one of its kind is not listed; one that goes beyond it is, beside the plain one.
    """

    def rows(batch):
        base, spans, redacted = [], [], []
        for text in batch.column(1).to_pylist():
            found = find(text)
            extra = disguised(text, found)
            base.append(span_list(found, KINDS))
            spans.append(span_list(found + extra, KINDS))
            redacted.append(redact(text, found + extra) if found or extra else text)
        return {"doc_id": batch.column(0), "base": base, "spans": spans, "redacted": redacted}

    return map_rows(id_text(df, id_col, text_col), rows, "doc_id long, base string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
