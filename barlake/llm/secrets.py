"""Secret scan by token efficiency: strings that a subword vocabulary encodes badly are taken for random keys."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.llm.common import SLICE, Covered, halves, id_text, map_rows, span_list

KINDS = {"assign": 0, "access": 1, "hex": 2, "token": 3}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs of key characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests and identifiers that are random by nature but no secrets.
KNOWN = re.compile(
    r"""[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"""  # UUID
    r"""|(?:sha(?:1|224|256|384|512)|md5)[-:=_][A-Za-z0-9+/=]+"""  # labelled digest
    r"""|[0-9TZ:+/_-]+""",  # dates, phone and order numbers
    re.A,
)
#: snake_case_2, path/part3: a name if its letters encode well.
NUMBERED = re.compile(r"([A-Za-z]+(?:[_/-][A-Za-z]+)*)[_/-]?[0-9]{1,4}")
#: Random by nature, inside a longer run.
INSIDE = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?:sha(?:1|224|256|384|512)|md5)[-:=_][A-Za-z0-9+/=]+")
PART = re.compile("[A-Za-z0-9]+")
#: Accession, account and part numbers: few letters, then digits only; and measures: 1280x720, 44100Hz.
SERIAL = re.compile("[A-Za-z]{1,6}[0-9]+|[0-9]+[A-Za-z]{1,3}[0-9]*")
#: A secret between separators has a part of so many characters at least.
LONGEST = 6
#: Letters of one case, a capital first or not, look like a word: German ones reach 2.3 characters a token, so that only
#: fewer than this count as random, and only from so many letters on.
WORD, WORD_RATIO, WORD_LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+"), 2.0, 8
#: The name of a digest with a colon, right before a candidate.
LABELLED = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5)\s?:\s?$", re.I)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secret-scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches per kind; matches that fail their length are dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if re.search("[0-9]|[a-f]{16}", text):
        out += [(m.start(), m.end(), "hex") for m in _hex_runs(text)]
    return out


#: Equal to HEX with the length test after it: both take whole maximal runs.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def _hex_runs(text: str):
    return _LONG_HEX.finditer(text)


def dense(s: str, enc, max_ratio: float, least: int = 16) -> list[tuple[int, int]]:
    """Stretches of at least so many characters of a run whose parts, between / _ - + =, encode badly taken together.

    Numbers, serial numbers, vocabulary words, short words, UUIDs and labelled digests speak against a stretch by their
    length. A stretch of three quarters of the run or more is the whole run.
    """
    known = Covered(m.span() for m in INSIDE.finditer(s))
    parts = []
    for m in PART.finditer(s):
        p, word = m[0], WORD.fullmatch(m[0])
        n = 0 if p.isdecimal() or SERIAL.fullmatch(p) or word and len(p) < WORD_LETTERS or known.meets(*m.span()) else len(enc.encode_ordinary(p))
        parts.append((m.start(), m.end(), (min(WORD_RATIO, max_ratio) if word else max_ratio) * n * (n > 1) - len(p)))
    out, i = [], 0
    while i < len(parts):
        total = best = -1.0
        last, k = i, i
        while k < len(parts) and (k == i or total > 0):
            total = parts[k][2] + (total if k > i else 0)
            if total >= best:
                best, last = total, k
            k += 1
        if best >= 0 and max(b - a for a, b, _ in parts[i : last + 1]) >= LONGEST:
            start, end = parts[i][0], parts[last][1]
            while end < len(s) and s[end] == "=":
                end += 1
            if 4 * (end - start) >= 3 * len(s):
                start, end = 0, len(s)
            if end - start >= least:
                out.append((start, end))
        i = last + 1
    return out


def weigh(s: str, enc, max_ratio: float) -> list[tuple[int, int]]:
    """The secret parts of a run of key characters: all of it, or stretches of a longer path. Dates, slugs and counters
    between separators have many tokens too, so that runs are always weighed by their parts."""
    if KNOWN.fullmatch(s):
        return []
    named = NUMBERED.fullmatch(s)
    if named and not dense(named[1], enc, max_ratio, 12):
        return []
    return dense(s, enc, max_ratio)


def token_spans(text: str, enc, max_ratio: float, taken: list[tuple[int, int, str]], seen: dict | None = None) -> list[tuple[int, int, str]]:
    """Candidates of at most max_ratio characters a token which no base span overlaps. seen keeps what runs were found to be."""
    out, base, seen = [], Covered((s, e) for s, e, _ in taken), {} if seen is None else seen
    for m in CANDIDATE.finditer(text):
        if base.meets(*m.span()) or LABELLED.search(text, max(0, m.start() - 10), m.start()):
            continue
        if m[0] not in seen:
            seen[m[0]] = weigh(m[0], enc, max_ratio)
        out += [(m.start() + s, m.start() + e, "token") for s, e in seen[m[0]]]
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.4, vocab: str | None = None) -> DataFrame:
    """One row per row of df: doc_id, base (list of spans of the three patterns), spans (all spans), redacted text.

    A candidate is a run of 16 or more key characters. It is a secret, or a part of it between / _ - + = is, if the
    vocabulary needs a token for every max_ratio characters or fewer (letters of one case: WORD_RATIO); UUIDs, labelled
    digests, dates and names with a number are excluded first. Prose reaches 4 characters a token, random keys 1.3 to 2.2.

    Null and empty texts have no spans. Whole texts are scanned, whatever their length. Repeated rows give repeated
    results, an empty table none; columns other than the two named are not looked at.
    """
    vocab = vocab or vocabulary()

    def rows(batch):
        enc = encoding(vocab)
        ids, base, spans, redacted, seen = batch.column(0), [], [], [], {}
        for text in batch.column(1).to_pylist():
            found = base_spans(text)
            extra = token_spans(text, enc, max_ratio, found, seen)
            base.append(span_list(found, KINDS))
            spans.append(span_list(found + extra, KINDS))
            redacted.append(redact(text, found + extra) if found or extra else text)
        return {"doc_id": ids, "base": base, "spans": spans, "redacted": redacted}

    return map_rows(id_text(df, id_col, text_col), rows, "doc_id long, base string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if e > at:
            out += [text[at : max(s, at)], mark if s >= at else ""]
            at = e
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", max_ratio: float = 2.4, vocab: str | None = None) -> DataFrame:
    """df with the secrets of one column replaced by a mark: all columns and rows stay, null texts too."""
    vocab = vocab or vocabulary()

    def run(batches):
        enc = encoding(vocab)
        for batch in (part for whole in batches if whole.num_rows for part in halves(whole, SLICE)):
            k = batch.schema.get_field_index(text_col)
            new, seen = [], {}
            for text in batch.column(k).to_pylist():
                if text:
                    found = base_spans(text)
                    text = redact(text, found + token_spans(text, enc, max_ratio, found, seen))
                new.append(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return df.mapInArrow(run, df.schema)
