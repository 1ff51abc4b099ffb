"""BPE encoding by prefix-sharing trie traversal, and decoding.

A text's chunks between white space are encoded once each. The distinct words of a batch are visited in sorted order,
which is a depth-first walk of their trie: the stack holds, for every prefix of the word on the path, the last token of
that prefix's encoding and where it begins. A word costs work only for the characters beyond what it shares with its
predecessor. The state of a prefix is its last token: the encoding of p is that of p without the token's characters,
followed by the token, if the two tokens at the seam stay apart under the merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from barlake.llm.common import SLICE, id_text, map_rows

END = "</w>"
# Code points, in hexadecimal, that the regex module takes for letters or numbers and the tokenizer, whose
# Unicode version is another, for neither; and capitals that it lowers and Python does not, each with its small letter.
UNKNOWN = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee"
    " 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda"
    " 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff"
    " 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Marks that its normalization, older still, neither reorders nor composes.
LOOSE_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070"
    " 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f"
    " 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _members(spans: str) -> str:
    """The inside of a regular expression's class for spans of code points in hexadecimal."""
    return "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in spans.split())


_UNKNOWN = _members(UNKNOWN)
_LOOSE = re.compile(f"([{_members(LOOSE_MARKS)}])")
_LETTER, _NUMBER = rf"[\p{{L}}--[{_UNKNOWN}]]", rf"[\p{{N}}--[{_UNKNOWN}]]"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|[[^\s\p{{L}}\p{{N}}]||[{_UNKNOWN}]]+", regex.V1)
_PLAIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts and chunks without any of these need none of the tables; the second, of few ranges, is the quicker first look.
_STRANGE = re.compile("[" + _members(UNKNOWN) + _members(LOOSE_MARKS) + "".join(map(chr, CAPITALS)) + "]")
_PERHAPS = re.compile("[\u0558-\u1fff\u2080-\U0010ffff]")
_CHUNKS = regex.compile(r"[^\s]+")
#: Characters at which str.split divides and the tokenizer's white space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NEVER = 1 << 60
#: Longer texts are cut at spaces or line feeds after so many characters: no token reaches across white space.
BLOCK = 1 << 20
_CUT = re.compile("[ \n]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next free code from 256."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def strange(text: str) -> bool:
    return bool(_PERHAPS.search(text) and _STRANGE.search(text))


def compose(text: str) -> str:
    """NFC as the tokenizer has it: what stands between loose marks is composed by itself."""
    return "".join(unicodedata.normalize("NFC", part) for part in _LOOSE.split(text))


def blocks(text: str) -> list[str]:
    """The text in pieces of some BLOCK characters, each but the first beginning with a space or line feed."""
    out, at = [], 0
    while found := _CUT.search(text, at + BLOCK):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class WordBpe:
    """Word-end BPE of one tokenizer file: lower case, NFC, white space dropped, byte letters."""

    def __init__(self, path: str, cache_size: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x << 20 | y] = r
            self.parts.setdefault(z, (x, y, r))
        self.letters = byte_letters()
        self.apart: dict[int, bool] = {}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(END) and self._whole(i)}
        self.final = {t[: -len(END)]: i for t, i in self.vocab.items() if t.endswith(END) and self._whole(i)}
        self.longest = max(map(len, self.vocab))
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of token while its merges run, each with the rank of the merge that takes it."""
        out, until, parts = [(token, _NEVER)], _NEVER, self.parts
        while (made := parts.get(token)) is not None:
            token, until = made[side], made[2]
            out.append((token, until))
        return out

    def _clash(self, a: int, b: int, limit: int) -> bool:
        """Whether some merge of a rank under limit joins an edge of a with an edge of b before either is taken.

        Merges of one rank run from the left, so at equal ranks the seam loses to a's own merge and wins over b's.
        """
        rank, first = self.rank, self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in first:
                r = rank.get(x << 20 | y)
                if r is not None and r < limit and r < x_until and r <= y_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the merges turn the token's own letters into the token."""
        if token not in self.parts:
            return True
        x, y, r = self.parts[token]
        return self._whole(x) and self._whole(y) and not self._clash(x, y, r)

    def stays_apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self.apart[key] = not self._clash(a, b, _NEVER)
        return known

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of each word of byte letters, by one depth-first walk over the words' trie."""
        out: dict[str, list[int]] = {}
        last, back, before = [-1], [0], ""
        inner, final, longest, apart, seam = self.inner, self.final, self.longest, self.apart, self.stays_apart
        for word in sorted(words):
            n = len(word)
            shared = 0
            for shared in range(min(n - 1, len(before)) + 1):
                if shared == len(before) or shared == n - 1 or before[shared] != word[shared]:
                    break
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], back[shared + 1 :]
            for d in range(shared + 1, n):
                for j in range(max(0, d - longest), d):
                    t = inner.get(word[j:d])
                    if t is not None:
                        if j:
                            ok = apart.get(last[j] << 20 | t)
                            if not (seam(last[j], t) if ok is None else ok):
                                continue
                        last.append(t)
                        back.append(j)
                        break
                else:
                    raise ValueError(f"no token ends the prefix {word[:d]!r}")
            for j in range(max(0, n - longest), n):
                t = final.get(word[j:n])
                if t is not None and (j == 0 or seam(last[j], t)):
                    break
            else:
                raise ValueError(f"no token ends the word {word!r}")
            ids = [t]
            while j:
                ids.append(last[j])
                j = back[j]
            out[word] = ids[::-1]
            before = word[: n - 1]
        return out

    def chunks(self, text: str) -> list[str]:
        """The text's runs between white space, normalised."""
        if not text.isascii():
            if strange(text):
                return _CHUNKS.findall(compose(text).replace("Σ", "σ").translate(CAPITALS).lower())
            return _CHUNKS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return _CHUNKS.findall(text.lower()) if _SEPARATORS.search(text) else text.lower().split()

    def learn(self, new: set[str]) -> None:
        """Encode chunks that the cache lacks."""
        letters = self.letters
        plain = {c for c in new if c.isascii() and c.isalpha()}
        pieces = {c: ["".join([letters[b] for b in p.encode("utf-8", "surrogatepass")]) for p in (_PLAIN_PIECES if c.isascii() or not strange(c) else _PIECES).findall(c)] for c in new - plain}
        coded = self.encode_words(plain.union(*pieces.values()))
        for c in plain:
            self.cache[c] = array("I", coded[c]).tobytes()
        for c, ps in pieces.items():
            self.cache[c] = b"".join([array("I", coded[p]).tobytes() for p in ps])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the tokens joined by spaces."""
        parts = []
        for text in texts:
            if len(text) > BLOCK and len(pieces := blocks(text)) > 1:
                parts.append([b"".join([self.encode_batch([p])[0][0] for p in pieces])])
            elif self.split_special and "<|" in text:
                parts.append([p if k % 2 else self.chunks(p) for k, p in enumerate(self.split_special.split(text))])
            else:
                parts.append([self.chunks(text)])
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        self.learn({c for ps in parts for p in ps if isinstance(p, list) for c in p}.difference(self.cache))
        cache, out = self.cache, []
        for ps in parts:
            ids = ps[0] if isinstance(ps[0], bytes) else b"".join([array("I", [self.special[p]]).tobytes() if isinstance(p, str) else b"".join([cache[c] for c in p]) for p in ps])
            out.append((ids, self.decode(ids)))
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens of all ids, special ones included, joined by spaces: the tokenizer file has no decoder."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def tokenizer(path: str, cache_size: int = 300_000) -> WordBpe:
    """One per worker process, so its caches serve all tasks of the worker."""
    return WordBpe(path, cache_size)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, cache_size: int = 300_000, slice_bytes: int = SLICE) -> DataFrame:
    """One row per row of df: doc_id, ids (little-endian unsigned 32-bit integers), decoded (tokens joined by spaces).

    The strings of special tokens in a text become those tokens, as the tokenizer library has it. Null and empty
    texts, and texts of white space, have no ids and decode to the empty string. Texts of any length are encoded
    whole; repeated rows give repeated results, an empty table none; other columns are not looked at. A worker holds the
    codes of some cache_size words and the words of slice_bytes of text: fewer take more time, and change no result.
    """
    vocab = vocab or vocabulary()

    def rows(batch):
        done = tokenizer(vocab, cache_size).encode_batch(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "ids": [x[0] for x in done], "decoded": [x[1] for x in done]}

    return map_rows(id_text(df, id_col, text_col), rows, "doc_id long, ids binary, decoded string", slice_bytes)
