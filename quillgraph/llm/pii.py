"""Personal data, also in disguise, with spans of the source text.

Plain identifiers are matched in the text as it is (the *base* spans).  Texts
that show signs of disguise also pass a chain of transducers, each a rewriting
that keeps, for every character it emits, the source characters it stands for:

1. homoglyphs: look-alike letters, full-width and other compatibility forms
   and digits of other scripts become ASCII; zero-width characters vanish;
2. spelled digits: runs of digit words become digits, ``plus`` before them a
   plus sign;
3. ``at`` and ``dot``, in brackets, or bare where both are there, become signs.

The same detectors then run over the result, and a span found there maps back
to the source from its first character's origin to its last one's.  Added spans
never replace or overlap base spans of their kind.

Signs of disguise are looked for in the bytes of all texts at once, so only the
few texts that have them are rewritten.  A null text counts as empty.  The time is
linear in the length of a text, whatever it holds.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .features import PUNCTUATION
from .kernels import Chunk, Tokens, chunks
from .shared import Workspace, ids_back, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match from within a run of digits would also start at the run's first: trying that alone keeps the search linear
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")

# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", " ": " ", " ": " ", " ": " ",
}
_NOTHING = set("​‌‍⁠﻿­")

# Digit words in English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punto", "punkt", "point")
# Ends of the domains that bare at and dot words may spell.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "ai", "co", "uk", "us", "eu", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ca", "au", "br", "mx", "in", "jp", "cn")
#: So many digit words or single digits in a row are a disguised number.
LEAST_RUN = 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = re.sub(r"[^0-9]", "", found)
    return 10 <= len(digits) <= 15 if kind == "phone" else 14 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, tried only around the signs."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _PATTERNS["email"].match(text, start) if start < sign else None
        if m:
            yield m.span()
            done = m.end()
        sign = text.find("@", max(sign + 1, done))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind."""
    out = [("email", s, e) for s, e in emails(text)]
    for kind in ("ip", "card", "phone"):
        out += [(kind, *m.span()) for m in _PATTERNS[kind].finditer(text) if _holds(kind, m[0])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


class Traced:
    """A text with the source span of every character."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str) -> Traced:
        start = np.arange(len(text), dtype=np.int64)
        return cls(text, start, start + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Put texts in place of stretches (ascending, disjoint); every emitted character stands for the whole stretch."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            start += [self.start[at:s], np.full(len(new), self.start[s])]
            end += [self.end[at:s], np.full(len(new), self.end[e - 1])]
            at = e
        text.append(self.text[at:])
        return Traced("".join(text), np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]]))

    def source(self, s: int, e: int) -> tuple[int, int]:
        return int(self.start[s:e].min()), int(self.end[s:e].max())


def _plain(c: str) -> str:
    if c in _NOTHING:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() else c


def homoglyphs(t: Traced) -> Traced:
    return t.rewrite([(m.start(), m.end(), new) for m in re.finditer(r"[^\x00-\x7f]", t.text) if (new := _plain(m[0])) != m[0]])


_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_RUN = re.compile(rf"(?<![^\W_])(?:(plus|más|mas)[\s-]+)?(?:{_WORDS}|[0-9])(?:[\s,.·/-]+(?:{_WORDS}|[0-9])(?![^\W_])){{{LEAST_RUN - 1},}}", re.IGNORECASE)
_UNIT = re.compile(rf"{_WORDS}|[0-9]", re.IGNORECASE)


def spelled_digits(t: Traced) -> Traced:
    edits = []
    for m in _RUN.finditer(t.text):
        body = m.start() if not m[1] else m.end(1)
        units = list(_UNIT.finditer(t.text, body, m.end()))
        if sum(not u[0].isdigit() for u in units) < LEAST_RUN - 1:
            continue
        if m[1]:
            edits.append((m.start(), units[0].start(), "+"))
        for u, after in zip(units, [*units[1:], None]):
            # the separator goes with the digit before it, so that digits stand side by side
            edits.append((u.start(), u.end(), DIGIT_WORDS.get(u[0].lower(), u[0])))
            if after is not None and after.start() > u.end():
                edits.append((u.end(), after.start(), ""))
    return t.rewrite(edits)


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT_BOXED = re.compile(rf"{_OPEN}\s*(?:{_AT}|@)\s*{_CLOSE}\s*", re.IGNORECASE)
_DOT_BOXED = re.compile(rf"{_OPEN}\s*(?:{_DOT}|\.)\s*{_CLOSE}\s*", re.IGNORECASE)
# No quantifier below gives back what it has taken, and no search starts within what another has read: all are linear.
_SEP = rf"(?:\.|\s++(?:{_DOT})\s++)"
_AT_BARE = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s++(?:{_AT})\s++(?=([A-Za-z0-9-]++(?:{_SEP}[A-Za-z0-9-]++)++))", re.IGNORECASE)
_SEPARATOR = re.compile(_SEP, re.IGNORECASE)
_DOT_AFTER = re.compile(rf"(?<=[A-Za-z0-9-])\s++(?:{_DOT})\s++(?=[A-Za-z0-9-])", re.IGNORECASE)
_DOMAIN = re.compile(rf"@[A-Za-z0-9-]++(?:{_SEP}[A-Za-z0-9-]++)++", re.IGNORECASE)
_NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s++(?:{_DOT})\s++[A-Za-z0-9._%+-]++)*+", re.IGNORECASE)
_QUAD = re.compile(rf"[0-9]{{1,3}}(?:\s++(?:{_DOT})\s++[0-9]{{1,3}}){{3}}", re.IGNORECASE)


def _boxed(pattern: re.Pattern, text: str, sign: str) -> list[tuple[int, int, str]]:
    """Edits of the bracketed words, with the blanks around them."""
    out, done = [], 0
    for m in pattern.finditer(text):
        start = m.start()
        while start > done and text[start - 1].isspace():
            start -= 1
        done = m.end()
        out.append((start, done, sign))
    return out


def _spells_domain(labels: str) -> bool:
    """Whether a domain's end follows some spelled dot."""
    spelled, at = False, 0
    for m in [*_SEPARATOR.finditer(labels), None]:
        if spelled and labels[at : m.start() if m else None].lower() in DOMAIN_ENDS:
            return True
        if m:
            spelled, at = spelled or m[0] != ".", m.end()
    return False


def signs(t: Traced) -> Traced:
    t = t.rewrite(_boxed(_AT_BOXED, t.text, "@"))
    t = t.rewrite(_boxed(_DOT_BOXED, t.text, "."))
    t = t.rewrite([(*m.span(), "@") for m in _AT_BARE.finditer(t.text) if _spells_domain(m[1])])
    for whole in (_DOMAIN, _NAME, _QUAD):
        found = [m.span() for m in whole.finditer(t.text) if whole is not _NAME or t.text[m.end() : m.end() + 1] == "@"]
        t = t.rewrite([(*d.span(), ".") for span in found for d in _DOT_AFTER.finditer(t.text, *span)])
    return t


class Taken:
    """Disjoint spans of one kind, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)

    def add(self, a: int, b: int) -> bool:
        """Take the span unless it overlaps another."""
        k = bisect.bisect_left(self.spans, (a, b))
        if (k and self.spans[k - 1][1] > a) or (k < len(self.spans) and self.spans[k][0] < b):
            return False
        self.spans.insert(k, (a, b))
        return True


def added(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows."""
    plain = homoglyphs(Traced.of(text))
    out: list[tuple[str, int, int]] = []
    taken = {kind: Taken([(s, e) for k, s, e in base if k == kind]) for kind in KINDS}
    # signs first and digits first: a disguised address may hold digit words, a number dot words
    for chain in ((spelled_digits, signs), (signs,)):
        t = plain
        for step in chain:
            t = step(t)
        if t.text == text:
            continue
        for kind, s, e in detect(t.text):
            a, b = t.source(s, e)
            if taken[kind].add(a, b):
                out.append((kind, a, b))
    return out


def _hashes(words) -> np.ndarray:
    joined = "\n".join(words)
    return np.unique(Tokens(Chunk([pa.RecordBatch.from_arrays([pa.array([joined])], ["text"])]), lower=True, space=PUNCTUATION).hash)


def _any(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] > total[off[:-1]]


#: Two-byte letters under U+0180 that :func:`homoglyphs` rewrites; of the other non-ASCII characters all count as odd.
_MAPPED = np.array([int.from_bytes(chr(c).encode()) for c in range(0xC0, 0x180) if _plain(chr(c)) != chr(c)])
#: Letters of digit words whose capitals the tokens keep.
_CAPITALS = str.maketrans({c: c.upper() for w in DIGIT_WORDS for c in w if not c.isascii()})
#: The bracketed rules of :func:`signs` over bytes; blanks beyond ASCII are odd.
_BLANK = rb"[\s\x1c-\x1f]*"
_BOXED = re.compile(_OPEN.encode() + _BLANK + rf"(?:{_AT}|@|{_DOT}|\.)".encode() + _BLANK + _CLOSE.encode(), re.IGNORECASE)


def suspects(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each document: whether it can have base spans, and whether it shows signs of disguise."""
    data, off = chunk.data, chunk.offsets
    plain = _any((data == 64) | ((data >= 48) & (data <= 57)), off)
    odd = _any((data >= 0xC6) | (data == 0xC2), off)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    mapped = np.zeros(len(data), bool)
    mapped[lead] = np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _MAPPED)
    odd |= _any(mapped, off)
    tokens = Tokens(chunk, lower=True, space=PUNCTUATION)
    if not len(tokens):
        return plain, odd
    one = (tokens.end - tokens.start == 1) & (data[tokens.start] >= 48) & (data[tokens.start] <= 57)
    digit = np.isin(tokens.hash, _hashes({*DIGIT_WORDS, *(w.translate(_CAPITALS) for w in DIGIT_WORDS)})) | one
    run = digit.astype(np.int32)
    for size in range(1, LEAST_RUN):
        run[:-size] += digit[size:] if size < len(digit) else 0
    dot = np.isin(tokens.hash, _hashes(DOT_WORDS))
    boxed = np.zeros(len(data), bool)
    boxed[[m.start() for m in _BOXED.finditer(data.tobytes())]] = True
    disguised = odd | _any(run == LEAST_RUN, tokens.first) | _any(dot, tokens.first) | _any(boxed, off)
    return plain, disguised


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added; one row per row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for chunk in chunks(batches):
            plain, disguised = suspects(chunk)
            counts = {k: np.zeros(chunk.n, np.int64) for k in KINDS}
            more = np.zeros(chunk.n, np.int64)
            sums, lines = [nothing] * chunk.n, [""] * chunk.n
            for i in np.flatnonzero(plain | disguised):
                text = chunk.text(i).decode()
                base = detect(text) if plain[i] else []
                for k, _, _ in base:
                    counts[k][i] += 1
                new = added(text, base) if disguised[i] else []
                more[i] = len(new)
                if base:
                    sums[i] = hashlib.sha256(_line(base).encode()).hexdigest()
                lines[i] = _line(sorted(base + new, key=lambda x: (x[1], KINDS.index(x[0]))))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.column("doc_id")), *[pa.array(counts[k]) for k in KINDS], pa.array(sums), pa.array(lines), pa.array(more)], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    with small_batches(spark):
        work = Workspace(spark, "pii")
        out = texts(docs, id_col, text_col).mapInArrow(step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
        return work.table(ids_back(out), "result")
