"""Personal data in texts: base rules, and an offset-preserving deobfuscation that finds disguised identifiers.

A transducer rewrites a text into a normalised one (look-alike characters, spelled digits, at/dot disguises) and
keeps, for each character written, the span of source characters that it came from. The detectors run on the
normalised text, and their spans are mapped back. Every pass is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import batches, per_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


_DETECT = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """The base rules on the text as it is, by start and kind."""
    return ordered(s for kind in KINDS for s in _DETECT[kind](text))


#: Characters of other scripts that look like an ASCII one. Forms that Unicode itself folds need no entry.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ɡ": "g", "ⅼ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "٠": "0", " ": " ",
}
#: Characters that show nothing.
UNSEEN = frozenset("­​‌‍⁠﻿")
#: Digits by name, in the languages of the corpus. Only a run of names counts, so words like "one" stay.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
#: Last parts of a domain that make bare words like "at" and "dot" count as signs.
ENDINGS = frozenset(("com", "net", "org", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "eu"))
#: Spelled digits that must stand in a row to count.
RUN = 4

_NAME = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"\b(?:{_NAME})(?:[ ,-]{{1,2}}(?:{_NAME}|[0-9]|dot|point|punto|punkt)\b){{{RUN - 1},}}", re.IGNORECASE)
_PART = re.compile(r"\w+")
_DOTS = frozenset(("dot", "point", "punto", "punkt"))
_AT = r"(?: ?[(\[{<] ?at ?[)\]}>] ?| at |@)"
_DOT = r"(?: ?[(\[{<] ?dot ?[)\]}>] ?| dot |\.)"
_MAIL = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}({_AT})[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE)
_SIGN = re.compile(rf"{_AT}|{_DOT}", re.IGNORECASE)
_HINT = re.compile(r"[(\[{<] ?(?:at|dot) ?[)\]}>]| dot ", re.IGNORECASE)
_ODD = re.compile("[" + "".join(map(re.escape, [*LOOKALIKES, *UNSEEN])) + "＀-～٠-٩۰-۹०-९⁰-ₜ①-⒛\U0001d400-\U0001d7ff]")


class Tape:
    """A text and, for each of its characters, the span of source characters that it stands for."""

    def __init__(self, text: str, start: list[int] | range, end: list[int] | range):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each edit (from, to, with) replaces characters; what it writes stands for all that it replaces."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += self.start[at:a]
            end += self.end[at:a]
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        return Tape("".join(text), start, end)


def _folded(c: str) -> str:
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdigit():
        return str(unicodedata.digit(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


def normalise(text: str) -> Tape:
    """The three transducers in turn: look-alikes, spelled digits, at/dot disguises."""
    tape = Tape.of(text)
    if not text.isascii() and _ODD.search(text):
        tape = tape.rewritten([(m.start(), m.end(), _folded(m[0])) for m in _ODD.finditer(text)])
    edits = []
    for m in _RUN.finditer(tape.text):
        parts = [p[0].lower() for p in _PART.finditer(m[0])]
        edits.append((m.start(), m.end(), "".join("." if p in _DOTS else SPELLED.get(p, p) for p in parts)))
    tape = tape.rewritten(edits)
    edits = []
    if _HINT.search(tape.text):
        for m in _MAIL.finditer(tape.text):
            bare = m[1].strip().lower() == "at"
            tail = tape.text[m.end(1) : m.end()]
            if bare and (not re.search(r"[(\[{< ]dot[)\]}> ]", tail, re.IGNORECASE) or _PART.findall(tail)[-1].lower() not in ENDINGS):
                continue  # the word "at" before ordinary words
            for s in _SIGN.finditer(tape.text, m.start(), m.end()):
                sign = "@" if "at" in s[0].lower() or "@" in s[0] else "."
                if s[0] != sign:
                    edits.append((s.start(), s.end(), sign))
    return tape.rewritten(edits)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of disguised identifiers that overlap none of their kind."""
    base = base_spans(text)
    tape = normalise(text)
    if tape.text == text:
        return base, base
    spans = list(base)
    starts = {k: [a for kind, a, _ in base if kind == k] for k in KINDS}  # spans of a kind don't overlap
    ends = {k: [b for kind, _, b in base if kind == k] for k in KINDS}
    for kind, a, b in base_spans(tape.text):
        lo, hi = tape.start[a], tape.end[b - 1]
        after = bisect_right(ends[kind], lo)
        if after == len(starts[kind]) or starts[kind][after] >= hi:
            spans.append((kind, lo, hi))
    return base, ordered(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, is named."""
    out, at = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_disguised.

    Null and empty texts have no spans. Repeated rows are scanned each; other columns are ignored.
    """

    def make():
        def one(text: str) -> tuple:
            base, spans = find(text)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base))

        return one

    names = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "n_disguised": "long"}
    return per_text(docs, make, names, id_col, text_col)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its texts masked; null stays null, other columns stay as they are."""
    batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text_col, clean(docs[text_col].cast("string")))
