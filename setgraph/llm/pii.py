"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the text as it is. Texts with signs of disguise then pass through two transducers, one
for single characters (homoglyphs, full-width forms, digits of other scripts, invisible characters) and one for words
(spelled digits, at and dot). Each character they write carries the source span that it was written for, so what is
found in the normalised text is mapped back to source characters. Spans are code points, end exclusive.

Null texts count as empty; an empty text has no spans. Rows are handled one by one, so repeated rows, null doc_ids
and extra columns make no difference.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from a number's first digit fails from its others, so each number is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find_plain(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind that pass the kind's test, sorted."""
    found: list[Span] = []
    past = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            past = domain.end()
            found.append((start, 0, past))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like Latin ones, in the order of the Latin ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "−": "-", "﹣": "-",
}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile(f"[{''.join(_LOOKALIKES)}{_INVISIBLE} ٠-٩۰-۹०-९ - ‐-― ！-～\U0001d400-\U0001d7ff]")

# Spelled digits.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
# White space counts from its beginning, or runs of it would be tried from each of their characters.
# Last labels of domains that an unbracketed "at ... dot ..." has to end with.
_LAST = (
    "com org net edu gov mil int info biz io dev app ai co me tv cc xyz online site shop cloud tech eu us uk ca de at ch fr be nl lu es pt it ie dk se no fi is pl cz sk hu "
    "ro bg gr hr si rs ee lv lt ua ru tr il ae sa in cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma br mx ar cl pe ve uy example test invalid localhost"
).split()
_OPEN, _CLOSE = r"(?:(?<!\s)\s+)?[\[({<]\s*", r"\s*[\])}>]\s*"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\s+dot\s+)"
_WORDS = re.compile(
    rf"(?P<plus>\bplus\s+(?=(?:{_DIGIT}\b|[0-9])))"
    rf"|(?P<digit>\b{_DIGIT}(?![^\W_]))(?P<gap>[\s,-]{{1,2}}(?={_DIGIT}(?![^\W_])|[0-9]))?"
    rf"|(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9._%+-])\s+at\s+(?=(?:[A-Za-z0-9-]++(?:{_DOT}|\.))+(?:{'|'.join(_LAST)})(?![A-Za-z0-9-])))"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)


# Read in lower case. A spelled digit is part of a number only beside another digit; a dot may be spelled, an at without
# brackets needs a known last label after it, whose dots may be plain.
_NUMERAL, _BETWEEN = rf"(?:[0-9]|{_DIGIT})", r"[\s,().+-]*"
_SIGNS = [
    re.compile(p)
    for p in (rf"at\s+(?:[a-z0-9-]++(?:{_DOT}|\.))+(?:{'|'.join(_LAST)})(?![a-z0-9-])", r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]", r"(?<=\s)dot\s", rf"plus\s+{_NUMERAL}", rf"{_DIGIT}{_BETWEEN}{_NUMERAL}", rf"[0-9]{_BETWEEN}{_DIGIT}")
]
_ANY_SPELLED = re.compile(_DIGIT)


def disguised(text: str) -> bool:
    """Whether the text has signs that a transducer would act on so that an identifier could come of it."""
    if not text.isascii() and (_ODD.search(text) or "\u017f" in text or "\u0130" in text):
        return True
    low = text.lower()
    return any(p.search(low) for p in _SIGNS) or ("@" in low and bool(_ANY_SPELLED.search(low)))


class Normalised:
    """A text as transducers wrote it; starts[i] and ends[i] are the source span of its character i."""

    def __init__(self, source: str):
        self.text, self.starts, self.ends = source, range(len(source)), range(1, len(source) + 1)

    def _rewritten(self, parts: list[tuple[str, int, int]]) -> None:
        """parts: (output, from, to) by position; an output as long as its input is written character by character."""
        out, starts, ends = [], [], []
        for new, a, b in parts:
            out.append(new)
            if len(new) == b - a:
                starts.extend(self.starts[a:b])
                ends.extend(self.ends[a:b])
            elif new:
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def characters(self) -> Normalised:
        """Each odd character becomes the ASCII one it stands for, or nothing if it is invisible."""
        parts, done = [], 0
        for m in _ODD.finditer(self.text):
            c, at = m[0], m.start()
            new = _LOOKALIKES.get(c) or ("" if c in _INVISIBLE else "-" if "‐" <= c <= "―" else unicodedata.normalize("NFKC", c))
            if new.isdigit():
                new = "".join(str(unicodedata.digit(x)) for x in new)
            parts += [(self.text[done:at], done, at), (new[:1] if len(new) > 1 else new, at, at + 1)]
            done = at + 1
        self._rewritten([*parts, (self.text[done:], done, len(self.text))])
        return self

    def words(self) -> Normalised:
        """Spelled digits become digits, joined where they follow one another; at, dot and plus become signs."""
        parts, done = [], 0
        for m in _WORDS.finditer(self.text):
            a, b = m.span()
            parts.append((self.text[done:a], done, a))
            if m["digit"]:
                parts.append((_SPELLED[m["digit"].casefold().replace("\u0307", "")], a, b - len(m["gap"] or "")))
            else:
                strip = a + len(m[0]) - len(m[0].lstrip()), b - len(m[0]) + len(m[0].rstrip())
                parts.append(("+" if m["plus"] else "@" if m["at"] else ".", *strip))
            done = b
        self._rewritten([*parts, (self.text[done:], done, len(self.text))])
        return self


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and all spans: the plain ones and those that only the normalised text shows.

    A span of the normalised text that lies within a plain one of its kind adds nothing; one that goes on beyond it does.
    """
    plain = find_plain(text)
    if not disguised(text):
        return plain, plain
    seen = Normalised(text).characters().words()
    added = []
    by_kind = [[(s, e) for s, k, e in plain if k == kind] for kind in range(len(KINDS))]  # of one kind they don't overlap
    for start, kind, end in find_plain(seen.text):
        a, b = seen.starts[start], seen.ends[end - 1]
        at = bisect.bisect_right(by_kind[kind], (a, len(text))) - 1
        if at < 0 or by_kind[kind][at][1] < b:
            added.append((a, kind, b))
    return plain, sorted([*plain, *set(added)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField("n_disguised", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find_pii(docs: DataFrame) -> DataFrame:
    """For each row of docs: counts of plain spans by kind, of disguised ones and of all, the digest of the plain ones, all spans."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [find_all(t) for t in batch["text"]]
            out = {"doc_id": batch["doc_id"]}
            out |= {f"n_{kind}": [sum(s[1] == k for s in plain) for plain, _ in rows] for k, kind in enumerate(KINDS)}
            out |= {"n_disguised": [len(every) - len(plain) for plain, every in rows], "n_spans": [len(every) for _, every in rows]}
            out |= {"base_sha256": [hashlib.sha256(joined(plain).encode()).hexdigest() for plain, _ in rows], "spans": [joined(every) for _, every in rows]}
            yield pd.DataFrame(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(find, FOUND)


def op2_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find_pii(table(spark, sf_dir, "documents"))
