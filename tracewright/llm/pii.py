"""Personal data: base patterns on the source, and offset-preserving deobfuscation for disguised identifiers."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# What a disguise may write for a digit, in English, French, German and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Spoken signs in the same languages, and words after a spoken "at" that begin no domain.
_PLUS, _AT, _DOT, _DASH = "plus|más|mas", "at|arobase|klammeraffe|arroba", "dot|point|punkt|punto", "dash|tiret|strich|guion|guión"
_NO_DOMAIN = "the|a|an|this|that|these|those|my|your|his|her|its|our|their|some|any|each|every|all|one|what|which|least|most|last|first|once"
# Letters of other scripts that look like ASCII ones (compatibility forms come from Unicode itself).
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "ı": "i", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "。": ".", "․": ".", "·": ".",
}
_INVISIBLE = frozenset("​‌‍⁠﻿­")
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_LETTER = "A-Za-z\u00c0-\u00ff"
_ITEM = rf"(?:{_WORD}|[0-9]|{_PLUS}|{_DOT}|{_DASH}|double|triple)"
_RUN = rf"(?<![{_LETTER}])(?:{_WORD}|{_PLUS}|double|triple)(?:[\x20,._-]{{1,2}}{_ITEM}){{3,}}(?![{_LETTER}])"
_SPELLED_RUN, _SPELLED_LOW = re.compile(_RUN, re.I), re.compile(_RUN)
_SPELLED_WORD = re.compile(rf"(double|triple)[\x20,._-]{{1,2}}({_WORD}|[0-9])|({_WORD})|({_PLUS})|({_DOT})|({_DASH})", re.I)
_GAP = re.compile(r"(?<=[0-9+.\-])[\x20,_]{1,2}(?=[0-9+.\-])")
_AT_MARK = re.compile(r"[\x20]?(?:\[[\x20]?(?:at|@)[\x20]?\]|\([\x20]?(?:at|@)[\x20]?\)|\{[\x20]?(?:at|@)[\x20]?\}|<[\x20]?at[\x20]?>)[\x20]?", re.I)
_DOT_MARK = re.compile(r"[\x20]?(?:\[[\x20]?(?:dot|\.)[\x20]?\]|\([\x20]?(?:dot|\.)[\x20]?\)|\{[\x20]?(?:dot|\.)[\x20]?\}|<[\x20]?dot[\x20]?>)[\x20]?", re.I)
# Top-level domains that a spoken address may end with.
_SPOKEN_ENDS = "com|org|net|edu|gov|info|biz|io|ai|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|jp|cn|in|br|mx|ar|ru|pl|se|no|dev|app|me|tv"
_DOTS = rf"(?:\.|\x20(?:{_DOT})\x20)"
_SPOKEN_AT = re.compile(rf"@|\x20(?:{_AT})\x20(?!(?:{_NO_DOMAIN})\x20)", re.I)
_SPOKEN_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOTS}[A-Za-z0-9-]++)++", re.I)
_HOST_END = re.compile(rf"{_DOTS}(?:{_SPOKEN_ENDS})(?![A-Za-z0-9-])", re.I)
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOTS}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_SPOKEN_DOT = re.compile(rf"\x20(?:{_DOT})\x20", re.I)
_DOT_BEFORE = re.compile(rf"\x20(?:{_DOT})\x20\Z", re.I)
_HINT = re.compile(rf"[\[({{<]\x20?(?:at|@|dot|\.)\x20?[\])}}>]|\x20(?:{_DOT})\x20", re.I)
_ODD = re.compile("[^\x00-\xff]|[\xa0\xaa\xad\xb2\xb3\xb7\xb9\xba]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find_base(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped, by kind and start.

    Each scan is anchored (at an @, a run of digits, a plus), so long runs cost linear time.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Transduced:
    """A text being rewritten, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.spans = text, None

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.spans is None:
            return start, end
        return self.spans[start][0], self.spans[end - 1][1]

    def changed(self, start: int, end: int) -> bool:
        """Whether a character here is no plain copy."""
        return self.spans is not None and any(self.spans[i][2] for i in range(start, end))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, for edits in order; the rest is copied."""
        if not edits:
            return
        spans = self.spans or [(i, i + 1, False) for i in range(len(self.text))]
        out: list[str] = []
        to: list[tuple[int, int, bool]] = []
        last = 0
        for start, end, new in edits:
            out += [self.text[last:start], new]
            to += spans[last:start]
            if new:
                to += [(spans[start][0], spans[end - 1][1], True)] * len(new)
            last = end
        out.append(self.text[last:])
        self.text, self.spans = "".join(out), to + spans[last:]


@lru_cache(maxsize=65536)
def _plain(c: str) -> str | None:
    """What a character stands for, if it is a look-alike; '' if it is invisible."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and " " <= wide <= "~" else None


def _homoglyphs(t: Transduced) -> None:
    t.rewrite([(m.start(), m.end(), p) for m in _ODD.finditer(t.text) if (p := _plain(m[0])) is not None])


def _has_spelled(text: str) -> bool:
    """Whether a run of spelled digits may lie here; searching lowered text takes a third of the time."""
    return bool(_SPELLED_LOW.search(text.lower()))


def _spelled(t: Transduced) -> None:
    if not _has_spelled(t.text):
        return
    edits = []
    for run in _SPELLED_RUN.finditer(t.text):
        for m in _SPELLED_WORD.finditer(t.text, run.start(), run.end()):
            if m[1]:
                d = _SPELLED.get(m[2].lower(), m[2])
                new = d * (2 if m[1].lower() == "double" else 3)
            else:
                new = _SPELLED[m[3].lower()] if m[3] else "+" if m[4] else "." if m[5] else "-"
            edits.append((m.start(), m.end(), new))
    if not edits:
        return
    t.rewrite(edits)
    # gaps between spelled digits go; gaps beside digits of the source stay
    t.rewrite([(m.start(), m.end(), "") for m in _GAP.finditer(t.text) if t.spans[m.start() - 1][2] and t.spans[m.end()][2]])


def _local_dots(text: str, at: int, free: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Start of the local part that ends at a place, not before `free`, and its spoken dots."""
    start, dots = at, []
    while True:
        s = start
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        if s == start:  # nothing stands before the last spoken dot
            return (dots.pop()[1], dots) if dots else (start, dots)
        start = s
        m = _DOT_BEFORE.search(text, max(free, s - 7), s)
        if not m:
            return start, dots
        dots.append((m.start(), s, "."))
        start = m.start()


def _spoken(t: Transduced) -> list[tuple[int, int, str]]:
    """Spoken signs of addresses and of dotted numbers, each read by itself.

    A spoken "at" counts only before a disguised dot, as plain names of hosts follow it in prose.
    Scans start at signs and never go back over a match, so that long texts cost linear time.
    """
    edits, free = [], 0
    for sign in _SPOKEN_AT.finditer(t.text):
        if sign.start() < free or not (host := _SPOKEN_HOST.match(t.text, sign.end())):
            continue
        ends = [m.end() for m in _HOST_END.finditer(t.text, host.start(), host.end())]
        after = [(m.start(), m.end(), ".") for m in _SPOKEN_DOT.finditer(t.text, host.start(), ends[-1])] if ends else []
        spoken = sign[0] != "@"
        if ends and (not spoken or after or any(t.text[i] == "." and t.changed(i, i + 1) for i in range(host.start(), ends[-1]))):
            start, before = _local_dots(t.text, sign.start(), free)
            if start < sign.start():
                edits += before + ([(sign.start(), sign.end(), "@")] if spoken else []) + after
        free = host.end()
    for run in _SPOKEN_IP.finditer(t.text):
        edits += [(m.start(), m.end(), ".") for m in _SPOKEN_DOT.finditer(t.text, run.start(), run.end())]
    edits.sort()
    return [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]]


def _at_dot(t: Transduced) -> None:
    t.rewrite([(m.start(), m.end(), "@") for m in _AT_MARK.finditer(t.text)])
    t.rewrite([(m.start(), m.end(), ".") for m in _DOT_MARK.finditer(t.text)])
    if t.spans is not None or _SPOKEN_DOT.search(t.text):
        t.rewrite(_spoken(t))


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that appear only after normalisation, as spans of the source.

    A span counts if a rewritten character lies in it and it overlaps no base span and no
    other span of its kind.
    """
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not _HINT.search(text) and not _has_spelled(text):
        return []
    t = Transduced(text)
    if odd:
        _homoglyphs(t)
    _at_dot(t)
    _spelled(t)
    if t.spans is None:
        return []
    out: list[Span] = []
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\x01" * (e - s)
    for kind, s, e in find_base(t.text):
        start, end = t.source(s, e)
        if t.changed(s, e) and taken.find(1, start, end) < 0:
            out.append((kind, start, end))
            taken[start:end] = b"\x01" * (end - start)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by kind as in KINDS, then start."""
    base = find_base(text)
    more = find_disguised(text, base)
    both = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1])) if more else base
    return base, both


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every text: id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans, n_added.

    Offsets count code points, ends are exclusive. A null text is empty: zeros, the digest of
    an empty string, no spans. Null and repeated ids keep their rows. One narrow pass.
    """

    def of(texts: list[str]) -> dict[str, list]:
        found = [find(t) for t in texts]
        out = {f"n_{k}": [sum(k == x[0] for x in base) for base, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
        return out | {"spans": [_joined(both) for _, both in found], "n_added": [len(both) - len(base) for base, both in found]}

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    added = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return map_texts(rows, lambda: of, added).withColumnRenamed("id", id_col)


def mask_text(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with each span replaced by its kind; null stays null."""
    if not text:
        return text
    spans = sorted((s, e, k) for k, s, e in find(text)[1])
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], mark.format(k.upper())]
            last = e
        elif e > last:  # an overlap of two kinds hides both
            last = e
    return "".join(out) + text[last:] if spans else text


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data in text_col masked."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask_text, na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))
