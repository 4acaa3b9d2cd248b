"""Personal data, found in whole texts and behind disguises.

The base rules read the text as it is. Transducers then rewrite what disguises an identifier (homoglyphs, spelled
digits, at and dot in words or brackets, entities, invisible characters) and keep for each piece of the rewritten text
where it comes from; the same rules read the rewritten text, and what they find through a rewritten piece is mapped
back to characters of the source. Each rule takes time in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPANS, appended, of_kind, spans_digest, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]


RULES = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Words for digits in the four languages, look-alike letters of Greek and Cyrillic, words before "at" and after it
# that make no address, ends of file names.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
LOOKALIKES = dict(zip("АВЕКМНОРСТХУаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "ABEKMHOPCTXYaeopcyxijsdqwABEZHIKMNOPTYXovi", strict=True))
NO_LOCAL = "is|are|was|were|be|been|us|me|it|them|him|her|you|here|there|look|looks|looked|looking|see|read|available|found|find|online|hosted|located|visit|more|page|site|website|documentation|docs|live|up|out|and|or|not|arrive|arrived|stay|stayed"
NO_DOMAIN = "the|a|an|this|that|these|those|each|every|any|my|your|his|her|its|our|their"
FILES = "py|js|ts|txt|md|csv|json|ya?ml|xml|html?|php|pdf|png|jpe?g|gif|exe|sh|java|cpp|log|sql|docx?|xlsx?|zip|gz"
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—―−"


@cache
def homoglyphs() -> dict[str, str]:
    """Characters beyond ASCII that stand for one ASCII character that identifiers have: by compatibility, by digit value, by looks."""
    keep = LOCAL | set("@() ")
    out = {}
    for code in (*range(0xA0, 0x3000), *range(0xFE50, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1FF)):
        ch = chr(code)
        if (ascii_ := unicodedata.normalize("NFKC", ch)) in keep or (ascii_ := str(unicodedata.digit(ch, ""))) in keep:
            out[ch] = ascii_
    return out | LOOKALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(DASHES, "-")


@cache
def glyph_pattern() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(homoglyphs()))) + "]")


WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]{{1,3}})?(?:(?:double|triple)\s{{1,3}})?(?:{WORD})(?!\w)(?:[\s,.()-]{{1,3}}(?:(?:dot|point|double|triple)\s{{1,3}})?(?:(?:{WORD})(?!\w)|[0-9]+(?!\w))){{2,}}")
DIGIT_PART = re.compile(rf"(?i)plus[\s-]{{1,3}}|(double|triple)\s+({WORD}|[0-9])|(?<!\w)(?:{WORD})(?!\w)|\s*\b(?:dot|point)\s+|[\s,()-]+")
BRACKETED = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:(at|@)|dot|\.)\s{0,3}[\])}>]\s{0,3}")
ENTITY = re.compile(r"(?i)&(?:(#0{0,4}64|#x0{0,4}40|commat)|#0{0,4}46|#x0{0,4}2e|period);")
# a spoken dot takes any end of two letters or more; where all dots are plain, words that often stand before a site or a file's name give no address
SPOKEN = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{1,64}\s{1,3}dot\s{1,3}){0,4}(?P<last>[A-Za-z0-9._%+-]{1,64})\s{1,3}at\s{1,3}"
    rf"(?:(?!(?:{NO_DOMAIN})\s)(?:[A-Za-z0-9-]{{1,63}}(?:\s{{1,3}}dot\s{{1,3}}|\.)){{0,4}}[A-Za-z0-9-]{{1,63}}\s{{1,3}}dot\s{{1,3}}[A-Za-z]{{2,63}}|(?P<plain>(?:[A-Za-z0-9-]{{1,63}}\.){{1,5}}(?!(?:{FILES})(?![A-Za-z0-9]))(?-i:[a-z]{{2,63}}|[A-Z]{{2,63}})))(?![A-Za-z0-9])"
)
NOT_LOCAL = frozenset(NO_LOCAL.split("|"))
SPOKEN_AT = re.compile(r"(?i)\sat\s")
WORDS = re.compile(r"\w+")
SPOKEN_PART = re.compile(r"(?i)\s+(at|dot)\s+")

Edit = tuple[int, int, str]


def digit_edits(text: str) -> list[Edit]:
    out = []
    for run in DIGIT_RUN.finditer(text):
        for m in DIGIT_PART.finditer(text, run.start(), run.end()):
            word = m[0].lower().strip(" \t\n-")
            if m[1]:
                value = DIGIT_WORDS.get(m[2].lower(), m[2]) * (2 if m[1].lower() == "double" else 3)
            else:
                value = "+" if word == "plus" else "." if word in ("dot", "point") else DIGIT_WORDS.get(word, "")
            out.append((m.start(), m.end(), value))
    return out


def edits(text: str) -> list[Edit]:
    """What the transducers rewrite, in order and without overlap; where two would, the earlier one does."""
    found: list[Edit] = []
    low = text.lower()
    if not text.isascii() and not (table_ := homoglyphs()).keys().isdisjoint(text):
        found += [(m.start(), m.end(), table_[m[0]]) for m in glyph_pattern().finditer(text)]
    if any(c in text for c in "[({<"):
        found += [(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(text)]
    if "&" in text:
        found += [(m.start(), m.end(), "@" if m[1] else ".") for m in ENTITY.finditer(text)]
    if SPOKEN_AT.search(text):
        for m in SPOKEN.finditer(text):
            if m["plain"] and m["last"].lower() in NOT_LOCAL:
                continue
            found += [(p.start(), p.end(), "@" if p[1].lower() == "at" else ".") for p in SPOKEN_PART.finditer(text, m.start(), m.end())]
    if not DIGIT_WORDS.keys().isdisjoint(WORDS.findall(low)):
        found += digit_edits(text)
    out, end = [], 0
    for e in sorted(found):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


class Rewritten:
    """A rewritten text and the way back: pieces by their start in it, with their place in the source."""

    def __init__(self, text: str, changes: list[Edit]):
        parts, self.at, self.source, at, last = [], [], [], 0, 0
        for start, end, value in [*changes, (len(text), len(text), "")]:
            for piece, a, b, new in ((text[last:start], last, start, False), (value, start, end, True)):
                if piece:
                    parts.append(piece)
                    self.at.append(at)
                    self.source.append((a, b, new))
                    at += len(piece)
            last = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span in the source, and whether a rewritten piece is in it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, first), (c, d, last) = self.source[i], self.source[j]
        out = (a if first else a + start - self.at[i], d if last else c + end - self.at[j])
        # a deletion leaves no piece: it shows as a longer source
        return *out, any(x[2] for x in self.source[i : j + 1]) or out[1] - out[0] != end - start


def scan(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, value), by kind as in KINDS, then start; null is empty."""
    if not text:
        return []
    base = {k: rule(text) for k, rule in RULES.items()}
    found = [(k, s, e, True, text[s:e]) for k in KINDS for s, e in base[k]]
    if changes := edits(text):
        new = Rewritten(text, changes)
        for k in KINDS:
            for a, b in RULES[k](new.text):
                s, e, disguised = new.back(a, b)
                beside = [x for x in base[k] if x[0] < e and s < x[1]]
                if disguised and (not beside or k == "email" and all(s <= x[0] and x[1] <= e for x in beside) and (s, e) not in beside):
                    found.append((k, s, e, False, new.text[a:b]))
        found.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return found


def find_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `spans`: kind, start and end (code points, end exclusive), base, and the identifier as rewritten.

    Null and empty texts have no spans; rows repeat as in docs; other columns stay, a column named spans is replaced.
    """

    def work(texts):
        return [[[dict(zip(("kind", "start", "end", "base", "value"), x, strict=True)) for x in scan(t)] for t in texts]]

    return appended(docs, f"spans {SPANS}", work, column)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.sha2(spans_digest(F.filter(spans, lambda s: s["base"])), 256)
    return found.select("doc_id", *[of_kind(spans, k).alias(f"n_{k}") for k in KINDS], base.alias("base_sha256"), spans_digest(spans).alias("spans"))
