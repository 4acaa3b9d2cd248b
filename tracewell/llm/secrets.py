"""Secrets in whole texts: token patterns, and values in a credential's context that are costly to guess.

The base rules find assignments, access keys and long hexadecimal runs. Further values that stand where a credential
is given are priced by guesses: a dynamic program finds the cheapest segmentation into common words, dates, repeats,
keyboard walks and brute-force spans, and values above a price are secrets. Words are a short list of common passwords and then, by rank, the whole words of a
public tokenizer's vocabulary.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPANS, UPPER, appended, of_kind, spans_digest, table

KINDS = ("assign", "access", "hex", "password")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A credential's name is a run of identifier characters with one of these in it; short words that many others have in them stand for themselves or are a part of the name.
NAMED = r"(?ai:passw(?:or)?d|passphrase|passcode|pwd|secret(?!ar)|token|(?:api|access|private)[_-]?key|credential)"
PART = r"(?:(?<![A-Za-z])(?:(?ai:pass|auth|login|pin)(?![A-Za-z])|(?:[Pp]ass|[Aa]uth|[Ll]ogin|[Pp]in)(?=[A-Z]))|(?<=[a-z])(?:Pass|Auth|Login|Pin)(?![a-z])|(?ai:(?<!com|sur)(?<!by)(?<!tres|over)(?<!under)pass(?![a-z])))"
NAME = r"[A-Za-z0-9_.-]"
CONTEXT = re.compile(
    rf"""(?<!{NAME})(?:(?={NAME}*?(?:{NAMED}|{PART})){NAME}*+|{NAME}*?(?ai:api|access|private)\x20(?ai:key){NAME}*+)["']?(?:\x20{{0,4}}(?::=|=>|[:=])\x20{{0,4}}|(?P<prose>\x20is\x20))"""
    r"""(?:"(?P<double>[^"\r\n]{6,1024})"|'(?P<single>[^'\r\n]{6,1024})'|(?P<open>["'])?(?P<value>[^\s"'<>,;]{6,}))"""
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "login", "pin")
#: log10 of the guesses from which a value counts as a secret.
PRICE = 7.0
#: Characters of one segment at most; longer spans are several segments.
SEGMENT = 64
#: A vocabulary whose words end in END, the most frequent first; words have this many letters at least.
VOCABULARY, END, LETTERS = "/opt/tokenizers/word_bpe_49k.json", "</w>", 4

# Common passwords and their parts, most common first, and the rows of the usual keyboard.
COMMON = (
    "password 123456 qwerty admin welcome letmein login master dragon monkey shadow sunshine princess football baseball superman "
    "batman trustno1 iloveyou hello freedom whatever secret summer winter spring autumn test guest user root default changeme pass "
    "word love star ninja hunter soccer hockey killer pepper ginger cookie cheese orange purple silver golden tiger lion "
    "eagle falcon phoenix michael jordan thomas robert daniel charlie george andrew jessica jennifer ashley nicole internet "
    "computer server database oracle system network access account service backup temp demo example sample placeholder none null "
    "true false your here token value string change me the and for key api app dev prod"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$!", "oleastbasi")
TO_LOWER = str.maketrans(UPPER, LOWER)
WALKS = {a + b for row in KEYBOARD for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
DATE = re.compile(r"(?:(?:19|20)[0-9]{2})(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)?[0-9]{2})")
POOLS = (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))


def pool(ch: str) -> int:
    return next((n for chars, n in POOLS if ch in chars), 33)


@cache
def ranks(vocabulary: str | None = None) -> dict[str, int]:
    """The rank of each word: common passwords, then words of ASCII letters of the vocabulary file (none: only the former)."""
    words = list(COMMON)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        whole = (t.removesuffix(END) for t in sorted(tokens, key=tokens.get) if t.endswith(END))
        words += [w for w in whole if len(w) >= LETTERS and w.isascii() and w.isalpha()]
    return {w: k for k, w in enumerate(dict.fromkeys(words), 1)}


@cache
def common() -> dict[str, int]:
    return ranks()


def segments(value: str, low: str, plain: str, i: int, rank: Mapping[str, int], longest: int) -> Iterator[tuple[int, float]]:
    """End and log10 of the guesses of each word, date, repeat and keyboard walk that begins at i; low and plain: value in lower case, without leet."""
    n, step = len(value), math.log10(2)
    for j in range(i + 2, min(n, i + longest) + 1):
        word = low[i:j]
        if found := rank.get(word) or rank.get(plain[i:j]):
            yield j, math.log10(found + 1) + step * ((value[i:j] != word) + (word not in rank))
    if value[i].isdigit():
        for j in range(i + 4, min(n, i + 10) + 1):
            if DATE.fullmatch(value, i, j):
                yield j, 4.6 if j - i > 4 else 2.1
    j = i + 1
    while j < n and j - i < SEGMENT and value[j] == value[i]:
        j += 1
        if j - i >= 3:
            yield j, math.log10(pool(value[i]) * (j - i))
    j = i + 1
    while j < n and j - i < SEGMENT and low[j - 1 : j + 1] in WALKS:
        j += 1
        if j - i >= 3:
            yield j, math.log10(47 * (j - i) * 4)
    for size in (2, 3, 4):  # a block that repeats: its own price once, times the repeats
        block, k = value[i : i + size], 1
        while len(block) == size and value.startswith(block, i + k * size) and k * size < SEGMENT:
            k += 1
            if k >= 3:
                yield i + k * size, sum(math.log10(pool(c)) for c in block) + math.log10(k)


def guesses(value: str, rank: Mapping[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation; each segment but brute force after the first place doubles them."""
    rank = common() if rank is None else rank
    n, longest = len(value), max(map(len, rank), default=0)
    low = value.translate(TO_LOWER)
    plain = low.translate(LEET)
    cost = [0.0] + [math.inf] * n
    for i in range(n):
        # brute force goes on from any segment, without a step of its own
        cost[i + 1] = min(cost[i + 1], cost[i] + math.log10(pool(value[i])))
        for j, price in segments(value, low, plain, i, rank, longest):
            cost[j] = min(cost[j], cost[i] + price + (math.log10(2) if i else 0.0))
    return cost[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def scan(text: str | None, price: float = PRICE, rank: Mapping[str, int] | None = None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, value) by start, then kind as in KINDS; null is empty."""
    if not text:
        return []
    base = base_spans(text)
    found = [(k, s, e, True, text[s:e]) for k, s, e in base]
    low = text.lower()
    if any(k in low for k in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            group = next(g for g in ("double", "single", "value") if m[g] is not None)
            s, end = m.span(group)
            quoted = group != "value" or m["open"]
            while end > s and not quoted and text[end - 1] in ".:!?)]}":
                end -= 1
            value = text[s:end]
            # in prose ("the password is required") a plain word is no value; after a separator its price alone decides
            given = quoted or not m["prose"] or not value.isalpha()
            if len(value) >= 6 and given and not any(a < end and s < e for _, a, e in base) and guesses(value, rank) >= price:
                found.append(("password", s, end, False, value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, column: str = "text", price: float = PRICE, vocabulary: str | None = None) -> DataFrame:
    """docs with `spans`: kind, start and end (code points, end exclusive), base, and the text of the span.

    vocabulary: a file of the driver with further words; its words, bounded by the file, travel with the tasks.
    Null and empty texts have no spans; rows repeat as in docs; other columns stay, a column named spans is replaced.
    """
    rank = ranks(vocabulary)

    def work(texts):
        return [[[dict(zip(("kind", "start", "end", "base", "value"), x, strict=True)) for x in scan(t, price, rank)] for t in texts]]

    return appended(docs, f"spans {SPANS}", work, column)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=VOCABULARY)
    spans = F.col("spans")
    base = F.sha2(spans_digest(F.filter(spans, lambda s: s["base"])), 256)
    return found.select("doc_id", *[of_kind(spans, k).alias(f"n_{k}") for k in KINDS[:3]], base.alias("base_sha256"), spans_digest(spans).alias("spans"))
