"""Language identification of words, spans and documents.

Hashed letter trigrams give each word a score for each language; the word's script, by ranges of code points, narrows
the languages it can have; Viterbi over a document's words, with a penalty for each switch, labels its spans. The
language of a document is that of most letters of its words.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, table

#: Labelled documents of each language that train the model, and characters of one at most (a longer one is not in the
#: sample); the sample is the documents whose hashed ids are smallest in expectation.
SAMPLE, SAMPLE_CHARS = 600, 100_000
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log probability that a switch costs, and that a word costs in a language that is not written in its script.
SWITCH, FOREIGN = 6.0, 30.0
#: Share of a language's letters from which a script is one of its own.
OWN_SCRIPT = 0.01
UND = "und"
PORTION = 4_000_000
LETTER = re.compile(r"[^\W\d_]")

# First code points of ranges of scripts; 0 stands for what is no letter range of its own.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({n for _, n in SCRIPTS})


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    starts = np.array([0, *(a for a, _ in SCRIPTS)])
    names = np.array([NAMES.index("latin"), *(NAMES.index(n) for _, n in SCRIPTS)], dtype=np.int8)
    return letter, names[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of the letters of all words, the word of each, its script, and the number of letters of each word."""
    letter, script = tables()
    codes = np.frombuffer(("\n" + "\n".join(words).lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = np.cumsum(codes == 10) - 1
    is_letter = letter[codes]
    c = np.where(is_letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA6B) ^ c[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64) % BUCKETS, word[at], script[codes[at]], np.bincount(word[at], minlength=len(words))


class Model:
    """Languages in code point order, with their trigram scores and scripts."""

    def __init__(self, langs: list[str], scores: np.ndarray, scripts: np.ndarray):
        self.langs, self.scores, self.scripts = langs, scores, scripts

    @classmethod
    def fitted(cls, rows: list[tuple[str, str]]) -> Model:
        langs = sorted({lang for lang, _ in rows})
        counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
        for lang, text in rows:
            ids, _, script, _ = grams(text.split() or [""])
            k = langs.index(lang)
            counts[:, k] += np.bincount(ids, minlength=BUCKETS)
            scripts[:, k] += np.bincount(script, minlength=len(NAMES))
        scores = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
        return cls(langs, scores.astype(np.float32), scripts >= OWN_SCRIPT * np.maximum(scripts.sum(axis=0), 1))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, 0 for words without letters, and their numbers of letters."""
        ids, word, script, letters = grams(words)
        out = np.empty((len(words), len(self.langs)), dtype=np.float32)
        main = np.zeros(len(words), dtype=np.int64)
        main[word] = script  # a word of several scripts goes by its last letter
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, weights=self.scores[ids, k], minlength=len(words))
        can = self.scripts[main]
        out -= np.where(~can & can.any(axis=1)[:, None] & (letters > 0)[:, None], np.float32(FOREIGN), np.float32(0))
        return out, letters


def viterbi(scores: np.ndarray, code: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word of many documents (first: where a document's words begin in code; count: how many)."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    most, n_langs = int(count[0]) if len(count) else 0, scores.shape[1]
    live = np.searchsorted(-count, -np.arange(most), side="left")
    own = np.arange(n_langs, dtype=np.int16)[None, :]
    back = np.zeros((len(code), n_langs), dtype=np.int16)
    best = np.zeros((len(count), n_langs), dtype=np.float32)
    for t in range(most):
        a = live[t]
        at, b = first[:a] + t, best[:a]
        if t:
            top = b.max(axis=1, keepdims=True)
            stay = b >= top - switch
            back[at] = np.where(stay, own, b.argmax(axis=1)[:, None])
            b = np.where(stay, b, top - switch) - top
        best[:a] = b + scores[code[at]]
    label = np.zeros(len(code), dtype=np.int16)
    now = best.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        a = live[t]
        at = first[:a] + t
        label[at] = now[:a]
        if t:
            now[:a] = back[at, now[:a]]
    return label


class Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


def label(model: Model, texts: list[str]) -> tuple[list[tuple[str, float]], np.ndarray, np.ndarray]:
    """Language and score of each text, and the label of each word with the first word of each text."""
    index, code, count = Index(), [], []
    for t in texts:
        words = t.split()
        code += map(index.__getitem__, words)
        count.append(len(words))
    counts, codes = np.array(count, dtype=np.int64), np.array(code, dtype=np.int64)
    first = np.cumsum(counts) - counts
    scores, letters = model.words(list(index) or [""])
    labels = viterbi(scores, codes, first, counts)
    n = len(model.langs)
    doc = np.repeat(np.arange(len(texts)), counts)
    share = np.bincount(doc * n + labels, weights=letters[codes] if len(codes) else None, minlength=len(texts) * n).reshape(len(texts), n)
    total = share.sum(axis=1)
    pick = share.argmax(axis=1)
    rows = [(model.langs[k], float(share[i, k] / total[i])) if total[i] else (UND, 0.0) for i, k in enumerate(pick)]
    return rows, labels, first


def portions(texts: list[str | None]):
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(t or "") + 100
        if size >= PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on a bounded sample of the documents with a language and text whose crc32 of doc_id is not 1 modulo 3."""
    known = docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1) & F.col("lang").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((len(NAMES), 0), dtype=bool))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    part = (F.xxhash64("doc_id", F.lit("langid")) / F.lit(2.0**64)) + 0.5
    rows = known.where(part <= F.element_at(share, F.col("lang"))).select("lang", "text").collect()
    return Model.fitted(sorted((r["lang"], r["text"]) for r in rows)) if rows else fit(docs, sample * 2)


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs (with text) with lang_pred and score, the share of letters in words of that language.

    Texts that are null or without letters, and all texts if no language is learned, give `und` and 0. Ties go to the
    first language in code point order. spans: adds lang_spans (start, end, lang) over the words, code points, end
    exclusive. Rows repeat as in docs; columns of docs with the new names are replaced.
    """

    def work(texts):
        pred, score, runs = [], [], []
        for some in portions(texts):
            if not model.langs:
                pred += [UND] * len(some)
                score += [0.0] * len(some)
                runs += [[] for _ in some]
                continue
            rows, labels, first = label(model, some)
            for k, (t, (lang, s)) in enumerate(zip(some, rows, strict=True)):
                pred.append(lang)
                score.append(s)
                if spans:
                    found: list[dict] = []
                    for m, own in zip(re.finditer(r"\S+", t), labels[first[k] :], strict=False):
                        if found and found[-1]["lang"] == model.langs[own]:
                            found[-1]["end"] = m.end()
                        else:
                            found.append({"start": m.start(), "end": m.end(), "lang": model.langs[own]})
                    runs.append(found if lang != UND else [])
        return [pred, score, runs][: 3 if spans else 2]

    fields = "lang_pred string, score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    return appended(docs, fields, work)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
