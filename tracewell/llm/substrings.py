"""Repeated passages: words are removed that lie in a window whose words also begin in a document with a smaller id.

Every window of 13 words picks one of its five-word runs by hash, its anchor, so that equal windows have equal anchors.
Only anchors that several documents have are followed up. The words around an anchor's occurrence that its windows
cover are a segment; equal segments are one, with their least document. The segments of an anchor are a reference
shard: if there is more than one, a suffix automaton takes them in order of their least documents, and the matching
statistics of each against those before it give the least document of each window. Automata are dealt by anchor, not
broadcast, as broadcasting shards of the corpus itself to all its documents would take their product in time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, dropped, numbered, stored, table
from .neardup import PLACES, WordHashes, mixed

WINDOW, RUN = 13, 5
#: Distinct segments of one anchor that share an automaton; an anchor with more is resolved window by window in joins.
SEGMENTS = 5_000
LAST = (1 << 63) - 1


def anchors(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor's occurrence: its hash, and the first and last window that pick it."""
    n = len(words)
    if n < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 3
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    h = w[: n - RUN + 1] * PLACES[0]
    for k in range(1, RUN):
        h += w[k : n - RUN + 1 + k] * PLACES[k]
    h = mixed(h)
    per = WINDOW - RUN + 1
    picked = np.lib.stride_tricks.sliding_window_view(h, per).argmin(axis=1) + np.arange(n - WINDOW + 1)
    starts = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    ends = np.concatenate([starts[1:], [len(picked)]]) - 1
    return h[picked[starts]].view(np.int64), starts, ends


class SuffixAutomaton:
    """Of sequences that are added in order of their documents; a state knows the first document that reaches it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    def add(self, words: list[str], doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _extend(self, last: int, w: str, doc: int) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        if (q := nxt[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(doc)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def earliest(self, words: list[str], window: int) -> list[int | None]:
        """For each window of the words, the first document that has it; None if none has."""
        out: list[int | None] = []
        v = size = 0
        for k, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if w in self.next[v]:
                v, size = self.next[v][w], size + 1
            if k >= window - 1:
                if size < window:
                    out.append(None)
                else:
                    u = v
                    while self.length[self.link[u]] >= window:
                        u = self.link[u]
                    out.append(self.first[u])
        return out


def resolved(segments: DataFrame) -> DataFrame:
    """segment and earliest (the least document of each window) for segments (anchor, segment, words, least) of several an anchor."""

    def run(batches):
        now, tree = None, None
        for b in batches:
            out = []
            for anchor, words, least in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if anchor != now:
                    now, tree = anchor, SuffixAutomaton()
                w = words.split(" ")
                found = tree.earliest(w, WINDOW)
                if None in found:
                    tree.add(w, least)
                out.append([least if x is None else x for x in found])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, type=pa.list_(pa.int64()))], names=["segment", "earliest"])

    dealt = segments.select("anchor", "segment", "words", "least").repartition("anchor").sortWithinPartitions("anchor", "least", "words")
    return dealt.mapInArrow(run, "segment binary, earliest array<bigint>")


def resolved_by_window(segments: DataFrame) -> DataFrame:
    w = F.split("words", " ")
    cut = segments.select("anchor", "segment", "least", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda s: F.slice(w, s, WINDOW))).alias("at", "window"))
    least = cut.groupBy("anchor", "window").agg(F.min("least").alias("first"))
    met = cut.join(least, ["anchor", "window"])
    return met.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "first"))), lambda x: x["first"]).alias("earliest"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and spans: (first word, words) of windows that begin in a document with a smaller id."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), F.xxhash64("text").alias("key"), "text").where("text is not null")

    def pick(texts):
        hashes = WordHashes()
        return [[np.unique(anchors((t or b"").split(), hashes)[0]) for t in texts]]

    picked = stored(appended(keyed, "anchors array<bigint>", pick, raw=True).drop("text"))
    each = picked.select("id", "key", F.explode("anchors").alias("anchor"))
    several = stored(each.groupBy("anchor").agg(F.min("id").alias("l"), F.max("id").alias("m")).where("l < m").select("anchor"))
    marks = stored(each.join(several, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("marks")))
    dropped(picked)

    def cut(batches):
        hashes = WordHashes()
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            ids, keys, texts, marked = (b.column(k) for k in range(4))
            for i, key, t, m in zip(ids.to_pylist(), keys.to_pylist(), texts.cast(pa.binary()).to_pylist(), marked, strict=True):
                words = t.split()
                anchor, start, end = anchors(words, hashes)
                on = np.flatnonzero(np.isin(anchor, m.values.to_numpy()))
                first = start[on].tolist()
                rows[0].extend([i] * len(on))
                rows[1].extend([key] * len(on))
                rows[2].extend(first)
                rows[3].extend(anchor[on].tolist())
                rows[4].extend([b" ".join(words[s:e]) for s, e in zip(first, (end[on] + WINDOW).tolist(), strict=True)])
                if len(rows[0]) > 50_000:
                    yield segment_batch(rows)
                    rows = ([], [], [], [], [])
            yield segment_batch(rows)

    met = keyed.join(marks, ["id", "key"]).select("id", "key", "text", "marks")
    segments = stored(met.mapInArrow(cut, "id long, key long, start int, anchor long, words string, segment binary"), compression="zstd")
    dropped(marks)
    distinct = stored(segments.groupBy("anchor", "segment", "words").agg(F.min("id").alias("least")), compression="zstd")
    several = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    alone = distinct.join(several, "anchor", "left_anti").select("segment", "least", F.lit(None).cast("array<bigint>").alias("earliest"))
    found = resolved(distinct.join(several.where(F.col("n") <= SEGMENTS), "anchor"))
    if not (hot := several.where(F.col("n") > SEGMENTS)).isEmpty():
        found = found.union(resolved_by_window(distinct.join(hot, "anchor")))
    found = stored(alone.union(found.select("segment", F.lit(None).cast("long").alias("least"), "earliest")))
    dropped(distinct)
    met = segments.select("id", "key", "start", "segment", (F.size(F.split("words", " ")) - WINDOW + 1).alias("n")).join(found, "segment")
    met = met.withColumn("earliest", F.coalesce("earliest", F.array_repeat("least", F.col("n"))))
    later = F.filter(F.transform("earliest", lambda x, k: F.when(x < F.col("id"), F.col("start") + k)), lambda x: x.isNotNull())
    met = met.select("id", "key", later.alias("starts")).where(F.size("starts") > 0)
    return stored(met.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))


def segment_batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    arrays = [pa.array(c, type=t) for c, t in zip(rows, types, strict=False)]
    words, segment = pa.array(rows[4], type=pa.binary()), pa.array([xxhash.xxh3_128_digest(w) for w in rows[4]], type=pa.binary())
    return pa.RecordBatch.from_arrays([*arrays, words.cast(pa.string()), segment], names=["id", "key", "start", "anchor", "words", "segment"])


def remove_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, kept_text: its kept words joined by one space.

    Words lie between ASCII white space. Null has none. A null doc_id comes after all others; documents that share an
    id are no source for each other. Windows are judged on the input. Rows repeat as in docs; columns of docs with the
    new names are replaced.
    """
    fields = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    spans = repeated(docs.select("doc_id", "text")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("starts").alias("_starts"))
    base, to = numbered(docs, "n_words", "n_removed", "kept_sha256", "kept_text")
    own_id, own_text = F.col(to["doc_id"]), F.col(to["text"])
    base = base.join(spans, (F.coalesce(own_id, F.lit(LAST)) == F.col("_id")) & (F.xxhash64(own_text) == F.col("_key")), "left").drop("_id", "_key")
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    new = T.StructType.fromDDL(fields)
    names = [c for c in base.columns if c != "_starts"]

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            at = b.schema.get_field_index(to["text"])
            for t, s in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.schema.get_field_index("_starts")), strict=True):
                words, removed = (t or b"").split(), 0
                n = len(words)
                if s.is_valid and len(s.values):
                    first = s.values.to_numpy()
                    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + WINDOW, minlength=n + 1)
                    keep = np.cumsum(edge[:n]) == 0
                    removed = n - int(keep.sum())
                    words = [words[k] for k in np.flatnonzero(keep)]
                kept = b" ".join(words)
                for c, v in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            arrays = [pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.int64()), pa.array(out[2])]
            if text:
                arrays.append(pa.array(out[3], type=pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *(a.cast(to_arrow_type(f.dataType)) for a, f in zip(arrays, new, strict=True))], names=[*names, *new.names])

    out = base.mapInArrow(run, T.StructType([*(f for f in base.schema if f.name != "_starts"), *new.fields]))
    return out.select(*[F.col(n).alias(c) for c, n in to.items()], *new.names)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False).drop("text")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, s, hash(w[s:s + 12]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12 + 1)) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h),
r AS (SELECT DISTINCT p.doc_id, p.s + k AS i FROM p JOIN m ON p.h = m.h AND m.least < p.doc_id, unnest(range(0, 13)) AS t(k)),
g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
