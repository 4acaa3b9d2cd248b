"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each window of an item (13 consecutive words; all words of a shorter item) is a set of positioned words that must be
contained whole, so that one prefix word is necessary: its rarest, counted over all documents. Document words meet the
windows of their prefix word; the window's length and the word's place bound where it can lie, the second rarest word
is looked up in its place, and the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lower_ascii, numbered, stored, table

#: Fixed by the contract: what lies between words, words in a window, the share of hit words (1 in so many).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHARE = 20
#: Windows that are broadcast at most, about 300 bytes each; more are joined by a shuffle on the prefix word.
BROADCAST_WINDOWS = 100_000
#: In that shuffle, words that hold more than one in so many places are spread over several tasks.
HOT = 2_000


def pieces(text: Column) -> Column:
    """Words in lower case; the first and last element are empty where the text begins or ends between words."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)


def n_pieces(p: Column) -> Column:
    return (F.size(p) - (F.element_at(p, 1) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")).cast("long")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: its words, and the items that have it (items without id are in no list)."""
    w = F.filter(pieces(F.col("text")), lambda x: x != "")
    cut = benchmark.select(F.col("item_id").cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = cut.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def with_prefix(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to each window its two rarest words over all documents, and their places (the same one twice in a window of one word)."""
    each = cut.select(F.monotonically_increasing_id().alias("id"), "words", "items")
    each = stored(each)
    placed = each.select("id", F.posexplode("words").alias("place", "word"))
    vocabulary = placed.select("word").distinct()
    seen = docs.select(F.explode(pieces(F.col("text"))).alias("word"))
    small = each.count() <= BROADCAST_WINDOWS
    counted = seen.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").count()
    rare = placed.join(F.broadcast(counted) if small else counted, "word", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "place"))).alias("by_rarity"))
    first, second = F.element_at("by_rarity", 1), F.element_at("by_rarity", F.least(F.lit(2), F.size("by_rarity")))
    rare = rare.where(first["n"] > 0)  # a window of which a word is in no document occurs in none
    rare = rare.select("id", first["n"].alias("seen"), first["word"].alias("prefix"), first["place"].alias("place"), second["word"].alias("second"), second["place"].alias("second_place"))
    out = stored(each.join(rare, "id").drop("id"))
    dropped(each)
    return out


def met_by_shuffle(rows: DataFrame, cut: DataFrame, text: DataFrame) -> DataFrame:
    """(_id, _key, start, words, items) of windows that occur: places of document words meet the windows of their prefix word.

    Only places travel; the few candidates then go to the texts, which decide. Prefix words that hold more than one in HOT of
    all places, of which there are fewer than that, are broadcast with a number of salts, by which their places are spread.
    """
    seen = cut.groupBy("prefix").agg(F.max("seen").alias("seen"))
    limit = max(1, (seen.agg(F.sum("seen")).first()[0] or 0) // HOT)
    hot = F.broadcast(seen.where(F.col("seen") > limit).select("prefix", F.ceil(F.col("seen") / limit).cast("int").alias("salts")))
    last = F.coalesce("salts", F.lit(1)) - 1
    here = rows.join(hot, "prefix", "left").withColumn("salt", F.pmod(F.xxhash64("_id", "_key", "_at"), last + 1).cast("int"))
    there = cut.join(hot, "prefix", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("_at") - F.col("place")
    near = here.join(there, ["prefix", "salt"]).where((start >= 0) & (start + F.size("words") <= F.col("_n")))
    near = near.groupBy("_id", "_key").agg(F.collect_list(F.struct(start.alias("start"), "words", "items")).alias("c"))
    near = near.select(F.col("_id").alias("i"), F.col("_key").alias("k"), "c")
    met = text.join(near, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_key") == F.col("k"))).select("_id", "_key", "_p", F.inline("c"))
    return met.where(F.slice("_p", F.col("start") + 1, F.size("words")) == F.col("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items, items (sorted as strings) and contaminated.

    docs needs doc_id and text, benchmark item_id and text; further columns of docs stay, and those of the names above
    are replaced. A null text has no words, an item without words no window. Items without id count for n_hit only.
    Rows repeat in the result as in docs; an empty benchmark hits nothing.
    """
    own, to = numbered(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    docs = own.select("*", F.col(to["doc_id"]).alias("doc_id"), F.col(to["text"]).alias("text"))
    cut = with_prefix(windows(benchmark, window), docs)
    n = cut.count()
    text = docs.select(F.col("doc_id").alias("_id"), F.md5("text").alias("_key"), pieces(F.col("text")).alias("_p"))
    rows = text.select("_id", "_key", "_p", F.posexplode("_p").alias("_at", "prefix"))
    start = F.col("_at") - F.col("place")
    fits = (start >= 0) & (start + F.size("words") <= F.size("_p"))
    if n <= BROADCAST_WINDOWS:
        met = rows.join(F.broadcast(cut), "prefix").where(fits)
        met = met.where(F.get("_p", start + F.col("second_place")) == F.col("second"))
        met = met.where(F.slice("_p", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    else:
        met = met_by_shuffle(rows.select("_id", "_key", "prefix", "_at", F.size("_p").alias("_n")), cut, text)
        start = F.col("start")
    met = met.select("_id", "_key", start.alias("start"), F.size("words").alias("long"), "items")
    hit = met.groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "long")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["long"] - 1))))
    hit = hit.select("_id", "_key", F.size(covered).cast("long").alias("n_hit"), "items")
    base = docs.withColumns({"_p": pieces(F.col("text")), "_k": F.md5("text")}).withColumn("n_words", n_pieces(F.col("_p")))
    out = base.join(hit, base["doc_id"].eqNullSafe(hit["_id"]) & (base["_k"] == hit["_key"]), "left")
    hits, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    new = {"n_hit": hits, "items": items, "n_items": F.size(items).cast("long"), "contaminated": (hits > 0) & (SHARE * hits >= F.col("n_words"))}
    return out.select(*[F.col(n).alias(c) for c, n in to.items()], "n_words", *[x.alias(c) for c, x in new.items()])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 12] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT DISTINCT len(words) AS n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM p JOIN win ON p.w[p.s:p.s + p.n - 1] = win.words),
h AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM m), unnest(range(0, n)) AS t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
