"""Mixing sources to target weights by subset-sum budget fitting.

A source takes all its documents as many whole times as its target allows. For the rest of the budget its documents are
counted by exact length; each length first gives its share, rounded down, and a bounded-knapsack dynamic program over
lengths fits what remains. Of each length, the documents with the smallest seeded hashes are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, dropped, numbered, stored, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 17
#: Words of the rest budget, beside one document's length, that the dynamic program has at first, and to which it grows where it misses.
BUDGET, WIDEST = 65_536, 1 << 22


def n_words(text: Column) -> Column:
    p = F.split(F.coalesce(text, F.lit("")), SPACE)
    return (F.size(p) - (F.element_at(p, 1) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")).cast("long")


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, within counts, so that the sum is the nearest to the budget from below.

    Counts are split into powers of two; for each sum, the first of these items that reached it is kept, and the items
    before it reach what it leaves.
    """
    taken, items = [0] * len(lengths), []
    reach = np.zeros(budget + 1, dtype=bool)
    item_of = np.zeros(budget + 1, dtype=np.int32)
    reach[0], most = True, 0
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        some, count = 1, min(count, budget // length) if length else 0
        while count > 0 and not reach[budget]:
            some = min(some, count)
            by = length * some
            new = by + np.flatnonzero(reach[: budget - by + 1] & ~reach[by:])
            reach[new], item_of[new] = True, len(items)
            most = max(most, int(new[-1])) if len(new) else most
            items.append((k, some))
            count, some = count - some, some * 2
    at = most
    while at:
        k, some = items[item_of[at]]
        taken[k] += some
        at -= lengths[k] * some
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = BUDGET, widest: int = WIDEST) -> np.ndarray:
    """Documents of each length (distinct, above 0) to take once, for a sum that is nearest to the budget from below; it is below that of all.

    Each length first gives its even share, and the longest more of it until `window` words are left to the dynamic
    program. Where that misses the budget, the shares give words back and the window grows fourfold, until the budget is
    met or the window is all of it; beyond `widest` the nearest sum of that window stays.
    """
    unit = int(np.gcd.reduce(lengths)) if len(lengths) else 1
    lengths, budget = lengths // unit, budget // unit
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    share = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    best, got, first = share, -1, window
    while True:
        give, left = share.copy(), budget - int((share * lengths).sum())
        by_length = np.argsort(-lengths, kind="stable")
        for k in by_length:
            if left > window:
                more = min(int(counts[k] - give[k]), (left - window) // int(lengths[k]))
            else:
                more = -min(int(give[k]), (window - left) // int(lengths[k])) if window > first else 0
            give[k], left = give[k] + more, left - more * int(lengths[k])
        order = [k for k in by_length if lengths[k] <= left and counts[k] > give[k]]
        extra = subset_sum([int(lengths[k]) for k in order], [int(counts[k] - give[k]) for k in order], left)
        for k, x in zip(order, extra, strict=True):
            give[k] += x
        if (met := int((give * lengths).sum())) > got:
            best, got = give, met
        if got == budget or first < window >= min(budget, widest):
            return best
        window *= 4


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: weights go round by code point order of source, null last; targets share all sizes
    by weight and stop at `most` times their source's size, the excess being shared again until none is above."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = F.col("source").asc_nulls_last()
    sources = stored(sources.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    first = sources.groupBy("_p").count().withColumn("_first", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    unweighed, sources = sources, stored(sources.join(F.broadcast(first), "_p").select("source", "source_size", weight.alias("weight")))  # a row for each partition
    dropped(unweighed)
    cap = F.col("source_size") * float(most)
    level = 0.0
    while True:
        above = cap < level * F.col("weight")
        s = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not s["all"] or not s["weight"] or (new := (s["all"] - s["capped"]) / s["weight"]) <= level:
            break
        level = new
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source and size of `sized` (source, size, h; stored): copies that every document gives, and the largest
    hash of those that give one more (null: none), beside source_size and target."""
    hist = sized.groupBy("source", "size").count()
    to = targets(sized, weights, most)
    joined = hist.join(to, hist["source"].eqNullSafe(to["source"])).drop(to["source"])

    def knapsack(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        copies = min(most, int(target // total)) if total else 0
        rest = round(target - copies * total) if copies < most else 0
        has = (pdf["size"] > 0).to_numpy()
        extra = np.zeros(len(pdf), dtype=np.int64)
        extra[has] = fit(pdf["size"].to_numpy()[has], pdf["count"].to_numpy()[has], rest)
        return pdf.assign(copies=copies, extra=extra)

    fitted = stored(joined.groupBy("source").applyInPandas(knapsack, "source string, size long, count long, source_size long, target double, copies int, extra long"))
    # The extra-th smallest hash of a source and size: whole buckets of hashes by their counts, rows only in the bucket where it lies.
    rows = sized.withColumn("b", F.shiftright("h", 52).cast("int"))
    some = fitted.where("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("l"), "extra")
    buckets = rows.groupBy("source", "size", "b").count()
    w = Window.partitionBy("source", "size").orderBy("b")
    ends = buckets.withColumn("end", F.sum("count").over(w)).join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")))
    edge = ends.where((F.col("end") >= F.col("extra")) & (F.col("end") - F.col("count") < F.col("extra"))).select("s", "l", F.col("b").alias("eb"), (F.col("extra") - F.col("end") + F.col("count")).alias("k"))
    inside = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("b") == F.col("eb")))
    nth = inside.withColumn("r", F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h"))).where("r = k").select("s", "l", F.col("h").alias("last"))
    out = fitted.join(nth, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")), "left")
    done = stored(out.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "copies", "last"))
    dropped(fitted)
    return done


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.withColumns({"size": n_words(F.col("text")), "h": F.xxhash64(F.lit(seed), "doc_id", "text")})


def mixed(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    out = rows.join(fitted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("copies") + F.coalesce((F.col("h") <= F.col("last")).cast("int"), F.lit(0)))
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_source", "_size", "last")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target, copies and taken.

    Columns of docs with these names are replaced. A null text has no words; documents without words are taken 0 times.
    Null is a source of its own. Rows that are the same in doc_id and text share a hash: both give one more, or none.
    """
    own, to = numbered(docs, "size", "source_size", "target", "copies", "taken")
    rows = own.select("*", *[F.col(to[c]).alias(c) for c in ("doc_id", "text", "source")])
    weighed = sized(rows, seed)
    counts = stored(weighed.select("source", "size", "h"))
    fitted = plan(counts, weights, most)
    dropped(counts)
    return mixed(weighed, fitted).select(*[F.col(n).alias(c) for c, n in to.items()], "size", "source_size", "target", "copies", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = stored(sized(docs).select("doc_id", "source", "size", "h"))
    return mixed(rows, plan(rows)).select("doc_id", "size", "source_size", "target", "taken")
