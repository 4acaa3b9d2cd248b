"""Sharding by balanced label propagation over groups of linked documents, in DataFrame functions only.

Documents of one group (equal texts, in the query) are neighbours of each other. Linked documents are first dealt to
the shards in turn, in the order of their hashes. In each round the labels of a group's members are counted and joined to
the members, and a member that isn't in the shard where most of its neighbours are asks to move there. All that ask move,
but for those that would take a shard beyond its quota, counting who leaves it: the members of small groups stay first.
The next round counts the new labels, until nobody moves. While this goes on, shards may be a little larger than at the
end, if nearly all documents are linked; then they give up their smallest groups. These and documents without links fill
what room is left, group by group, so that the shards' row counts are at most one apart. The votes of a group stand for
the edges between all its pairs, which are not made. A group larger than a shard is cut into as many parts as it needs,
each with its own votes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ranked, stored, table

SHARDS = 8
#: Rounds without a move, though some ask, after which it ends (each asks anew where there is room); rounds at most: a member that
#: found no room by then keeps its label, and its edges to others are cut.
PATIENCE, ROUNDS = 3, 24
#: Linked rows that a shard may hold while labels move, as a multiple of its even share; its final count bounds it where that is more.
LOOSE = 1.25
#: Groups that hold more than one in so many rows, of which there are fewer than that, are broadcast.
HOT = 2_000
#: Buckets of those that ask to move, by size of group, hash of group and hash of member; a shard takes whole buckets.
SIZE_CLASSES, HASHES, MEMBERS = 48, 8, 16


def grouped(nodes: DataFrame, least: int, limit: int) -> DataFrame:
    """nodes with part and hot; part is null for rows without links.

    Rows of hot groups meet them by a broadcast, those of others by a shuffle in which no group is large.
    """
    sized = nodes.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.when(F.col("n") > least, F.col("n") * 1.25 / max(1, least)).otherwise(1)).cast("int")
    sized = stored(sized.select("grp", "n", parts.alias("parts")))
    hot, cold = sized.where(F.col("n") > limit), sized.where(F.col("n") <= limit)
    met = nodes.join(F.broadcast(hot.select("grp", "parts")), "grp", "left")
    rest = met.where("parts is null").drop("parts")
    pieces = [(met.where("parts is not null"), True), (rest.where("grp is not null").join(cold.select("grp", "parts"), "grp", "left"), False), (rest.where("grp is null").withColumn("parts", F.lit(None).cast("int")), False)]
    part = F.pmod(F.xxhash64("h", F.lit("part")), F.col("parts")).cast("int").alias("part")
    out = stored(reduce(DataFrame.union, [x.select(*nodes.columns, part, F.lit(is_hot).alias("hot")) for x, is_hot in pieces]))
    dropped(sized)
    return out


def wishes(now: DataFrame, spare: list[int], r: int) -> DataFrame:
    """now with the shard that each row would move to (its own, if it stays) and the bucket in which it asks.

    Most neighbours decide, among shards whose spare rows (beyond those of groups that are where they want to be) can take
    the rest of the group; where none can, or every other time where another could, it is the shard of most neighbours.
    """
    votes = now.groupBy("grp", "part").agg(F.max("hot").alias("_hot"), F.count(F.lit(1)).alias("_n"), *[F.sum((F.col("label") == b).cast("long")).alias(f"_v{b}") for b in range(len(spare))])
    stays = F.pmod(F.xxhash64("grp", "part", F.lit(r), F.lit("stays")), F.lit(2)) == 1
    offers = [F.struct((stays | (F.col("_n") - F.col(f"_v{b}") <= spare[b])).alias("whole"), F.col(f"_v{b}").alias("votes"), F.shiftright(F.xxhash64("grp", "part", F.lit(b)), 8).alias("tie"), F.lit(b).alias("to")) for b in range(len(spare))]
    bucket = ((SIZE_CLASSES - F.floor(F.log2("_n"))) * HASHES + F.pmod(F.xxhash64("grp", "part", F.lit(r)), F.lit(HASHES))) * MEMBERS
    best = votes.select("grp", "part", "_hot", F.greatest(*offers)["to"].alias("to"), bucket.alias("_bucket"))
    hot = now.where("hot").join(F.broadcast(best.where("_hot").drop("_hot")), ["grp", "part"])
    cold = now.where("not hot").join(best.where("not _hot").drop("_hot"), ["grp", "part"])
    return hot.unionByName(cold).withColumn("bucket", F.col("_bucket") + F.pmod(F.xxhash64("h", F.lit(r)), F.lit(MEMBERS))).drop("_bucket")


def accepted(asked: list, taken: list[int], quota: list[int]) -> list[int]:
    """The last bucket that each shard takes (-1: none), so that none has more than its quota after all moves; taken is updated.

    asked: rows (label, to, bucket, count) of what would move. Where a shard would have too many, its last buckets stay,
    which in turn leaves their old shards fuller, until none has too many.
    """
    into: list[dict[int, list]] = [{} for _ in quota]
    for x in asked:
        into[x["to"]].setdefault(x["bucket"], []).append(x)
        taken[x["to"]] += x["count"]
        taken[x["label"]] -= x["count"]
    order = [sorted(x) for x in into]
    while over := [b for b, q in enumerate(quota) if taken[b] > q]:
        for b in over:
            while taken[b] > quota[b]:
                for x in into[b][order[b].pop()]:
                    taken[b] -= x["count"]
                    taken[x["label"]] += x["count"]
    return [x[-1] if x else -1 for x in order]


def label_propagation(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (id, grp, h): a hash h for each row, spread evenly, and its group or null. Adds shard and slot.

    Row counts of shards are at most one apart, slots are gapless from 0 in each shard. Rows that are the same in every
    column may change places. Null groups have no links; a frame without rows gives none. nodes must be stored.
    """
    n = nodes.count()
    quota = [n // shards + (b < n % shards) for b in range(shards)]
    order = [F.col("h"), F.col("id")]
    whole = grouped(nodes, min(quota), n // HOT)
    # dealt in turn, no shard begins with more than its quota
    now = stored(ranked(whole.where("part is not null"), [], order, "label").withColumn("label", F.pmod("label", F.lit(shards)).cast("int")))
    free, columns, kept = whole.where("part is null"), now.columns, [now]
    taken = [0] * shards
    for x in now.groupBy("label").count().collect():
        taken[x["label"]] = x["count"]
    cap = [max(q, int(LOOSE * sum(taken) / shards)) for q in quota]
    spare, fruitless = list(cap), 0
    for r in range(rounds):
        wish = stored(wishes(now, spare, r))
        kept.append(wish)
        sums = wish.groupBy("label", "to", F.when(F.col("to") != F.col("label"), F.col("bucket")).alias("bucket")).count().collect()  # 8 x 8 x 48 x 8 x 16 at most
        cut = accepted([x for x in sums if x["bucket"] is not None], taken, cap)
        there = [0] * shards
        for x in sums:
            there[x["to"]] += x["count"] if x["bucket"] is None or x["bucket"] <= cut[x["to"]] else 0
        spare = [q - t for q, t in zip(cap, there, strict=True)]
        limits = F.array(*[F.lit(c).cast("long") for c in cut])
        now = wish.withColumn("label", F.when(F.col("bucket") <= F.get(limits, F.col("to")), F.col("to")).otherwise(F.col("label"))).select(*columns)
        for old in kept[:-1]:
            dropped(old)
        kept = [wish]
        fruitless = fruitless + 1 if max(cut) < 0 else 0
        if fruitless == PATIENCE or all(x["bucket"] is None for x in sums):
            break
    if any(t > q for t, q in zip(taken, quota, strict=True)):
        # without the hash of the member, so that groups go whole
        wish = stored(wishes(now, spare, rounds).withColumn("bucket", F.floor(F.col("bucket") / MEMBERS)))
        last = [SIZE_CLASSES * HASHES * 2] * shards
        for x in sorted(wish.groupBy("label", "bucket").count().collect(), key=lambda x: -x["bucket"]):
            if taken[b := x["label"]] > quota[b]:
                taken[b], last[b] = taken[b] - x["count"], x["bucket"] - 1
        stays = F.col("bucket") <= F.get(F.array(*[F.lit(x).cast("long") for x in last]), F.col("label"))
        now, free = wish.where(stays).select(*columns), free.unionByName(wish.where(~stays).select(*free.columns))
    linked = ranked(now.select(*nodes.columns, F.col("label").alias("shard")), ["shard"], order, "slot")
    by_group = F.when(F.col("part").isNull(), F.col("h")).otherwise(F.xxhash64("grp", "part"))
    free = stored(free.select(*nodes.columns, by_group.alias("_g")))
    free = ranked(free, [], [F.col("_g"), *order], "_rank").drop("_g")
    ends, starts, end = [], [], 0
    for b in range(shards):
        starts.append(end - taken[b])
        end += quota[b] - taken[b]
        ends.append(end)
    shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= F.col("_rank")))
    free = free.withColumn("shard", shard.cast("int"))
    free = free.withColumn("slot", F.col("_rank") - F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard")))
    return linked.unionByName(free.select(*linked.columns))


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row: edges between linked rows of placed (grp, shard), and how many of them lie between two shards."""
    counts = placed.where("grp is not null").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    edges = F.col("n") * (F.col("n") - 1) / 2
    return sums.agg(F.coalesce(F.sum(edges), F.lit(0.0)).cast("long").alias("edges"), F.coalesce(F.sum(edges - F.col("inside")), F.lit(0.0)).cast("long").alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text): equal texts are linked.

    A null text has size 1, the checksum of no bytes and no links; empty texts are equal texts. Further columns are not
    used. Rows repeat as in docs; rows that are the same in doc_id and text share a label but each has a slot.
    """
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")).alias("id"), F.md5("text").alias("grp"), F.xxhash64("doc_id", "text").alias("h"))
    out = label_propagation(stored(nodes), shards)
    return out.select("id.doc_id", "id.size", F.col("id.crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
