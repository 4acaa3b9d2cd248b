"""Near-duplicate groups by b-bit MinHash.

Documents with one set of shingles are a class from the start. Bands of minima name buckets. In a bucket, all members
first meet its heaviest one. Buckets that still have members in several components go on: a small one gives its pairs
of different components. Members of large ones stay only if enough of their shingles are shared at all; those that
have members in common choose one hub, and two members, of which one isn't linked with the hub, can be linked only if
they share a shingle outside the hub, which is a new bucket, or if one is small and what it lacks of the hub mostly
lacks in the other too, by which the two meet. So every pair of a bucket is tried, known to be in one component or
ruled out by its sets, and no large bucket emits its pairs. Pairs are first judged by packed low bits of the minima,
with a margin, then by their whole sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import appended, dropped, stored, table

SHINGLE = 5
SIMILARITY = 85  # per cent
#: Bands and rows: a pair at the threshold shares a bucket but for a chance of 1 in 4 million.
BANDS, ROWS = 26, 5
#: Minima that keep BITS low bits for the estimate, and how far below the threshold it may lie (six standard deviations).
KEPT, BITS, MARGIN = 128, 4, 0.22
SEED = 20_240_229
#: Hashes of words that a Python worker keeps, and texts that it holds as Python objects at a time.
WORD_CACHE, TEXTS = 1 << 17, 256
#: Small Arrow batches, as texts are many times as large as what is made of them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}
#: Members up to which a bucket gives its pairs at once, and rounds in which larger ones are divided around hubs.
SMALL, ROUNDS = 32, 8
#: Ids of 8 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_rng = np.random.default_rng(SEED)
PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
A = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
ROW_MIX = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MIX = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingle_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle, no words none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < SHINGLE:
        return mixed((w * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    h = w[: n - 4] * PLACES[0]
    for k in range(1, SHINGLE):
        h += w[k : n - 4 + k] * PLACES[k]
    return np.unique(mixed(h))


def minima(h: np.ndarray, piece: int = 2048) -> np.ndarray:
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(A), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), piece):
        np.minimum(out, (A[:, None] * x[None, k : k + piece] + B[:, None]).min(axis=1), out=out)
    return out


def sketch(h: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """The class of a set (128 bits), its band keys, and its packed low bits."""
    m = minima(h)
    rows = mixed((m.reshape(BANDS, ROWS).astype(np.uint64) * ROW_MIX).sum(axis=1, dtype=np.uint64) + BAND_MIX)
    low = (m[:KEPT] & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return xxhash.xxh3_128_digest(h.tobytes()), rows.view(np.int64).tolist(), packed.view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    hashes = WordHashes()

    def work(texts):
        out = ([], [], [], [])
        for t in texts:
            h = shingle_hashes(t, hashes)
            for c, v in zip(out, (len(h), *(sketch(h) if len(h) else (None, [], []))), strict=True):
                c.append(v)
        return out

    return appended(docs, "n_shingles long, node binary, bands array<bigint>, low array<bigint>", work, raw=True, rows=TEXTS, keep=False)


def sets(docs: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes."""

    hashes = WordHashes()

    def work(texts):
        nodes, out = [], []
        for t in texts:
            h = shingle_hashes(t, hashes)
            nodes.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            out.append(h.view(np.int64))
        return [nodes, out]

    return appended(docs, "node binary, shingles array<bigint>", work, raw=True, rows=TEXTS, keep=False).select("node", "shingles")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the share of equal low bits, less those that are equal by chance."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(d)

    differ = sum((unequal(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(1, KEPT * BITS // 64)), unequal(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    chance = 2.0**-BITS
    return (1 - differ / KEPT - chance) / (1 - chance)


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node that it reaches over links (a, b): least labels of neighbours, then of labels, until nothing moves."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    comp = stored(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")))
    while True:
        near = both.join(comp, both["b"] == comp["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        new = stored(comp.join(near, comp["node"] == near["a"]).select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old")))
        jump = new.select(F.col("node").alias("of"), F.col("new").alias("further"))
        after = stored(new.join(jump, new["new"] == jump["of"], "left").select("node", F.least("new", F.coalesce("further", "new")).alias("comp"), (F.coalesce("further", "new") != F.col("old")).alias("moved")))
        moved = not after.where("moved").isEmpty()
        dropped(comp)
        dropped(new)
        comp = after.select("node", "comp")
        comp._tracewell_path = after._tracewell_path
        if not moved:
            dropped(both)
            return comp


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after further links (a, b): only those between different components are followed."""
    one, two = comp.select(F.col("node").alias("a"), F.col("comp").alias("c")), comp.select(F.col("node").alias("b"), F.col("comp").alias("d"))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    further = components(between.where(F.col("a") != F.col("b")))
    alone = further.join(comp.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    to = further.select(F.col("node").alias("_of"), F.col("comp").alias("_to"))
    out = stored(comp.select("node", "comp").union(alone).join(to, F.col("comp") == F.col("_of"), "left").select("node", F.coalesce("_to", "comp").alias("comp")))
    dropped(further)
    return out


def compared(pairs: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) with both sets, their sizes, the size of their intersection and whether they are linked."""
    one, two = full.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), full.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    sized = pairs.join(one, "a").join(two, "b").withColumns({"n_a": F.size("s_a"), "n_b": F.size("s_b"), "inter": F.size(F.array_intersect("s_a", "s_b"))})
    return sized.withColumn("linked", 100 * F.col("inter") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("inter")))


def split(keyed: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, c, size) of the keys whose nodes lie in several components c; keys that have the same nodes are one."""
    named = keyed.join(comp.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("comp", "node").alias("c"))
    by = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    several = named.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("m"), F.count(F.lit(1)).alias("size"), *by).where("l < m")
    return named.join(several.groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key", "size"), "key")


def shared_enough(keyed: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """(node, n, mass) of the nodes of keyed that share, one by one, as many shingles with any others as a link takes.

    A link takes |i & j| >= similarity / 100 * |i | j|, so that at least this share of i's n shingles is in another set.
    mass is how often the shingles of a node are in any of the sets.
    """
    sets_ = full.join(keyed.select("node").distinct(), "node").dropDuplicates(["node"])
    each = stored(sets_.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("x")))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    sums = each.join(often, "x").groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared"), F.sum("often").alias("mass"))
    out = stored(sums.where(100 * F.col("shared") >= similarity * F.col("n")).select("node", "n", (F.col("mass") + F.col("n") - F.col("shared")).alias("mass")))
    dropped(each)
    return out


def families(large: DataFrame, mass: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """Every node of large (key, node) but the hubs: (a, b, n_a, n_b, linked, extra, missing), b its hub.

    Buckets with members in common are one family; its hub is the member that has most of the shingles that most members
    have and fewest others, so that the sets differ little from it in all.
    """
    centre = large.groupBy("key").agg(F.min("node").alias("b"))
    named = components(large.join(centre, "key").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b"))
    family = stored(named.join(mass, "node").select("node", "comp", "n", "mass"))
    dropped(named)
    sizes = family.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    best = F.max(F.struct((2 * F.col("mass") - F.col("m") * F.col("n")).alias("near"), "node")).alias("r")
    hub = family.join(sizes, "comp").groupBy("comp").agg(best).select(F.col("comp").alias("c"), F.col("r.node").alias("b"))
    around = family.join(hub, F.col("comp") == F.col("c")).where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    out = stored(compared(around, full, similarity).select("a", "b", "n_a", "n_b", "linked", F.array_except("s_a", "s_b").alias("extra"), F.array_except("s_b", "s_a").alias("missing")).dropDuplicates(["a"]))
    dropped(family)
    return out


def outside(hubs: DataFrame) -> DataFrame:
    """New buckets (key, node): nodes of a family that share a shingle outside its hub, with one that isn't linked with the hub."""
    each = hubs.select(F.col("a").alias("node"), "b", "linked", F.explode("extra").alias("x")).select("node", "linked", F.xxhash64("b", "x").alias("key"))
    asked = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("linked")).alias("asks")).where("n > 1 and asks").select("key")
    return each.join(asked, "key").select("key", "node")


def inside(hubs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that may be linked without a common shingle outside their hub, the first or second not linked with it.

    Let X be what a node has beyond its hub H, M what it lacks of it, D = |X| + |M|, t = (100 - s) / (100 + s) for the
    similarity s, and g = D - t * |node|. Nodes i and j are linked if |i ^ j| <= t * (|i| + |j|), that is if
    |Xi & Xj| + |Mi & Mj| >= (gi + gj) / 2. With Xi and Xj disjoint, |Mi & Mj| <= |Mj| gives
    gi <= 2 * |Mj| - gj = |H| - (1 - t) * |j|, and the same with i and j exchanged. If i isn't linked with H, gi is above
    t * |H|, so that j is smaller than H. Of Mj, any |Mj| - need + 1 shingles have one of Mi, need being (g + gj) / 2 for
    the least g of a node that isn't linked with H; those are taken that the fewest such nodes lack.
    """
    t, some = (100 - similarity) / (100 + similarity), 1e-6
    sized = hubs.withColumn("g", F.size("extra") + F.size("missing") - t * F.col("n_a")).withColumn("most", F.col("n_b") - (1 - t) * F.col("n_a") + some)
    least = sized.where(~F.col("linked")).groupBy("b").agg(F.min("g").alias("least"))
    length = F.size("missing") - F.greatest(F.lit(1), F.ceil((F.col("least") + F.col("g")) / 2 - some)) + 1
    small = stored(sized.join(least, "b").where("least <= most").withColumn("length", length).where("length > 0").select("a", "b", "g", "most", "missing", "length"))
    which = small.groupBy("b").agg(F.min("g").alias("g_least"), F.max("most").alias("most_of_all"))
    lacking = sized.where(~F.col("linked")).join(which, "b").where("g <= most_of_all and g_least <= most")
    lacks = stored(lacking.select("b", F.explode("missing").alias("x"), F.col("a").alias("i"), F.col("g").alias("g_i"), F.col("most").alias("most_i")))
    often = lacks.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    each = small.select("a", "b", "g", "most", "length", F.explode("missing").alias("x")).join(often, ["b", "x"], "left")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("n", F.lit(0)), "x"))
    asked = each.withColumn("place", place).where("place <= length and n is not null").select(F.col("b").alias("h"), F.col("x").alias("y"), F.col("a").alias("j"), "g", "most")
    met = asked.join(lacks, (F.col("h") == F.col("b")) & (F.col("y") == F.col("x")) & (F.col("g_i") <= F.col("most")) & (F.col("g") <= F.col("most_i")) & (F.col("i") != F.col("j")))
    out = stored(met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())
    dropped(small)
    dropped(lacks)
    return out


def crossing(keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of one key that lie in different components."""
    two = keyed.select(F.col("key").alias("k"), F.col("node").alias("b"), F.col("c").alias("d"))
    return keyed.join(two, (F.col("key") == F.col("k")) & (F.col("node") < F.col("b")) & (F.col("c") != F.col("d"))).select(F.col("node").alias("a"), "b")


def component_frame(firsts: DataFrame, docs: DataFrame, similarity: int) -> DataFrame | None:
    """node and comp of all nodes that have links; None if no band has two nodes. firsts: node, first, n_shingles, bands, low."""
    each = firsts.select("node", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.min("node").alias("l"), F.max("node").alias("m"), F.count(F.lit(1)).alias("size")).where("l < m").select("key", "size")
    live = stored(each.join(shared, "key").select("key", "node", "size").distinct())
    if live.isEmpty():
        return None
    wanted = live.groupBy("node").agg(F.sum("size").alias("weight"))
    sigs = stored(firsts.join(wanted, "node").select("node", "first", "n_shingles", "low", "weight").dropDuplicates(["node"]))
    ids = sigs.select(F.col("first").alias("doc_id")).distinct()
    few = sigs.count() <= BROADCAST_IDS
    full = stored(sets(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")), conf=BATCHES)

    def judged(pairs: DataFrame) -> DataFrame:
        one, two = (sigs.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("low").alias(f"low_{c}")) for c in ("a", "b"))
        likely = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).where(estimate(F.col("low_a"), F.col("low_b")) >= similarity / 100 - MARGIN)
        likely = stored(likely.select("a", "b"))
        out = stored(compared(likely, full, similarity).where("linked").select("a", "b"))
        dropped(likely)
        return out

    heaviest = F.max(F.struct("weight", F.xxhash64("node").alias("o"), "node")).alias("r")
    weighed = live.join(sigs.select("node", "weight"), "node")
    star = weighed.groupBy("key").agg(heaviest).select("key", F.col("r.node").alias("rep"))
    met = live.join(star, "key").where(F.col("node") != F.col("rep"))
    links = judged(met.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct())
    comp = components(links)
    dropped(links)
    keyed = live
    for k in range(ROUNDS + 1):
        now = stored(split(keyed.select("key", "node"), comp))
        dropped(keyed)
        large = now.where(F.col("size") > SMALL).select("key", "node")
        pairs, after, of_hubs = crossing(now.where(F.col("size") <= SMALL)), None, None
        gone = [now, comp]
        if not large.isEmpty():
            mass = shared_enough(large, full, similarity)
            again = stored(split(large.join(mass.select("node"), "node"), comp))
            gone += [mass, again]
            pairs = pairs.union(crossing(again.where(F.col("size") <= SMALL)))
            wide = again.where(F.col("size") > SMALL)
            if k == ROUNDS:
                pairs = pairs.union(crossing(wide))
            elif not wide.isEmpty():
                hubs = families(wide.select("key", "node"), mass, full, similarity)
                of_hubs = hubs.where("linked").select("a", "b")
                lacking = inside(hubs, similarity)
                after = stored(outside(hubs))
                pairs = pairs.union(lacking)
                gone += [hubs, lacking]
        links = judged(pairs.distinct())
        comp = merged(comp, links if of_hubs is None else links.union(of_hubs))
        for old in (*gone, links):
            dropped(old)
        if after is None:
            break
        keyed = after
    for old in (sigs, full):
        dropped(old)
    return comp


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Words lie between ASCII white space, A-Z in lower case. Links have 100 * intersection >= similarity * union.
    Documents without words, or without doc_id, are linked with nothing: their component is their own id, and they are
    kept. Rows repeat as in docs; rows that share a doc_id are told apart by their texts.
    """
    docs = docs.select("doc_id", "text")
    found = stored(sketches(docs), conf=BATCHES)
    linkable = found.where("node is not null and doc_id is not null")
    classes = stored(linkable.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")))
    firsts = linkable.join(classes, (linkable["node"] == classes["node"]) & (linkable["doc_id"] == classes["first"])).select(linkable["node"], "first", "n_shingles", "bands", "low")
    comp = component_frame(firsts, docs, similarity)
    group = classes.select("node", "first", "size", F.col("node").alias("c")) if comp is None else classes.join(comp, "node", "left").select("node", "first", "size", F.coalesce("comp", "node").alias("c"))
    least = group.groupBy("c").agg(F.min("first").alias("component"), F.sum("size").alias("docs")).where("docs > 1")
    to = stored(group.join(least, "c").select(F.col("node").alias("_node"), "component"))
    for old in (classes, comp):
        if old is not None:
            dropped(old)
    out = found.select("doc_id", "n_shingles", "node").join(to, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
