"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import decontaminate, flac, langid, lm, mixing, neardup, pii, secrets, sharding, substrings

random.seed(11)
VOCAB = [f"w{k}" for k in range(400)]
PASSAGE = " ".join(random.choice(VOCAB) for _ in range(60))
LONG = " ".join(random.choice(VOCAB) for _ in range(30_000))
TEXTS = [None, "", " \n ", "one", PASSAGE, PASSAGE, PASSAGE + " tail end", "start here " + PASSAGE, "mail a.b@c.de or x [at] y [dot] org", "x" * 50_000, LONG, "été ÀÉ Ünï", "token = 'abcdefABCDEF0123456'"]
ROWS = [(k, t, "en" if k % 2 else "fr", f"s{k % 3}" if k % 4 else None) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[4], ROWS[4], (None, PASSAGE, None, None), (None, None, None, None), (6, "another text of the same id", "en", "s1")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("spans", "score", "size", "n_words", "items", "media_bytes", "taken", "node", "last", "_size", "_source", "h", "_id", "_starts", "_key", "_k", "_p", "key", "starts", "grp", "part", "label", "bucket", "c0", "c1", "n_", "token", "bands")})


def test_pii(docs, none):
    rows = pii.find_pii(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [s[:3] for s in pii.scan(r["text"])]
    assert [s[4] for s in pii.scan(TEXTS[8])] == ["a.b@c.de", "x@y.org"]
    assert pii.find_pii(none).count() == 0


def test_pii_base_equals_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    rng = random.Random(2)
    for alphabet in ("a1.@- +()", "01. -+()@a%"):
        for _ in range(3000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            expected = [(k, *m.span()) for k in pii.KINDS for m in re.finditer(plain[k], s) if good[k](m[0])]
            assert [x[:3] for x in pii.scan(s) if x[3]] == expected, s


def test_secrets(docs, none):
    assert secrets.find_secrets(clash(docs)).count() == len(ROWS)
    assert secrets.find_secrets(none).count() == 0
    assert [x[0] for x in secrets.scan(TEXTS[12])] == ["assign"]
    assert [x[0] for x in secrets.scan("password: Tr0ub4dor&3")] == ["password"]
    assert not secrets.scan("password: password1") and not secrets.scan("The password is required.")
    assert secrets.guesses("aaaaaaaa") < secrets.guesses("qwertyui") < secrets.guesses("x7#Kq9!z")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DB_PASSWORD=Tr0ub4dor&3xq9", "Tr0ub4dor&3xq9"),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENGbPxRfiCYzz", "wJalrXUtnFEMI/K7MDENGbPxRfiCYzz"),
        ("db_password: 'p@ss w0rd!Zq81'", "p@ss w0rd!Zq81"),
        ("client_secret=a!b#c$d%9Kq2", "a!b#c$d%9Kq2"),
        ("pwd: xqzvkjwpmtr", "xqzvkjwpmtr"),
        ("mysql.pass=zq!7Kd#x", "zq!7Kd#x"),
        ("dbPass = zq!7Kd#x.", "zq!7Kd#x"),
        ("the api key is zq!7Kd#x, keep it", "zq!7Kd#x"),
    ],
)
def test_secrets_of_compound_names(text, value):
    assert [x[4] for x in secrets.scan(text)] == [value]


def test_secrets_leave_other_words():
    for text in ("author: Jonathan Xq7!kzzw", "opinion = Zq81!xkw", "compass: northwest9!x", "The secretary: Xq7!kzzw", "The password is required.", "token:", "x" * 50_000, "pass" * 20_000):
        assert not secrets.scan(text), text


def naive_guesses(value, rank):
    """The least price over all ways to cut the value into segments, each priced from what it is alone."""
    step, low = math.log10(2), value.lower()
    plain = low.translate(secrets.LEET)

    def price(i, j):
        part, n = value[i:j], j - i
        prices = []
        if found := rank.get(low[i:j]) or rank.get(plain[i:j]):
            prices.append(math.log10(found + 1) + step * (part != low[i:j]) + step * (low[i:j] not in rank))
        if secrets.DATE.fullmatch(part):
            prices.append(4.6 if n > 4 else 2.1)
        if n >= 3 and len(set(part)) == 1:
            prices.append(math.log10(secrets.pool(part[0]) * n))
        if n >= 3 and all(low[k : k + 2] in secrets.WALKS for k in range(i, j - 1)):
            prices.append(math.log10(47 * n * 4))
        prices += [sum(math.log10(secrets.pool(c)) for c in part[:b]) + math.log10(n // b) for b in (2, 3, 4) if n % b == 0 and n // b >= 3 and part == part[:b] * (n // b)]
        found = min(prices, default=math.inf) + (step if i else 0)
        return min(found, math.log10(secrets.pool(part))) if n == 1 else found

    if not value:
        return 0.0
    cuts = itertools.product((False, True), repeat=len(value) - 1)
    ends = ([0, *(k for k, cut in enumerate(c, 1) if cut), len(value)] for c in cuts)
    return min(sum(price(i, j) for i, j in itertools.pairwise(e)) for e in ends)


def test_guesses_equal_all_segmentations():
    rng = random.Random(6)
    rank = {"pass": 1, "word": 2, "password": 3, "ss": 4, "sword": 5, "one": 9}
    pieces = ["pass", "p@55", "Word", "aaa", "qwe", "1999", "3112", "abab", "99", "x", "7#", "onE", "Q"]
    for value in ["", "password", "aaaaaa", "abababab", "19991231", *("".join(rng.choice(pieces) for _ in range(4))[:12] for _ in range(40))]:
        assert secrets.guesses(value, rank) == pytest.approx(naive_guesses(value, rank)), value


def test_vocabulary_prices_plain_words(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {"qu</w>": 1, "correct</w>": 2, "horse": 3, "required</w>": 4, "password</w>": 5}}}))
    rank = secrets.ranks(str(tmp_path / "v.json"))
    assert list(rank)[:2] == ["password", "123456"] and len(rank) == len(set(secrets.COMMON)) + 2 and "horse" not in rank
    docs = spark.createDataFrame([(1, "password: required"), (2, "password: kvxwqzjm")], "doc_id long, text string")
    found = {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(docs, vocabulary=str(tmp_path / "v.json")).collect()}
    assert found == {1: 0, 2: 1}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(7)
    for _ in range(30):
        count = rng.integers(0, 6, 4)
        scores = rng.integers(-6, 1, (5, 3)).astype(np.float32) * 1.37 - rng.random((5, 3), dtype=np.float32)
        code = rng.integers(0, 5, int(count.sum()))
        first = np.cumsum(count) - count
        got = langid.viterbi(scores, code, first, count, 2.5)

        def worth(path, words):
            return sum(float(scores[w, k]) for w, k in zip(words, path, strict=True)) - 2.5 * sum(a != b for a, b in itertools.pairwise(path))

        for f, c in zip(first, count, strict=True):
            words = code[f : f + c]
            assert worth(got[f : f + c], words) == pytest.approx(max(worth(p, words) for p in itertools.product(range(3), repeat=int(c))), abs=1e-4)


def test_language(docs, none):
    rng = random.Random(4)
    sets = {"en": ["the", "with", "which", "house", "think"], "de": ["der", "nicht", "zwischen", "haus", "über"], "ru": ["это", "который", "дом"]}
    text = lambda lang, n: " ".join(rng.choice(sets[lang]) for _ in range(n))
    model = langid.Model.fitted([(lang, text(lang, 200)) for lang in sets for _ in range(5)])
    rows, labels, first = langid.label(model, [text("de", 40), text("en", 30) + " " + text("de", 60), text("ru", 5), "123 !!", ""])
    assert [r[0] for r in rows] == ["de", "de", "ru", "und", "und"]
    mixed = labels[first[1] : first[2]]
    assert (mixed[:28] == 1).all() and (mixed[-58:] == 0).all()
    out = langid.identify(clash(docs), langid.fit(docs), spans=True).collect()
    assert len(out) == len(ROWS) and all(r["lang_pred"] == "und" for r in out if not r["text"] or not langid.LETTER.search(r["text"]))
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, none):
    rows = mixing.mix(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["size"] == len(words_of(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
    by = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(t <= 3 * s + 1e-6 for t, s in by.values())
    assert mixing.mix(none).count() == 0


def test_subset_sum_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 100)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        took = mixing.subset_sum(lengths, counts, budget)
        assert all(t <= c for t, c in zip(took, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, took, strict=True)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("window", [1, 8, 10_000])
def test_fit_comes_nearest(window):
    rng = random.Random(8)
    for _ in range(200):
        lengths = np.array(rng.sample(range(1, 40), 4)) * rng.choice((1, 3))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) - 1)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        took = mixing.fit(lengths, counts, budget, window)
        assert (took >= 0).all() and (took <= counts).all()
        assert int((took * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_of_many_lengths():
    rng = np.random.default_rng(9)
    lengths, counts = np.arange(1, 20_001), rng.integers(1, 2_000, 20_000)
    budget = int((lengths * counts).sum()) // 3
    took = mixing.fit(lengths, counts, budget)
    assert (took <= counts).all() and int((took * lengths).sum()) == budget


def test_sharding(docs, none):
    rows = sharding.shard_documents(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(8)) and max(map(len, slots.values())) - min(len(slots.get(b, ())) for b in range(8)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] == 0)
    assert sharding.shard_documents(none).count() == 0


def test_sharding_keeps_groups(spark):
    rows = [(k, f"text {k // 3}") for k in range(240)] + [(1000 + k, "hot") for k in range(200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    small = {zlib.crc32(f"text {k}".encode()) for k in range(80)}
    assert sum(len(shards[c]) > 1 for c in small) <= 8
    assert len(shards[zlib.crc32(b"hot")]) <= 6


@pytest.mark.parametrize("hot", (2_000, 4))
def test_label_propagation_cuts_few_edges(spark, monkeypatch, hot):
    """Groups of 2 to 40 and as many rows without links: no edge is cut, counts are even, and the first labels cut most."""
    from pyspark.sql import functions as F

    from tracewell.llm.common import stored

    monkeypatch.setattr(sharding, "HOT", hot)
    rows = [(k, f"g{g}") for g in range(60) for k in range(g * 40, g * 40 + 2 + g % 39)]
    rows += [(10_000 + k, None) for k in range(len(rows))]
    nodes = stored(spark.createDataFrame(rows, "id long, grp string").withColumn("h", F.xxhash64("id")).repartition(3))
    out = sharding.label_propagation(nodes)
    assert out.count() == len(rows)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    edges = sum((2 + g % 39) * (1 + g % 39) // 2 for g in range(60))
    assert tuple(sharding.cut_edges(out).first()) == (edges, 0)
    first = sharding.cut_edges(nodes.withColumn("shard", F.pmod("h", F.lit(8)))).first()
    assert first["cut"] > edges / 2


def test_language_model(docs, none):
    rows = lm.score(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["n_tokens"] >= 1 and r["n_known"] <= r["n_tokens"] and r["score"] < 0 and r["base_score"] < 0
    assert lm.score(none).count() == 0


@pytest.mark.parametrize("frequent", (131_072, 40))
def test_base_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(9)
    rows = [(k, None if k % 13 == 5 else " ".join(rng.choice(("W%d", "w%d", "é%d")) % int(rng.paretovariate(0.6)) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    tokens = {k: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in rows}
    trains = {k: zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows}
    counts = Counter(w for k, ws in tokens.items() if trains[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (not trains[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own))


def test_language_model_learns_from_all_training_tokens(spark):
    n = 210_000  # characters, far beyond any prefix; both corpora have the same counts and the same beginning
    head, tails = "x " * 1_500, ("a b " * (n // 4), "a a b b " * (n // 8))
    asked = [(2, "a b " * 50)]
    scores = []
    for tail in tails:
        docs = spark.createDataFrame([(k, head + tail) for k in range(4)] + asked, "doc_id long, text string")
        scores.append(lm.score(docs).where("n_tokens = 101").first()["score"])
    assert scores[0] > scores[1] + 10

    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(30 * k))) for k in range(60)]
    numbers = lambda t: np.array([*(2 + int(w[1:]) for w in t.decode().split()), 1])
    learned = [lm.learn(lm.GatedModel(100), spark.createDataFrame(r, "doc_id long, text string").repartition(p), 2_000_000, numbers, 1) for r, p in ((rows, 1), (rows[::-1], 5))]
    assert learned == [sum(30 * k + 1 for k in range(60))] * 2
    assert lm.vocabulary(10**6) < lm.vocabulary(10**8) < lm.vocabulary(10**9)


def test_gradients_equal_differences():
    model = lm.GatedModel(100, hidden=5)
    model.start(np.ones(100))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y, h = rng.integers(0, 100, (6, 4)), rng.integers(0, 100, (6, 4)), rng.standard_normal((5, 4)) * 0.3
    d, _, _ = model.gradients(x, y, h)
    for k, v in model.p.items():
        flat, i = v.ravel(), int(np.abs(d[k]).argmax())
        old, near = flat[i], []
        for e in (1e-5, -1e-5):
            flat[i] = old + e
            near.append(model.gradients(x, y, h)[2])
        flat[i] = old
        assert d[k].ravel()[i] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-4)


def test_windows_carry_state():
    model, rng = lm.GatedModel(300), np.random.default_rng(1)
    seqs = [rng.integers(0, 300, n) for n in (1, 63, 64, 65, 200)]
    whole = model.score(seqs, 1)
    start = model.step(model.p["E"][[1]].T, np.zeros((lm.HIDDEN, 1), dtype=np.float32))[0]
    for s, got in zip(seqs, whole, strict=True):
        state, total = start, 0.0
        for w in s:
            total += model.log_probs(state.T, np.array([w]))[0]
            state = model.step(model.p["E"][[w]].T, state)[0]
        assert got == pytest.approx(total / np.log(10), rel=1e-4)


def test_probabilities_sum_to_one():
    model = lm.GatedModel(60, edges=lm.edges_of(1000.0 / np.arange(1, 61)))
    model.start(1000.0 / np.arange(1, 61))
    h = np.repeat(np.random.default_rng(2).standard_normal((1, lm.HIDDEN)).astype(np.float32), 60, axis=0)
    assert np.exp(model.log_probs(h, np.arange(60))).sum() == pytest.approx(1, rel=1e-4)
    assert sorted(np.diff(model.edges)) == np.diff(model.edges).tolist()


def jaccard_components(rows, similarity=85):
    sets = {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and (n := len(sets[i] & sets[j])) and 100 * n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, none):
    rows = neardup.near_duplicates(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert all(r["kept"] for r in rows if not r["n_shingles"])
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 7)} == {4}
    assert neardup.near_duplicates(none).count() == 0


def edited(rng, base, k):
    """Copies of base with words replaced, some from a few shared words, some cut at the end or copies of a copy."""
    out = [list(base)]
    for _ in range(k):
        w = list(out[rng.randrange(len(out))]) if rng.random() < 0.3 else list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}" if rng.random() < 0.3 else f"n{rng.random()}"
        if rng.random() < 0.3:
            w = w[: int(len(w) * rng.choice((0.97, 0.95, 0.9, 0.86)))]
        out.append(w)
    return out[1:]


@pytest.mark.parametrize(("small", "rounds", "similarity"), [(4, 8, 85), (2, 8, 80), (2, 1, 85)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, rounds, similarity):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(110)]
    line = [rng.choice(VOCAB) for _ in range(30)]
    texts = edited(rng, base, 150) + [[f"u{rng.random()}" for _ in range(40)] + line for _ in range(40)]
    rows = [(k * 7 % 190, " ".join(w)) for k, w in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity).collect()}
    assert got == jaccard_components(rows, similarity)


def test_large_family_gives_few_pairs(spark, monkeypatch):
    """A family of 2,000 near copies: nearly all pairs are ruled out without being named, and the groups are those of brute force."""
    rng = np.random.default_rng(3)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(2_000):
        w = np.array(base, dtype=object)
        at = rng.choice(150, rng.integers(0, 9), replace=False)
        w[at] = [f"e{x}" for x in rng.integers(0, 3_000, len(at))]
        rows.append((k, " ".join(w)))
    named = []

    def counted(pairs, full, similarity, plain=neardup.compared):
        named.append(pairs.count())
        return plain(pairs, full, similarity)

    monkeypatch.setattr(neardup, "compared", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(named) < 20 * len(rows)
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (t.split() for _, t in rows)]
    times = Counter(x for own in sets for x in own)
    columns = {x: k for k, x in enumerate(x for x, n in times.items() if n > 1)}
    has = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for i, own in enumerate(sets):
        has[i, [columns[x] for x in own if x in columns]] = 1
    inter, sizes = has @ has.T, np.array([len(x) for x in sets])
    root = list(range(len(sets)))
    for i, j in zip(*np.nonzero(np.tril(100 * inter >= 85 * (sizes[:, None] + sizes - inter), -1)), strict=True):
        a, b = int(i), int(j)
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("segments", (5_000, 1))
def test_substrings(docs, none, monkeypatch, segments):
    monkeypatch.setattr(substrings, "SEGMENTS", segments)
    rows = substrings.remove_repeats(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    least = {}
    for i, t, *_ in ROWS:
        w = words_of(t)
        for s in range(len(w) - 12):
            g = tuple(w[s : s + 13])
            least[g] = min(least.get(g, substrings.LAST), substrings.LAST if i is None else i)
    for r in rows:
        w, gone = words_of(r["text"]), set()
        own = substrings.LAST if r["doc_id"] is None else r["doc_id"]
        for s in range(len(w) - 12):
            if least[tuple(w[s : s + 13])] < own:
                gone |= set(range(s, s + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert substrings.remove_repeats(none).count() == 0


def test_flac(docs, none):
    rows = flac.store_flac(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        n, padded = flac.payload(r["text"])
        assert r["n_bytes"] == n and r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and b"".join(b["pcm"] for b in r["blocks"]) == padded
    assert flac.store_flac(none).count() == 0


@pytest.mark.parametrize(("partitions", "general"), [(0, False), (2, False), (3, True)])
def test_flac_round_trip(partitions, general):
    rng = random.Random(1)
    pay = [bytes(rng.choice(b"ab c") for _ in range(192 * k)) for k in range(1, 9)] + [b" " * 192, bytes(range(256)) * 6, rng.randbytes(3000), bytes(int(128 + 100 * np.sin(i / 20)) for i in range(5000))]
    streams = flac.encode(pay, partition_order=partitions, general=general)
    back = [b"".join((b[2] + 128).astype(np.uint8).tobytes() for b in x) for x in flac.decode(streams)]
    assert back == pay
    bad = bytearray(streams[2])
    bad[-20] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])


@pytest.mark.parametrize(("windows", "hot"), [(100_000, 2_000), (0, 2_000), (0, 3)])
def test_decontamination(spark, docs, none, monkeypatch, windows, hot):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    monkeypatch.setattr(decontaminate, "HOT", hot)
    items = [(1, PASSAGE[:120]), (1, PASSAGE[:120]), (2, "one"), (3, None), (None, "tail end"), (4, "no such words here"), (5, "W1"), (6, "w1 " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(clash(docs), bench).collect()
    assert len(rows) == len(ROWS)
    cut = set()
    for i, t in items:
        w = [x for x in re.split(decontaminate.BETWEEN, (t or "").lower()) if x]
        cut |= {(i, tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12)) if w}
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        w = [x for x in re.split(decontaminate.BETWEEN, low) if x]
        hit, there = set(), set()
        for i, x in cut:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    there |= {str(i)} if i is not None else set()
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(there))
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w)) and r["spans"] == "mine"
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    shards = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(shards) - min(shards) <= 1
