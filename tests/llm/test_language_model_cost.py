"""The language model's words, sums and portions against plain forms, and what its sums may cost beside them."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import lm

TEXTS = [None, "", " ", "a", "\n\tA b\x0b\x0cb\r ", "É é x \x1cy\x85 z z", "W\x00x  Ünder", "x" * 70_000, " the THE tHe\n"]


def test_words_equal_bytes_split():
    words, text = lm.words_of(pa.array(TEXTS, pa.string()))
    found = [[w.encode() for w, k in zip(words.to_pylist(), text, strict=True) if k == n] for n in range(len(TEXTS))]
    assert found == [(t or "").encode().lower().split() for t in TEXTS]
    assert len(lm.words_of(pa.array([None], pa.string()))[0]) == 0


def test_portions_are_bounded(monkeypatch):
    monkeypatch.setattr(lm, "TEXTS", 4)
    monkeypatch.setattr(lm, "PORTION", 100)
    texts = [None, *("x" * (k * 7 % 60) for k in range(50)), "y" * 1_000, *[""] * 9]
    parts = [p.to_pylist() for p in lm.portions(pa.array(texts, pa.string()))]
    assert [t for p in parts for t in p] == texts and max(map(len, parts)) <= 4
    assert all(sum(len(t or "") for t in p) - max(len(t or "") for t in p) <= 100 for p in parts)
    assert list(lm.portions(pa.array([], pa.string()))) == []


def test_token_counts_in_parts(spark, monkeypatch):
    expected = Counter(w for t in TEXTS for w in [*(t or "").encode().lower().split(), lm.END.encode()])
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for flush in (1, 4_000_000):
        monkeypatch.setattr(lm, "FLUSH", flush)
        assert {r["token"].encode(): r["n"] for r in lm.token_counts(docs).collect()} == expected


def drawn(most):
    rng = np.random.default_rng(4)
    return np.minimum(rng.zipf(1.3, 16_384), most) - 1, rng.standard_normal((16_384, 48)).astype(np.float32)


def plain(v, words):
    order = np.argsort(words, kind="stable")
    rows, first = np.unique(words[order], return_index=True)
    return rows, np.add.reduceat(v[order], first)


@pytest.mark.parametrize("most", (1, 3, 10_000, 100_000))
def test_sums_by_word(most):
    words, v = drawn(most)
    rows, sums = lm.sums_by_word(v, words)
    expected = np.zeros((most, v.shape[1]))
    np.add.at(expected, words, v)
    assert rows.tolist() == sorted(set(words.tolist()))
    assert np.allclose(sums, expected[rows], atol=1e-2)


def fastest(f, *args):
    took = []
    for _ in range(15):
        before = time.process_time()
        f(*args)
        took.append(time.process_time() - before)
    return min(took)


def test_sums_by_word_cost_less_than_plain_ones():
    words, v = drawn(10_000)
    assert fastest(lm.sums_by_word, v, words) < 0.9 * fastest(plain, v, words)


def test_scores_do_not_depend_on_portions_or_states(spark, monkeypatch):
    rows = [(k, None if k % 11 == 3 else " ".join(f"w{(k * j * j) % 101}" for j in range((k * 37) % 150))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def scores():
        return {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.score(docs).collect()}

    whole = scores()
    for name, size in (("PORTION", 500), ("STATES", 7), ("TEXTS", 3)):
        monkeypatch.setattr(lm, name, size)
    for k, got in scores().items():
        assert got == pytest.approx(whole[k], rel=1e-5)


def test_bounds_hold_between_their_reckonings(monkeypatch):
    model, rng = lm.GatedModel(300), np.random.default_rng(5)
    window, reckon, given, reckoned = model.window, model.bounds, [], []
    monkeypatch.setattr(model, "window", lambda x, y, h, bounds: given.append((bounds, reckon())) or window(x, y, h, bounds))
    monkeypatch.setattr(model, "bounds", lambda: reckoned.append(1) or reckon())
    square = {k: np.full_like(v, 1e-6) for k, v in model.p.items()}
    seen = model.train([rng.integers(1, 300, 2_000) for _ in range(30)], square, 4, 1)
    assert seen.sum() == 60_000 and len(reckoned) < len(given) / 5
    assert all(b >= t for bounds, true in given for b, t in zip(bounds, true, strict=True))


def test_training_takes_texts_or_a_vocabulary(spark):
    rows = [(k, None if k % 7 == 1 else " ".join(f"W{(k * j) % 50}" for j in range(9 * k))) for k in range(40)]
    docs, names = spark.createDataFrame(rows, "doc_id long, text string"), [lm.END, *(f"w{k}" for k in range(40))]
    number = {t.encode(): k + 1 for k, t in enumerate(names)}
    models = lm.GatedModel(60), lm.GatedModel(60)
    as_texts = lm.learn(models[0], docs, 2_000_000, lambda t: np.array([*(number.get(w, 0) for w in t.lower().split()), 1]), 1)
    assert lm.learn(models[1], docs, 2_000_000, pa.array(names), 1) == as_texts
    assert all(np.array_equal(models[0].p[k], models[1].p[k]) for k in models[0].p)
