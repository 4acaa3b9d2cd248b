"""Scoring by a gated recurrent language model.

Counts of all training tokens give the base score and the probability of words outside the model's vocabulary, which
grows with the root of the training tokens. The model is a gated recurrent unit in numpy; its output is a softmax over
classes of words and one within the class. It learns from every token of every training document: executors train on
shards of whole texts by backpropagation through windows with the state carried over, and the weights of a round's
shards are averaged. Whole documents are scored in windows, many at once, each with its state carried from window to
window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, dropped, stored, table

#: The end of a document, which no word can be; the word for all that aren't in the vocabulary has number 0.
END = " "
#: Words of the model at least (it has the root of the training tokens beyond that); tokens whose counts are broadcast (about 100 bytes each).
VOCABULARY, FREQUENT = 2024, 131_072
HIDDEN = 16
#: Training: lanes at least and at most, tokens of a lane in a block, window, tokens that a small corpus is repeated for, passes at most, step size.
LANES, MOST_LANES, STRETCH, WINDOW, ENOUGH, EPOCHS, RATE = 32, 1024, 512, 16, 1_600_000, 4, 0.1
#: Rounds of a pass, each over its own documents and followed by an average; roots of training tokens for each shard; numbers in a row of weights.
ROUNDS, ROOTS, SLICE = 3, 240, 8_192
SEED = 7
#: Words that are counted at once, from which their counts go to the shuffle.
FLUSH = 4_000_000
#: Texts and bytes of texts that are scored side by side at most.
TEXTS, PORTION = 2_500, 10_000_000
#: Logits up to which exp is far from the ends of 32-bit floats.
SAFE = 60.0
#: Added where a probability's own factor may have made it 0.
TINY = 1e-37
#: States whose next words are priced at once.
STATES = 8_192
#: States whose gradients of classes are found at once, in what the cache holds.
PIECE = 4_096
#: Rows of a word beyond which they are summed at once, not side by side with those of other words.
SINGLY = 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def edges_of(counts: np.ndarray) -> np.ndarray:
    """Where classes of words begin: equal parts of the sum of the counts' roots, about half the root of the words many."""
    sums = np.cumsum(np.sqrt(counts + 1.0))
    parts = max(1, math.isqrt(len(counts)) // 2)
    return np.unique([0, *(np.searchsorted(sums, sums[-1] * k / parts) + 1 for k in range(1, parts)), len(counts)])


def exponentials(a: np.ndarray, bound: float) -> np.ndarray:
    """exp of each column of a, in place, up to a factor of the column's own; bound is at least every |a|: where exp can't overflow, the factor is 1."""
    if bound > SAFE:
        a -= a.max(axis=0)
    return np.exp(a, out=a)


def sorted_by(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of numbers up to `most`, and the places in it where each distinct one begins."""
    order = np.argsort(values.astype(np.uint16) if most < 65_536 else values, kind="stable")
    found = values[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), dtype=bool), found[1:] != found[:-1]]))


def sums_by_word(v: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, ascending, and for each the sum of its rows of v."""
    order, first = sorted_by(words, int(words.max(initial=0)))
    rows, v, count = words[order[first]], v.take(order, axis=0), np.diff(first, append=len(order))
    by = np.argsort(-count, kind="stable")
    first, count, out = first[by], count[by], np.empty((len(rows), v.shape[1]), dtype=v.dtype)
    many = int(np.searchsorted(-count, -SINGLY, side="left"))
    one = np.ones(len(order), dtype=v.dtype)
    for w, i, n in zip(by[:many].tolist(), first[:many].tolist(), count[:many].tolist(), strict=True):
        np.matmul(one[:n], v[i : i + n], out=out[w])
    first, count, total = first[many:], count[many:], v.take(first[many:], axis=0)
    for k in range(1, int(count[0]) if len(count) else 0):
        more = int(np.searchsorted(-count, -k, side="left"))
        total[:more] += v.take(first[:more] + k, axis=0)
    out[by[many:]] = total
    return rows, out


class GatedModel:
    """Words have numbers; those from edges[c] to edges[c + 1] are a class, frequent words being in small classes.

    States and inputs of steps are (features, lanes), so that gates lie side by side in memory; logits are (words, states).
    The last row of Wc and the last column of Wo are biases.
    """

    def __init__(self, size: int, seed: int = SEED, hidden: int = HIDDEN, edges: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.size, self.hidden = size, hidden
        self.edges = edges_of(np.ones(size)) if edges is None else edges
        self.classes = len(self.edges) - 1
        self.class_of = np.repeat(np.arange(self.classes), np.diff(self.edges))
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"E": f(size, 3 * hidden), "U": f(hidden, 3 * hidden), "Wc": np.concatenate([f(hidden, self.classes), f(1, self.classes) * 0]), "Wo": np.concatenate([f(size, hidden), f(size, 1) * 0], axis=1)}

    def start(self, counts: np.ndarray) -> None:
        """Output biases by counts of the vocabulary."""
        logs = np.log(counts + 1.0)
        total = np.logaddexp.reduceat(logs, self.edges[:-1])
        self.p["Wo"][:, -1] = logs - total[self.class_of]
        self.p["Wc"][-1] = total - total.max()

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        n = self.hidden
        g = self.p["U"].T @ h
        gates = sigmoid(x[: 2 * n] + g[: 2 * n])
        z, r = gates[:n], gates[n:]
        c = r * g[2 * n :]
        c += x[2 * n :]
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        return after, z, r, c, g[2 * n :]

    def first(self, end: int) -> np.ndarray:
        """The state after an end, (features, 1)."""
        return self.step(self.p["E"][[end]].T, np.zeros((self.hidden, 1), dtype=np.float32))[0]

    def by_class(self, ys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of ys by class, and for each class of several words that is there: its first and last word, and first and last place in the order."""
        cls = self.class_of[ys]
        order, at = sorted_by(cls, self.classes)
        there, edges = cls[order[at]], self.edges
        return order, [(int(edges[c]), int(edges[c + 1]), int(i), int(j)) for c, i, j in zip(there, at, [*at[1:], len(order)], strict=True) if edges[c + 1] - edges[c] > 1]

    def bounds(self) -> tuple[float, float]:
        """What the logits of classes and of words can be at most, states being in -1 to 1."""
        return tuple(float(np.abs(w).sum(axis=axis).max()) for w, axis in ((self.p["Wc"], 0), (self.p["Wo"], 1)))

    def log_probs(self, h: np.ndarray, y: np.ndarray, bounds: tuple[float, float] | None = None) -> np.ndarray:
        """Natural log of the probability of each next word after each state; h is (words, features)."""
        return self.priced(np.concatenate([h.T, np.ones((1, len(h)), dtype=h.dtype)]), y, bounds or self.bounds())

    def priced(self, h: np.ndarray, y: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
        """As log_probs(); h is (features, words), with a row of ones below."""
        of_class, of_word = bounds
        order, spans = self.by_class(y)
        hi, word = h.take(order, axis=1), y[order]
        cls, at = self.class_of[word], np.arange(len(y))
        a = exponentials(self.p["Wc"].T @ hi, of_class)
        own, sums = a[cls, at], a.sum(axis=0)
        local, own_word, sums_word = word - self.edges[cls], np.ones_like(own), np.ones_like(sums)
        for first, last, i, j in spans:
            b = exponentials(self.p["Wo"][first:last] @ hi[:, i:j], of_word)
            own_word[i:j] = b[local[i:j], at[: j - i]]
            b.sum(axis=0, out=sums_word[i:j])
        out = np.empty_like(own)
        out[order] = np.log(own + TINY) - np.log(sums) + np.log(own_word + TINY) - np.log(sums_word)
        return out

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, bounds: tuple[float, float] | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss of one window (steps, lanes), each with the rows it has (None for all); y < 0 is not counted.

        Also the state after the window and the loss. h is (features, lanes).
        """
        p, n = self.p, self.hidden
        steps, kept = len(x), []
        inputs = np.ascontiguousarray(p["E"].take(x, axis=0).transpose(0, 2, 1))
        states = np.ones((n + 1, *x.shape), dtype=inputs.dtype)
        for t in range(steps):
            before = h
            h, z, r, c, g = self.step(inputs[t], h)
            kept.append((before, z, r, c, g))
            states[:n, t] = h
        ys = y.ravel()
        on = np.flatnonzero(ys >= 0)
        count = max(1, len(on))
        order, spans = self.by_class(ys[on])
        order = on[order]
        hi, word = states.reshape(n + 1, -1).take(order, axis=1), ys[order]
        cls, at = self.class_of[word], np.arange(len(word))
        of_class, of_word = bounds or self.bounds()
        loss, d, dh_own = 0.0, {"Wc": (None, np.zeros_like(p["Wc"]))}, np.empty((n, len(word)), dtype=hi.dtype)
        for i in range(0, len(word), PIECE):
            s = hi[:, i : i + PIECE]
            a = exponentials(p["Wc"].T @ s, of_class)
            place, total = (cls[i : i + PIECE], at[: a.shape[1]]), a.sum(axis=0)
            loss -= float(np.log(a[place] / total + 1e-12).sum())
            a *= 1 / (total * count)
            a[place] -= 1 / count
            np.add(d["Wc"][1], s @ a.T, out=d["Wc"][1])
            np.matmul(p["Wc"][:n], a, out=dh_own[:, i : i + PIECE])
        local, own, sums, wo = word - self.edges[cls], np.ones(len(word), dtype=hi.dtype), np.ones(len(word), dtype=hi.dtype), []
        for first, last, i, j in spans:
            w, s = p["Wo"][first:last], hi[:, i:j]
            b = exponentials(w @ s, of_word)
            place = (local[i:j], at[: j - i])
            own[i:j] = b[place]
            total = b.sum(axis=0, out=sums[i:j])
            b *= 1 / (total * count)
            b[place] -= 1 / count
            wo.append(b @ s.T)
            dh_own[:, i:j] += w[:, :n].T @ b
        loss -= float(np.log(own / sums + 1e-12).sum())
        if spans:
            d["Wo"] = (np.concatenate([np.arange(first, last) for first, last, _, _ in spans]), np.concatenate(wo))
        back = np.full(len(ys), len(order))
        back[order] = at
        dh_out = np.concatenate([dh_own, np.zeros((n, 1), dtype=dh_own.dtype)], axis=1).take(back, axis=1).reshape(n, *x.shape)
        dh, du = np.zeros_like(h), np.zeros_like(p["U"])
        dxs = np.empty(inputs.shape, inputs.dtype)
        for t in reversed(range(steps)):
            before, z, r, c, g = kept[t]
            dh += dh_out[:, t]
            dx = dxs[t]
            dz, dr, dc = dx[:n], dx[n : 2 * n], dx[2 * n :]
            keep = dh * z
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            np.subtract(before, c, out=dz)
            dz *= keep
            np.subtract(dh, keep, out=dh)
            dc *= dh
            np.subtract(1, z, out=z)
            dz *= z
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= g
            dr *= dc
            dg = dx.copy()
            dg[2 * n :] *= r
            du += before @ dg.T
            dh = p["U"] @ dg
            dh += keep
        flat = np.ascontiguousarray(dxs.transpose(0, 2, 1)).reshape(len(ys), -1)
        d |= {"U": (None, du), "E": sums_by_word(flat, x.ravel())}
        return d, h, loss / count

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """As window(), with gradients in the shapes of the weights."""
        d, h, loss = self.window(x, y, h)
        whole = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k, (rows, g) in d.items():
            whole[k][... if rows is None else rows] = g
        return whole, h, loss

    def train(self, docs: Iterable[np.ndarray], square: dict[str, np.ndarray], lanes: int, end: int) -> np.ndarray:
        """Adagrad over all numbers of docs, each of which ends with `end`; gives how often each word was learned.

        The documents follow each other in blocks, whose equal parts are the lanes; `square` is the sum of squares so far.
        """
        seen, before, bounds = np.zeros(self.size, dtype=np.int64), end, self.bounds()

        def block(flat: np.ndarray, before: int) -> None:
            nonlocal bounds
            most = -(-len(flat) // lanes)
            y = np.full(most * lanes, -1, dtype=np.int64)
            y[: len(flat)] = flat
            x = np.concatenate([[before], np.maximum(y[:-1], 0)]).reshape(lanes, most).T
            y, h = y.reshape(lanes, most).T, np.zeros((self.hidden, lanes), dtype=np.float32)
            for t in range(0, most, WINDOW):
                if max(bounds) > SAFE:
                    bounds = self.bounds()
                d, h, _ = self.window(x[t : t + WINDOW], y[t : t + WINDOW], h, bounds)
                bounds = tuple(b + (self.hidden + 1) * RATE for b in bounds)  # no weight moves further in a step
                for k, (rows, g) in d.items():
                    at = ... if rows is None else rows
                    np.clip(g, -1, 1, out=g)
                    q = g * g
                    q += square[k][at]
                    square[k][at] = q
                    np.sqrt(q, out=q)
                    g *= RATE
                    g /= q
                    self.p[k][at] -= g
            np.add(seen, np.bincount(flat, minlength=self.size), out=seen)

        held, n = [], 0
        for doc in docs:
            held.append(doc)
            n += len(doc)
            if n >= lanes * STRETCH:
                flat, at = np.concatenate(held), 0
                while n - at >= lanes * STRETCH:
                    block(flat[at : at + lanes * STRETCH], before)
                    at += lanes * STRETCH
                    before = int(flat[at - 1])
                held, n = [flat[at:]], n - at
        if n:
            block(np.concatenate(held), before)
        return seen

    def shares(self, seen: np.ndarray) -> dict[str, np.ndarray | float]:
        """What a shard's weights count in an average, by how often it learned each word."""
        of_class, total = np.add.reduceat(seen, self.edges[:-1])[self.class_of].astype(np.float64), float(seen.sum())
        return {"E": np.asarray(seen, dtype=np.float64)[:, None], "U": total, "Wc": total, "Wo": of_class[:, None]}

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """log10 of the probability of each document's numbers, which end with `end`; the state begins as after an end."""
        count = np.array([len(d) for d in docs], dtype=np.int64)
        order = np.argsort(-count, kind="stable")
        flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, dtype=np.int64)
        count = count[order]
        first = np.cumsum(count) - count
        live = np.searchsorted(-count, -np.arange(int(count[0]) if len(count) else 0), side="left")
        ends = np.cumsum(live)
        lane = np.arange(len(flat)) - np.repeat(ends - live, live)
        flat = flat[first[lane] + np.repeat(np.arange(len(live)), live)]  # step by step
        h = np.repeat(self.first(end), len(docs), axis=1)
        inputs, bounds = np.ascontiguousarray(self.p["E"].T), self.bounds()
        out = np.zeros(len(docs))
        t, done = 0, 0
        while t < len(live):
            word = flat[done : ends[min(np.searchsorted(ends, done + STATES), len(ends) - 1)]]
            x, states, i = inputs.take(word, axis=1), np.ones((self.hidden + 1, len(word)), dtype=h.dtype), 0
            while i < len(word):
                a = int(live[t])
                if a < h.shape[1]:
                    h = h[:, :a].copy()
                states[:-1, i : i + a] = h
                h = self.step(x[:, i : i + a], h)[0]
                t, i = t + 1, i + a
            out += np.bincount(lane[done : done + i], weights=self.priced(states, word, bounds), minlength=len(docs))
            done += i
        result = np.empty(len(docs))
        result[order] = out / np.log(10)
        return result


def trains() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, F.lit(True))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none), A-Z in lower case, and the number of each word's text."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, text = pieces.flatten(), np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy())
    there = pc.binary_length(words).to_numpy() > 0
    return (words, text) if there.all() else (words.filter(pa.array(there)), text[there])


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of texts, in order: at most TEXTS texts and, but for one more text, PORTION bytes each."""
    texts = texts.cast(pa.string())
    held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // PORTION
    starts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(texts)]
    for i, j in zip(starts, starts[1:], strict=False):
        for k in range(i, j, TEXTS):
            yield texts.slice(k, min(j - k, TEXTS))


def token_counts(docs: DataFrame) -> DataFrame:
    """token and count over whole texts, ends included; counted in part before the shuffle."""

    def run(batches):
        held, n, texts = [], 0, 0

        def flushed():
            found = pc.value_counts(pa.chunked_array([*held, pa.array([END], pa.string())]))
            token, count = found.field("values"), found.field("counts").to_numpy() + (texts - 1) * pc.equal(found.field("values"), END).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([token, pa.array(count, type=pa.int64())], names=["token", "n"])

        for b in batches:
            for part in portions(b.column(0)):
                held.append(words_of(part)[0])
                n, texts = n + len(held[-1]), texts + len(part)
                if n >= FLUSH:
                    yield from flushed()
                    held, n, texts = [], 0, 0
        if texts:
            yield from flushed()

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(tokens: int) -> int:
    """Words of the model, the unknown one included, for so many training tokens."""
    return min(FREQUENT, max(VOCABULARY, math.isqrt(tokens)))


def numbers_of(words: pa.Array, text: np.ndarray, texts: int, vocabulary: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of so many texts, flat, from 1 by the vocabulary (0: not in it), an end after each text; and how many each text has."""
    ids = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy() + np.int64(1)
    flat = np.full(len(ids) + texts, end, dtype=np.int64)
    flat[np.arange(len(ids)) + text] = ids
    return flat, np.bincount(text, minlength=texts) + 1


def learn(model: GatedModel, train: DataFrame, tokens: int, as_numbers: Callable[[bytes], np.ndarray] | pa.Array, end: int) -> int:
    """Trains the model on all tokens of all rows of train and gives how many it learned from in a pass.

    Rows are dealt to rounds and shards by their hash, so that the weights depend on neither partitions nor cores. Each shard
    of a round goes on from the round's weights; their changes are averaged, weighted by what the shard learned of a word
    (E), of a class (Wo) or in all. `as_numbers` gives a text's numbers or is the vocabulary, from number 1 on. What is summed is a model a shard, of which there are as many as the root of the
    tokens asks for.
    """
    square = {k: np.full_like(v, 1e-6) for k, v in model.p.items()}
    shards, learned = max(1, math.isqrt(tokens) // ROOTS), 0
    rounds = min(ROUNDS, shards)
    lanes = min(MOST_LANES, max(LANES, tokens // 100_000))
    each = -(-shards // rounds)
    pieces = -(-sum(2 * v.size for v in model.p.values()) // SLICE)
    h = F.xxhash64("doc_id", "text", F.lit(SEED))
    keyed = train.select(h.alias("h"), F.pmod(F.xxhash64(h), F.lit(each)).cast("int").alias("shard"), "text")
    for k in range(min(EPOCHS, max(1, -(-ENOUGH // max(1, tokens)))) * rounds):
        part = keyed.where(F.pmod("h", F.lit(rounds)) == k % rounds).repartitionById(each, "shard").sortWithinPartitions("shard", "h")
        state = {f"{name}{c}": v for c, x in (("", model.p), ("2", square)) for name, v in x.items()}

        def run(batches, state=state):
            def numbered(texts):
                for part in portions(texts):
                    if callable(as_numbers):
                        yield from (as_numbers(t or b"") for t in part.cast(pa.binary()).to_pylist())
                    else:
                        flat, count = numbers_of(*words_of(part), len(part), as_numbers, end)
                        yield from np.split(flat, np.cumsum(count)[:-1])

            rows = (r for b in batches for r in zip(b.column(1).to_pylist(), numbered(b.column(2)), strict=True))
            for shard, of_shard in groupby(rows, lambda r: r[0]):
                own = GatedModel(model.size, edges=model.edges)
                own.p, sums = ({name: state[f"{name}{c}"].copy() for name in model.p} for c in ("", "2"))
                seen = own.train((numbers for _, numbers in of_shard), sums, lanes, end)
                shares = own.shares(seen)
                changes = {"seen": seen}
                for c, x in (("", own.p), ("2", sums)):
                    changes |= {f"{name}{c}": (v - state[f"{name}{c}"]) * shares[name] for name, v in x.items()}
                for name, v in changes.items():
                    flat = v.ravel().astype(np.float32)
                    at = range(0, len(flat), SLICE)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array([shard] * len(at), pa.int32()), pa.array([flat[i : i + SLICE].tobytes() for i in at])], names=["name", "at", "shard", "v"])

        def summed(batches):
            rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for (name, at), same in groupby(rows, lambda r: r[:2]):
                total = sum(np.frombuffer(r[3], dtype=np.float32).astype(np.float64) for r in same)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["name", "at", "v"])

        changed = part.mapInArrow(run, "name string, at int, shard int, v binary").repartition(max(8, pieces // 16), "name", "at").sortWithinPartitions("name", "at", "shard")
        sums = stored(changed.mapInArrow(summed, "name string, at int, v binary"))
        got: dict[str, dict[int, np.ndarray]] = {}
        for row in sums.collect():
            got.setdefault(row["name"], {})[row["at"]] = np.frombuffer(row["v"])
        dropped(sums)
        if not got:
            continue
        whole = {name: np.concatenate([x[at] for at in sorted(x)]) for name, x in got.items()}
        seen = whole.pop("seen")
        learned += int(seen.sum()) if k < rounds else 0
        shares = model.shares(seen)
        for c, x in (("", model.p), ("2", square)):
            for name, v in x.items():
                x[name] = (v + whole[f"{name}{c}"].reshape(v.shape) / np.maximum(shares[name], 1)).astype(np.float32)
    return learned


def score(docs: DataFrame) -> DataFrame:
    """The columns of op6 for each row of docs (doc_id, text).

    A null text is empty: its one token is the end. A null doc_id isn't held out. Rows that are the same in doc_id and
    text have the same scores and each its row. Without training documents, all tokens are unknown to the model.
    """
    train = docs.where(trains())
    counts = stored(token_counts(train))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V")).first()
    N, V = int(total["N"]), int(total["V"])
    top = [(r["token"].encode(), int(r["n"])) for r in counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()]
    if all(t != END.encode() for t, _ in top):
        top = [(END.encode(), 0), *top[: FREQUENT - 1]]
    top.sort(key=lambda x: (x[0] != END.encode(), -x[1], x[0]))
    size = vocabulary(N)
    own = top[: size - 1]
    n_unk, v_unk = N - sum(n for _, n in own), V - sum(n > 0 for _, n in own)
    end = 1
    sizes = np.zeros(size)
    sizes[0], sizes[1 : len(own) + 1] = n_unk, [n for _, n in own]
    model = GatedModel(size, edges=edges_of(sizes))
    model.start(sizes)
    number = pa.array([t for t, _ in top], type=pa.binary()).cast(pa.string())
    learn(model, train, N, number[: len(own)], end)

    log_base = np.log10((np.array([0, *(n for _, n in top)]) + 1.0) / (N + V + 1))
    log_unk = np.log10((np.array([0, *(n for _, n in top)]) + 1.0) / (n_unk + v_unk + 1))
    log_unk[1:size] = 0.0  # the model has these words itself
    log_base[0] = log_unk[0] = 0.0  # these words' counts are joined below
    known = np.array([False, *(n > 0 for _, n in top)])

    def portion(texts):
        words, text = words_of(texts)
        flat, count = numbers_of(words, text, len(texts), number, end)
        ends, of_text = np.cumsum(count), np.repeat(np.arange(len(texts)), count)
        known_, base_, unk_ = (np.bincount(of_text, weights=x[flat], minlength=len(texts)) for x in (known, log_base, log_unk))
        scores = model.score(np.split(np.where(flat < size, flat, 0), ends[:-1]), end)
        beyond = np.delete(flat, ends - 1) == 0  # words beyond those of `number`
        rare = words.filter(pa.array(beyond)).dictionary_encode()
        several = max(1, len(rare.dictionary))
        pairs, often = np.unique(text[beyond] * several + rare.indices.to_numpy(), return_counts=True)
        ends = np.cumsum([0, *np.bincount(pairs // several, minlength=len(texts))])
        rare = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(pairs % several)), pa.array(often, type=pa.int64())], names=["token", "n"])
        return count, known_.astype(np.int64), base_, scores + unk_, pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), rare)

    def work(texts):
        out = list(zip(*map(portion, portions(texts)), strict=True))
        return *map(np.concatenate, out[:-1]), pa.concat_arrays(out[-1])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    partial = appended(keyed, "n_tokens long, known long, base double, model double, rare array<struct<token:string,n:long>>", work, arrow=True, rows=TEXTS).drop("text")
    # a row of its own for each document, whose token has a space and the key in it, so that it meets none
    own_row = F.struct(F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("key").cast("string")).alias("token"), F.lit(0).cast("long").alias("n"))
    each = partial.select("doc_id", "key", "n_tokens", "known", "base", "model", F.posexplode(F.concat(F.array(own_row), "rare")).alias("at", "rare"))
    first = F.col("at") == 0
    each = each.select("doc_id", "key", F.col("rare.token").alias("token"), F.col("rare.n").alias("m"), *[F.when(first, F.col(c)).alias(c) for c in ("n_tokens", "known", "base", "model")])
    met = each.join(counts, "token", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    there = F.when(F.col("c") > 0, F.col("m")).otherwise(0)
    base = F.sum(F.coalesce("base", F.lit(0.0)) + F.col("m") * F.log10((F.col("c") + 1.0) / float(N + V + 1)))
    by_model = F.sum(F.coalesce("model", F.lit(0.0)) + F.col("m") * F.log10((F.col("c") + 1.0) / float(n_unk + v_unk + 1)))
    rows_ = F.count("n_tokens")
    grouped = met.groupBy("doc_id", "key").agg(rows_.alias("rows"), F.max("n_tokens").alias("n_tokens"), (F.sum(F.coalesce("known", F.lit(0)) + there) / rows_).cast("long").alias("n_known"), (base / rows_).alias("base_score"), (by_model / rows_).alias("score"))
    grouped = grouped.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return grouped.select("doc_id", (~trains()).alias("held_out"), "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
