"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letters and digits, A-Z folded.  A word's input is its own (hashed)
embedding and the mean embedding of its character n-grams.  Windows of WINDOW words,
STRIDE apart and so overlapping, cover the whole text, each passage of up to STRIDE words in one; two recurrent passes run over a window, attention
pools their states, and a text has the score of its worst window.

The network is fitted on a bounded sample of labelled rows (SAMPLE and CLEAN_SAMPLE, texts
of at most FIT_CHARS, one text per id), in rounds: first random windows with the label of their
text, then the window of each toxic text that the network finds worst as toxic, the worst and a
random window of each other text as not.  All parameters start at random; a part of the words
and n-grams is hidden from each step.  One text in ASIDE is not learned from: the last bias is
set where the scores of those texts part best.

Nulls, empty texts and texts without a word have no window: their score is 0.  Very long texts
are scored whole, window by window.  Labels that are null, or have no document that may be
learned from, are not used; without both labels every score is 0, and an empty table gives an
empty result.  Repeated rows are scored each; of several texts of a labelled id the least by
hash is learned from, of several labels the largest.  An input column named as the score is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klaxon.llm.common import appended, bytes_of, map_batches, slices, with_columns
from klaxon.llm.labelled import labelled_sample
from klaxon.llm.words import MARKED, U, hashes, mix, spans, within

WINDOW, STRIDE = 32, 16
TABLE_BITS, DIM, HIDDEN, ATTENTION = 15, 8, 8, 8
GRAM, LEAD = 4, 5
# Labelled rows with label 1 and 0 that are learned from at most, and the longest text of them.
SAMPLE, CLEAN_SAMPLE, FIT_CHARS = 2000, 3000, 30_000
# Rounds on random windows and on worst ones; steps at least, for small samples; share of inputs hidden.
EARLY, ROUNDS, STEPS, BATCH, RATE, HIDE = 3, 6, 400, 256, 0.05, 0.3
ASIDE = 8
CHUNK = 1024


class Words:
    """The words of a batch of texts: distinct ones with their n-grams, and their sequence."""

    def __init__(self, column: pa.Array):
        ends, body = bytes_of(column)
        starts, stops, per_row = spans(ends, body, MARKED)
        letters = MARKED[body[starts]] == 1
        row = np.repeat(np.arange(len(per_row)), per_row)[letters]
        starts, stops = starts[letters], stops[letters]
        self.per_row = np.bincount(row, minlength=len(per_row))
        words = hashes(body, starts, stops)
        distinct, first, self.sequence = np.unique(words, return_index=True, return_inverse=True)
        self.word = (distinct >> U(64 - TABLE_BITS)).astype(np.int64)
        start, length = starts[first], (stops - starts)[first]
        size = np.minimum(length, GRAM)
        number = length - size + 1
        at = np.repeat(start, number) + within(number)
        grams = hashes(body, at, at + np.repeat(size, number))
        lead = mix(hashes(body, start, start + np.minimum(length, LEAD)) + U(1))
        # The n-grams of a word, its lead last.
        self.number = number + 1
        self.grams = np.empty(int(self.number.sum()), np.int64)
        last = np.cumsum(self.number) - 1
        inner = np.ones(len(self.grams), bool)
        inner[last] = False
        self.grams[inner] = grams >> U(64 - TABLE_BITS)
        self.grams[last] = lead >> U(64 - TABLE_BITS)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, row) of every window; each word is in one at least."""
        n = self.per_row
        number = np.where(n > 0, 1 + (np.maximum(n - WINDOW, 0) + STRIDE - 1) // STRIDE, 0)
        row = np.repeat(np.arange(len(n)), number)
        begin = within(number) * STRIDE
        return (np.cumsum(n) - n)[row] + begin, np.minimum(n[row] - begin, WINDOW), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.tanh(x * x.dtype.type(0.5))
    y += 1
    y *= x.dtype.type(0.5)
    return y


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)

        size = 1 << TABLE_BITS
        self.p = {
            "word": (rng.standard_normal((size, DIM)) * 0.05).astype(np.float32),
            "gram": (rng.standard_normal((size, DIM)) * 0.05).astype(np.float32),
            "A": small(2 * HIDDEN, ATTENTION),
            "v": small(ATTENTION, 1)[:, 0],
            "u": small(2 * HIDDEN, 1)[:, 0],
            "c": np.full(1, -1.0, np.float32),
        }
        for side in "fb":
            self.p["W" + side] = small(2 * DIM, 3 * HIDDEN)
            self.p["U" + side] = small(HIDDEN, 3 * HIDDEN)
            self.p["b" + side] = np.zeros(3 * HIDDEN, np.float32)
        self.sums = {k: np.full(v.shape, 1e-8, np.float32) for k, v in self.p.items()}

    def inputs(self, words: Words) -> np.ndarray:
        """One row per distinct word."""
        if not len(words.word):
            return np.zeros((1, 2 * DIM), np.float32)
        first = np.cumsum(words.number) - words.number
        mean = np.add.reduceat(self.p["gram"][words.grams], first, axis=0) / words.number[:, None]
        return np.concatenate([self.p["word"][words.word], mean.astype(np.float32)], axis=1)

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; index: rows of x, by window and step; mask: which steps are words."""
        p, count = self.p, len(index)
        steps_index, full = np.ascontiguousarray(index.T), bool(mask.all())
        states, trail = np.zeros((2, WINDOW, count, HIDDEN), np.float32), {}
        for s, side in enumerate("fb"):
            gates = x @ p["W" + side] + p["b" + side]
            h = np.zeros((count, HIDDEN), np.float32)
            steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
            for t in steps:
                g = np.take(gates, steps_index[t], axis=0)
                own = h @ p["U" + side]
                g[:, : 2 * HIDDEN] += own[:, : 2 * HIDDEN]
                rz = sigmoid(g[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
                m = mask[:, t, None]
                after = n + z * (h - n) if full else h + m * (n + z * (h - n) - h)
                if keep:
                    trail[side, t] = (h, r, z, n, own[:, 2 * HIDDEN :], m)
                h = after
                states[s, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)
        tanh = np.tanh(both @ p["A"])
        score = tanh @ p["v"] + (mask.T - 1) * 30
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        logit = pooled @ p["u"] + p["c"][0]
        return (logit, (both, tanh, weight, pooled, trail)) if keep else logit

    def backward(self, x: np.ndarray, index: np.ndarray, error: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of x, from the error of each logit."""
        p = self.p
        both, tanh, weight, pooled, trail = kept
        grad = {"u": pooled.T @ error, "c": np.array([error.sum()], np.float32)}
        into = error[:, None] * p["u"]
        along = np.einsum("tbh,bh->tb", both, into)
        d_score = weight * (along - (weight * along).sum(0))
        d_tanh = d_score[:, :, None] * p["v"] * (1 - tanh * tanh)
        grad["v"] = np.einsum("tba,tb->a", tanh, d_score)
        grad["A"] = np.einsum("tbh,tba->ha", both, d_tanh)
        d_both = weight[:, :, None] * into + d_tanh @ p["A"].T
        d_x = np.zeros_like(x)
        for s, side in enumerate("fb"):
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_u, d_h = np.zeros_like(p["U" + side]), np.zeros_like(pooled[:, :HIDDEN])
            steps = range(WINDOW - 1, -1, -1) if side == "f" else range(WINDOW)
            for t in steps:
                h, r, z, n, own, m = trail[side, t]
                d = d_h + d_both[t][:, s * HIDDEN : (s + 1) * HIDDEN]
                d_new = d * m
                d_n = d_new * (1 - z) * (1 - n * n)
                d_r = d_n * own * r * (1 - r)
                d_z = d_new * (h - n) * z * (1 - z)
                through = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_h = d * (1 - m) + d_new * z + through @ p["U" + side].T
                d_u += h.T @ through
                np.add.at(d_gates, index[:, t], np.concatenate([d_r, d_z, d_n], axis=1))
            grad["U" + side], grad["b" + side] = d_u, d_gates.sum(0)
            grad["W" + side] = x.T @ d_gates
            d_x += d_gates @ p["W" + side].T
        return grad, d_x

    def adapt(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        self.sums[name][at] += grad * grad
        self.p[name][at] -= RATE * grad / np.sqrt(self.sums[name][at])

    def worst(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, first word, row) of every window."""
        x = self.inputs(words)
        first, length, row = words.windows()
        logits = np.zeros(len(first), np.float32)
        # Full windows first, so that most chunks need no mask.
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(first), CHUNK):
            mine = order[at : at + CHUNK]
            logits[mine] = self.forward(x, *steps_of(words, first[mine], length[mine]))
        return logits, first, row

    def text_logits(self, column: pa.Array) -> np.ndarray:
        """Logit of the worst window of each text; -inf without a window."""
        logits, _, row = self.worst(Words(column))
        best = np.full(len(column), -np.inf)
        np.maximum.at(best, row, logits)
        return best

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of the worst window of each text."""
        best = self.text_logits(column)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)


def steps_of(words: Words, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, is a word) by window and step."""
    step = np.arange(WINDOW)
    mask = step < length[:, None]
    at = np.where(mask, first[:, None] + step, 0)
    return words.sequence[at], mask.astype(np.float32)


def one_each(order: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The last window of each text in an order by text."""
    return order[np.append(row[order][1:] != row[order][:-1], True)]


def learn(net: Network, words: Words, labels: np.ndarray) -> None:
    """Train on the windows of labelled texts."""
    rng = np.random.default_rng(11)
    first, length, row = words.windows()
    if not len(first):
        return
    gram_first = np.cumsum(words.number) - words.number
    # A small sample takes smaller batches and more rounds.
    batch = max(16, min(BATCH, len(labels) // 8))
    more = max(1, -(-STEPS * batch // (2 * len(labels) * (EARLY + ROUNDS))))
    early, rounds = EARLY * more, (EARLY + ROUNDS) * more
    logits = np.zeros(len(first), np.float32)
    for turn in range(rounds):
        # For a random window of each text: the largest of random keys.
        some = one_each(np.lexsort((rng.random(len(row)), row)), row)
        if turn < early:
            chosen = np.concatenate([some, one_each(np.lexsort((rng.random(len(row)), row)), row)])
        else:
            if (turn - early) % 2 == 0:
                logits, _, _ = net.worst(words)
            chosen = np.concatenate([one_each(np.lexsort((logits, row)), row), some[labels[row[some]] == 0]])
        target = labels[row[chosen]].astype(np.float32)
        deal = rng.permutation(len(chosen))
        for at in range(0, len(deal), batch):
            mine = chosen[deal[at : at + batch]]
            index, mask = steps_of(words, first[mine], length[mine])
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            number = words.number[used]
            grams = words.grams[np.repeat(gram_first[used], number) + within(number)]
            starts = np.cumsum(number) - number
            seen_word = (rng.random((len(used), 1)) >= HIDE).astype(np.float32)
            seen_gram = (rng.random((len(grams), 1)) >= HIDE).astype(np.float32)
            mean = np.add.reduceat(net.p["gram"][grams] * seen_gram, starts, axis=0) / number[:, None]
            x = np.concatenate([net.p["word"][words.word[used]] * seen_word, mean.astype(np.float32)], axis=1)
            logit, kept = net.forward(x, local, mask, keep=True)
            error = ((sigmoid(logit) - target[deal[at : at + batch]]) / len(mine)).astype(np.float32)
            grad, d_x = net.backward(x, local, error, kept)
            for name, g in grad.items():
                net.adapt(name, g)
            slots, place = np.unique(words.word[used], return_inverse=True)
            total = np.zeros((len(slots), DIM), np.float32)
            np.add.at(total, place, d_x[:, :DIM] * seen_word)
            net.adapt("word", total, slots)
            slots, place = np.unique(grams, return_inverse=True)
            total = np.zeros((len(slots), DIM), np.float32)
            np.add.at(total, place, np.repeat(d_x[:, DIM:] / number[:, None], number, axis=0) * seen_gram)
            net.adapt("gram", total, slots)


def parting(scores: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the fewest errors, in the middle of its gap; -inf if it can't."""
    order = np.argsort(scores, kind="stable")
    ordered, toxic = scores[order], labels[order] == 1
    # Errors if the first k texts are called clean.
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    gaps = np.flatnonzero(ordered[1:] > ordered[:-1]) + 1
    if not len(gaps) or len(set(toxic.tolist())) < 2:
        return -np.inf
    # Of equally good gaps the widest.
    good = gaps[errors[gaps] == errors[gaps].min()]
    k = good[np.argmax(ordered[good] - ordered[good - 1])]
    return float(ordered[k - 1] + ordered[k]) / 2


def fit(texts: list[str], labels: np.ndarray) -> Network | None:
    """A network from labelled texts, or None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    net = Network()
    aside = np.arange(len(texts)) % ASIDE == ASIDE - 1
    if len(set(labels[~aside].tolist())) < 2:
        aside[:] = False
    learn(net, Words(pa.array([t for t, a in zip(texts, aside) if not a], pa.large_string())), labels[~aside])
    if aside.any():
        logits = net.text_logits(pa.array([t for t, a in zip(texts, aside) if a], pa.large_string()))
        known = np.isfinite(logits)
        middle = parting(logits[known], labels[aside][known])
        if np.isfinite(middle):
            net.p["c"] -= np.float32(middle)
    return net


def labelled_texts(
    documents: DataFrame, labels: DataFrame, label_col: str, use: Column, id_col: str, text_col: str
) -> DataFrame:
    """_id, _text, _label of at most SAMPLE toxic and CLEAN_SAMPLE other texts, the smallest ids by hash."""
    bounds = {1: SAMPLE, 0: CLEAN_SAMPLE}
    return labelled_sample(documents, labels, label_col, use, bounds, FIT_CHARS, id_col, text_col)


def fitted(sample: DataFrame) -> Network | None:
    """A network fitted in one task on the bounded sample; its parameters come back as one row."""

    def work(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["_id"] * 0x9E3779B97F4A7C15 % 2**64, r["_text"]))
        net = fit([r["_text"] for r in rows], np.array([r["_label"] for r in rows], np.int64))
        found = [] if net is None else [(k, v.shape, v.tobytes()) for k, v in net.p.items()]
        names, shapes, values = zip(*found) if found else ((), (), ())
        return pa.table(
            {
                "name": pa.array(names, pa.string()),
                "shape": pa.array([list(x) for x in shapes], pa.list_(pa.int64())),
                "value": pa.array(values, pa.binary()),
            }
        )

    grouped = sample.withColumn("_all", F.lit(0)).groupBy("_all")
    rows = grouped.applyInArrow(work, "name string, shape array<bigint>, value binary").collect()
    if not rows:
        return None
    net = Network()
    net.p = {r["name"]: np.frombuffer(r["value"], np.float32).reshape(r["shape"]) for r in rows}
    return net


def score(df: DataFrame, net: Network | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """`df` with the score of each whole text."""
    schema = appended(df, [T.StructField(into, T.DoubleType())])
    if net is not None:
        net.sums = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            column = batch.column(text_col)
            found = np.zeros(len(column)) if net is None else net.scores(column)
            yield with_columns(batch, schema.names, {into: pa.array(found, pa.float64())})

    return map_batches(df, work, schema)


def classify(
    df: DataFrame,
    labels: DataFrame,
    use: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    into: str = "score",
) -> DataFrame:
    """Fit on the labelled rows that `use` allows, then `df` with the score."""
    sample = labelled_texts(df.select(id_col, text_col), labels, label_col, use, id_col, text_col)
    return score(df, fitted(sample), text_col, into)
