"""Toxicity scores from a bidirectional gated recurrent network.

Words are read through two inputs, an embedding of the word and the mean
embedding of its character n-grams, so unseen forms of a known stem still
count.  A forward and a backward gated recurrent unit run over each window of
``WINDOW`` words, attention pools their states, and a logistic unit scores the
window.  Windows overlap (one starts every ``STRIDE`` words) and cover the
whole text; a document's score is that of its most toxic window, calibrated.

Everything is numpy.  The network is trained on the driver, on at most
``TRAIN_DOCS`` labelled documents of each class, none above ``TRAIN_CHARS``
characters (150 million characters in all), with a fixed number of steps; which
window of a toxic document is the toxic one is first guessed from word
statistics and then from the network itself.  Each training step leaves out the
word input of half of the words, so that words are not learnt by heart that
their characters could tell.  Tasks score in batches of windows: the gates' input parts are
computed once per distinct word, and memory is bounded by the batch.

Empty, null and wordless texts are one window of padding and get a score like
any other.  Repeated rows get equal scores, tables may be empty, and other
columns pass through; a column named like an output is replaced.  Without
labels of both classes there is nothing to learn, which is an error.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_python_columns

WINDOW, STRIDE = 32, 24
HIDDEN, WIDTH, BUCKETS = 8, 8, 1 << 17
GRAMS = (3, 4, 5)
TRAIN_DOCS, TRAIN_CHARS, STEPS, BATCH, SEED = 1500, 50_000, 500, 192, 11
#: Learning rate of the embeddings, and what their sums of squared gradients start from.
RATE, START = 0.2, 1e-3
#: Share of words whose word input a training step reads.
WORD_SHARE = 0.5
#: Pieces that longer words are cut into, all of them kept.
PIECE = 24
#: Windows in one batch, and distinct words remembered by a task.
WINDOWS_AT_ONCE, KNOWN = 4096, 150_000
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`"


def text_words(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if any(len(w) > PIECE for w in words):
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def exact_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` of values rounded to fixed grids, on which sums of doubles are exact: a row's result depends on no other row and on no order."""
    grid = lambda v, unit: np.rint(v.astype(float) * unit) / unit
    return np.matmul(grid(x, 2.0**18), grid(w, 2.0**20)).astype(np.float32)


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover n words; one at least."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words themselves, of their n-grams, and where each word's n-grams begin."""
    marked = [f"<{w.strip(_EDGE)}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = ends[owner] - np.arange(len(points))  # characters from here to the word's end
    keys, owners = [], []
    for n in GRAMS:
        key = np.full(len(points), n, np.uint64)
        for i in range(n):
            shifted = np.zeros(len(points), np.uint64)
            shifted[: max(0, len(points) - i)] = points[i:]
            key = (key ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        fits = left >= n
        keys.append(key[fits])
        owners.append(owner[fits])
    whole = np.zeros(len(marked), np.uint64)
    if len(points):
        weights = np.cumprod(np.full(int(lengths.max()), 0x100000001B3, np.uint64))
        np.add.at(whole, owner, (points + np.uint64(1)) * weights[left - 1])
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    grams = (key[order] >> np.uint64(40)).astype(np.int64) % BUCKETS
    return (whole >> np.uint64(40)).astype(np.int64) % BUCKETS, grams, np.bincount(own, minlength=len(marked))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The parameters; index 0 of a pair is the forward direction."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        h, x = HIDDEN, 2 * WIDTH
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls({
            "word": draw(BUCKETS, WIDTH, by=0.1), "char": draw(BUCKETS, WIDTH, by=0.1),
            "w": draw(2, x, 3 * h, by=0.4), "b": np.zeros((2, 1, 3 * h), np.float32), "u": draw(2, h, 3 * h, by=0.3),
            "att": draw(2 * h, by=0.3), "out": draw(2 * h, by=0.3), "bias": np.full(1, -1.0, np.float32),
        })

    def inputs(self, whole: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Inputs of words, from their buckets; row 0 is the padding's."""
        x = np.zeros((len(whole) + 1, 2 * WIDTH), np.float32)
        x[1:, :WIDTH] = self.p["word"][whole]
        some = np.flatnonzero(counts)
        if len(grams):
            x[1 + some, WIDTH:] = np.add.reduceat(self.p["char"][grams], (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates of both directions."""
        return np.matmul(x[None], self.p["w"]) + self.p["b"]

    def run(self, g: np.ndarray, keep: list | None = None, product: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.matmul) -> np.ndarray:
        """States [window, time, both directions] from gate inputs g [2, window, time, 3 * hidden], the second reversed in time."""
        h, u = HIDDEN, self.p["u"]
        n, steps = g.shape[1], g.shape[2]
        s = np.zeros((2, n, h), np.float32)
        states = np.empty((n, steps, 2 * h), np.float32)
        for t in range(steps):
            a, uh = g[:, :, t], product(s, u)
            zr = sigmoid(a[..., : 2 * h] + uh[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(a[..., 2 * h :] + r * uh[..., 2 * h :])
            if keep is not None:
                keep.append((s, z, r, c, uh[..., 2 * h :]))
            s = c + z * (s - c)
            states[:, t, :h] = s[0]
            states[:, steps - 1 - t, h:] = s[1]
        return states

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(real, states @ self.p["att"], np.float32(-30))
        alpha = np.exp(e - e.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = np.matmul(alpha[:, None], states)[:, 0]
        return pooled @ self.p["out"] + self.p["bias"][0], alpha, pooled

    def logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ids: rows of gates [window, time], 0 where there is no word."""
        return self.pool(self.run(np.stack([gates[0][ids], gates[1][ids[:, ::-1]]])), ids > 0)[0]

    def steady_gates(self, x: np.ndarray) -> np.ndarray:
        """``gates``, with each row's the same whatever the rows beside it."""
        return np.stack([exact_product(x, w) for w in self.p["w"]]) + self.p["b"]

    def steady_logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``logits``, with each window's the same whatever the windows beside it."""
        states = self.run(np.stack([gates[0][ids], gates[1][ids[:, ::-1]]]), product=exact_product)
        e = np.where(ids > 0, (states * self.p["att"]).sum(2), np.float32(-30))
        alpha = np.exp(e - e.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        return ((alpha[:, :, None] * states).sum(1) * self.p["out"]).sum(1) + self.p["bias"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy; the second result is the gradient of the inputs x."""
        h, p, keep = HIDDEN, self.p, []
        gates = self.gates(x)
        flipped = ids[:, ::-1]
        states = self.run(np.stack([gates[0][ids], gates[1][flipped]]), keep)
        logit, alpha, pooled = self.pool(states, ids > 0)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        out = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_alpha = np.matmul(states, d_pooled[:, :, None])[..., 0]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True)) * (ids > 0)
        out["att"] = np.einsum("nt,nth->h", d_e, states)
        d_states = alpha[..., None] * d_pooled[:, None] + d_e[..., None] * p["att"]
        d_gates, d_u, d_s = np.zeros_like(gates), np.zeros_like(p["u"]), np.zeros((2, len(y), h), np.float32)
        steps = ids.shape[1]
        for t in reversed(range(steps)):
            s, z, r, c, un = keep[t]
            d_s = d_s + np.stack([d_states[:, t, :h], d_states[:, steps - 1 - t, h:]])
            d_c = d_s * (1 - z) * (1 - c * c)
            d_z = d_s * (s - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c], 2)
            d_uh = np.concatenate([d_z, d_r, d_c * r], 2)
            d_u += np.matmul(s.transpose(0, 2, 1), d_uh)
            for k, rows in ((0, ids[:, t]), (1, flipped[:, t])):
                np.add.at(d_gates[k], rows, d_a[k])
            d_s = d_s * z + np.matmul(d_uh, p["u"].transpose(0, 2, 1))
        out["u"], out["w"], out["b"] = d_u, np.matmul(x.T[None], d_gates), d_gates.sum(1, keepdims=True)
        return out, np.matmul(d_gates, p["w"].transpose(0, 2, 1)).sum(0)


def window_ids(n: int, rows: np.ndarray) -> np.ndarray:
    """Word rows of each window of a text of n words, padded with 0."""
    starts = np.arange(len(window_starts(n))) * STRIDE
    padded = np.zeros(int(starts[-1]) + WINDOW, np.int64)
    padded[:n] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]


class Scorer:
    """Scores texts with a trained network; remembers the gates of words seen."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = self.net.steady_gates(np.zeros((1, 2 * WIDTH), np.float32))

    def learn(self, texts: list[list[str]]) -> None:
        new = list({w for words in texts for w in words} - self.rows.keys())
        if len(new) + len(self.rows) > KNOWN:
            self.forget()
            new = list({w for words in texts for w in words})
        if new:
            start = self.gates.shape[1]
            self.rows.update(zip(new, range(start, start + len(new)), strict=True))
            x = self.net.inputs(*char_ids(new))
            self.gates = np.concatenate([self.gates, self.net.steady_gates(x[1:])], 1)

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and how many windows each text has."""
        split = [text_words(t) for t in texts]
        self.learn(split)
        get = self.rows.__getitem__
        ids = [window_ids(len(w), np.fromiter(map(get, w), np.int64, len(w))) for w in split]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        every = np.concatenate(ids) if ids else np.zeros((0, WINDOW), np.int64)
        parts = [self.net.steady_logits(self.gates, every[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(every), WINDOWS_AT_ONCE)]
        return (np.concatenate(parts) if parts else np.zeros(0, np.float32)), counts

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logits, counts = self.window_logits(texts)
        top = np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(float)
        return sigmoid(self.net.slope * top + self.net.offset)


class Vocabulary:
    """The distinct words of training texts, numbered from 1, and their buckets; small integers throughout."""

    #: Words whose n-grams are computed at once.
    CHUNK = 20_000

    def __init__(self, texts: list[str | None]):
        rows: dict[str, int] = {}
        self.texts = [np.array([rows.setdefault(w, len(rows) + 1) for w in text_words(t)], np.int32) for t in texts]
        words, parts = list(rows), []
        for i in range(0, len(words), self.CHUNK):
            whole, grams, counts = char_ids(words[i : i + self.CHUNK])
            parts.append((whole.astype(np.int32), grams.astype(np.int32), counts.astype(np.int32)))
        self.whole, self.grams, self.counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
        self.ends = np.cumsum(self.counts, dtype=np.int64)

    def spans(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams of words (from 0) are, and how many each has."""
        n = self.counts[used]
        first = np.repeat(self.ends[used] - n - (np.cumsum(n) - n), n)
        return first + np.arange(len(first)), n

    def odds(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """For each word number the highest log odds of label 1 of the word and its n-grams, at the lower end of what their counts leave open."""
        seen = np.zeros((2, 2 * BUCKETS), np.int32)
        for text, label, used in zip(self.texts, y, use, strict=True):
            if used and len(text):
                words = np.unique(text) - 1
                seen[int(label), np.unique(np.concatenate([self.whole[words].astype(np.int64), self.grams[self.spans(words)[0]].astype(np.int64) + BUCKETS]))] += 1
        n1, n0 = max(1, y[use].sum()), max(1, (1 - y[use]).sum())
        s1, s0 = seen[1] + 0.5, seen[0] + 0.5
        odds = np.maximum(np.log(s1 / (n1 + 1)) - np.log(s0 / (n0 + 1)) - 1.64 * np.sqrt(1 / s1 + 1 / s0), 0.0)
        out = np.zeros(len(self.whole) + 1)
        out[1:] = odds[self.whole]
        some = np.flatnonzero(self.counts)
        if len(some):
            best = np.maximum.reduceat(odds[self.grams.astype(np.int64) + BUCKETS], (self.ends - self.counts)[some])
            out[1 + some] = np.maximum(out[1 + some], best)
        return out


def fit(texts: list[str | None], labels: list[int], prior: float = 1.0, steps: int = STEPS, seed: int = SEED) -> Network:
    """Train on whole texts with a label each, but for every eighth, which is kept for the calibration.

    ``prior``: how much rarer label 1 is, against label 0, than in the texts.
    """
    rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
    kept = np.zeros(len(y), bool)
    for label in (0, 1):
        kept[np.flatnonzero(y == label)[3::8]] = True
    net, vocabulary = Network.fresh(rng), Vocabulary(texts)
    windows = [window_ids(len(t), t).astype(np.int32) for t in vocabulary.texts]
    toxic, clean = np.flatnonzero((y == 1) & ~kept), np.flatnonzero((y == 0) & ~kept)
    # which window of a toxic text is the toxic one: a first guess from words and n-grams
    odds = vocabulary.odds(y, ~kept)
    chosen = [int(odds[w].sum(1).argmax()) for w in windows]
    hard: list[tuple[int, int]] = []
    # embeddings start with a large cache: what few windows hold is learnt slowly, so that it isn't memorized
    cache = {k: np.full_like(v, START if k in ("word", "char") else 0) for k, v in net.p.items()}
    for share in (0.5, 0.3, 0.2):
        for _ in range(int(steps * share)):
            picked = [(i, chosen[i]) for i in rng.choice(toxic, BATCH // 2)]
            picked += [hard[k] for k in rng.integers(0, len(hard), BATCH // 4)] if hard else []
            picked += [(i, int(rng.integers(len(windows[i])))) for i in rng.choice(clean, BATCH - len(picked))]
            learn(net, cache, vocabulary, np.stack([windows[i][k] for i, k in picked]), y[[i for i, _ in picked]], rng)
        logits = text_logits(net, vocabulary, windows)
        chosen = [int(v.argmax()) for v in logits]
        hard = [(int(i), chosen[i]) for i in sorted(clean, key=lambda i: -logits[i].max())[: max(8, len(clean) // 8)]]
    tops = np.array([v.max() for v in logits], float)
    net.slope, net.offset = calibrated(tops[kept], y[kept], np.where(y[kept] == 1, prior, 1.0))
    return net


def learn(net: Network, cache: dict[str, np.ndarray], vocabulary: Vocabulary, window: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    """One step on a batch of windows."""
    used, local = np.unique(np.append(window, 0), return_inverse=True)
    used = used[1:] - 1
    spans, n = vocabulary.spans(used)
    whole, grams = vocabulary.whole[used], vocabulary.grams[spans]
    x = net.inputs(whole, grams, n)
    there = (rng.random((len(x), 1)) < WORD_SHARE).astype(np.float32)
    x[:, :WIDTH] *= there
    grads, d_x = net.gradients(x, local[:-1].reshape(window.shape), y)
    d_gram = np.repeat(d_x[1:, WIDTH:] / np.maximum(n, 1)[:, None], n, axis=0)
    for name, at, d in (("word", whole, (d_x[:, :WIDTH] * there)[1:]), ("char", grams, d_gram)):
        if len(at):
            order = np.argsort(at, kind="stable")
            place, first = np.unique(at[order], return_index=True)
            total = np.add.reduceat(d[order], first, axis=0)
            cache[name][place] += total**2
            net.p[name][place] -= RATE * total / np.sqrt(cache[name][place])
    for name, d in grads.items():
        cache[name] = 0.98 * cache[name] + 0.02 * d**2
        net.p[name] -= 0.01 * d / (np.sqrt(cache[name]) + 1e-6)


def text_logits(net: Network, vocabulary: Vocabulary, windows: list[np.ndarray], at_once: int = 32) -> list[np.ndarray]:
    """The logits of every training window, some texts at a time."""
    out = []
    for i in range(0, len(windows), at_once):
        part = windows[i : i + at_once]
        used, local = np.unique(np.append(np.concatenate(part), 0), return_inverse=True)
        spans, n = vocabulary.spans(used[1:] - 1)
        gates = net.gates(net.inputs(vocabulary.whole[used[1:] - 1], vocabulary.grams[spans], n))
        ids = local[:-1].reshape(-1, WINDOW)
        found = np.concatenate([net.logits(gates, ids[k : k + WINDOWS_AT_ONCE]) for k in range(0, len(ids), WINDOWS_AT_ONCE)])
        out += np.split(found, np.cumsum([len(w) for w in part])[:-1])
    return out


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y): Newton's method with halved steps, a small ridge and smoothed labels."""
    m, start = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    soft = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a: np.ndarray) -> float:
        z = m @ a
        return float((weight * (np.logaddexp(0, z) - soft * z)).sum() + 0.5 * ((a - start) ** 2).sum())

    a = start
    for _ in range(50):
        q = sigmoid(m @ a)
        hess = (m * (weight * q * (1 - q))[:, None]).T @ m + np.eye(2)
        step = np.linalg.solve(hess, m.T @ (weight * (q - soft)) + a - start)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return max(float(a[0]), 0.05), float(a[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label") -> Network:
    """Fit on a bounded, reproducible sample of labelled rows.

    The sample is drawn from the labels alone: of each class the ids whose
    digest lies in the share that ``TRAIN_DOCS`` is of the class.  Those few
    are broadcast, so no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).alias("y"))
    there = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        raise ValueError("labels of both classes are needed")
    place = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    share = F.when(F.col("y") == 1, min(1.0, TRAIN_DOCS / there[1])).otherwise(min(1.0, TRAIN_DOCS / there[0]))
    # of several labels of an id the highest counts, of several texts the least
    picked = known.where(place < share).groupBy("id").agg(F.max("y").alias("y"))
    short = F.coalesce(F.length(text), F.lit(0)) <= TRAIN_CHARS
    # the digests bound these rows to about TRAIN_DOCS of each class
    rows = docs.where(short).select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (hashlib.md5(str(r["id"]).encode()).digest(), r["t"] or ""))
    sample = [r for y in (1, 0) for r in [r for r in rows if r["y"] == y][: TRAIN_DOCS]]
    taken = Counter(r["y"] for r in sample)
    if len(taken) < 2:
        raise ValueError("labelled documents of both classes are needed")
    prior = (there[1] / there[0]) / (taken[1] / taken[0])
    return fit([r["t"] for r in sample], [r["y"] for r in sample], prior)


def score(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the threshold on).

    A table without rows needs no network, as there is nothing to learn from it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    held: dict[str, Scorer] = {}

    def make(texts: list) -> list:
        scorer = held.get("it") or held.setdefault("it", Scorer(sent.value))
        found = scorer(texts)
        return [found, (found >= threshold).astype(np.int32)]

    return with_python_columns(docs, [text], make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], rows=256)
