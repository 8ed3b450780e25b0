"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word is a run of letters and digits with the marks inside it (one or two between letters or digits, as in `f*ck`), and
every word counts, repeated ones too. Its input joins a word embedding (of the hashed lower-case word) and a character
embedding (the sum over all hashed character n-grams of the word with its two ends marked); windows of WINDOW words begin every STRIDE words, so that words
at their seams lie in two of them, and all are scored. A text's score is a logistic function of its windows' largest and mean
logits and shares. Training is plain numpy: back-propagation through time with Adagrad.

Handling of special cases: a null or empty text, or one without a word, has one empty window; very long texts give
their windows piece by piece; without labelled rows of both classes every score is 0; a document with several labels
is toxic if one says so; null labels teach nothing; repeated rows are answered each; columns of other names are left as
they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import BASE, bounded_batches, fold, free_names, read_table, texts_of
from leafmark.llm.grams import LAST_POINT, SpanHash, joined, labelled_sample

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 16
ORDERS = (3, 4, 5, 6)  # lengths of the character n-grams, the marks of the word's ends included
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 10_000_000  # bounds of the training sample, for each class
TRAIN_WINDOWS = 24  # windows that one text teaches at most, evenly spread
MIN_TEXTS = 3  # that have a word or n-gram which teaches
CHUNK_CHARS = 100_000
EPOCHS, MOST_EPOCHS, TEACH, BATCH, RATE = 3, 10, 60_000, 64, 0.1  # small samples are gone through more often


class Words:
    """Distinct words: their 64-bit names, buckets of the words, and of their character n-grams, word after word."""

    def __init__(self, names: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.names, self.grams, self.counts = names, grams, counts
        self.begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.empty(0, np.int64)
        self.buckets = (1 + names % np.uint64(WORD_BUCKETS - 1)).astype(np.int32)  # bucket 0 of either table stands for no word

    def __len__(self) -> int:
        return len(self.names)

    def pick(self, at: np.ndarray) -> Words:
        counts = self.counts[at]
        out = Words(self.names[at], self.grams[ranges(self.begin[at], counts)], counts)
        out.buckets = self.buckets[at]
        return out

    def then(self, other: Words) -> Words:
        return Words(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("names", "grams", "counts")))


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (counts[0] of them), begin[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)


NO_WORDS = Words(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64))


_kinds: list[np.ndarray] = []


def in_words(cp: np.ndarray) -> np.ndarray:
    """Which code points (the first and last are spaces) are inside words."""
    if not _kinds:
        _kinds.append(np.array([2 if chr(i).isalnum() else 0 if chr(i).isspace() else 1 for i in range(LAST_POINT + 1)], np.int8))
    kind = np.concatenate([_kinds[0][cp], np.zeros(2, np.int8)])
    inside = kind == 2
    marks = np.flatnonzero(kind == 1)
    one = marks[inside[marks - 1] & inside[marks + 1]]
    two = marks[inside[marks - 1] & (kind[marks + 1] == 1) & inside[marks + 2]]
    inside[np.concatenate([one, two, two + 1])] = True
    return inside[:-2]


def word_inputs(pieces: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words of all pieces, and for each word in its place its number among them and its piece."""
    cp, begin = joined([p + " " for p in pieces])
    inside = in_words(cp)
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(starts) == 0:
        return NO_WORDS, np.empty(0, np.int64), np.empty(0, np.int64)
    names, first, ids = np.unique(SpanHash(cp).of(starts, ends), return_index=True, return_inverse=True)
    marked = SpanHash(np.where(inside, cp, np.uint32(32)))  # a word's marks are the two spaces around it
    lead, sizes = starts[first] - 1, ends[first] - starts[first] + 2
    each = np.stack([np.maximum(sizes - n + 1, 0) for n in ORDERS])
    counts = each.sum(0)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    grams = np.empty(counts.sum(), np.int32)
    for n, own, done in zip(ORDERS, each, np.cumsum(each, 0) - each):
        places = ranges(lead, own)
        grams[ranges(at + done, own)] = 1 + (marked.of(places, places + n) * np.uint64(BASE) >> np.uint64(20)) % np.uint64(CHAR_BUCKETS - 1)
    return Words(names, grams, counts), ids, np.searchsorted(begin, starts, side="right") - 1


def window_starts(n_words: int) -> np.ndarray:
    """Every STRIDE words until a window reaches the end; a text without words has one window."""
    return np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE)


Chunk = tuple[Words, np.ndarray, np.ndarray]


def windows_of(texts: list[str]) -> Iterator[Chunk]:
    """Windows in chunks: distinct words, and for each window the text's number and its words' numbers among them,
    counted from 1 (0: after the text's end)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            if len(group) == 1 and size > 20 * CHUNK_CHARS:
                yield from _long_windows(t, i)
            else:
                yield _windows([texts[g] for g in group], np.array(group))
            group, size = [], 0


def _windows(pieces: list[str], places: np.ndarray) -> Chunk:
    words, ids, of = word_inputs(pieces)
    counts = np.bincount(of, minlength=len(pieces))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = [window_starts(n) for n in counts]
    owner = np.repeat(np.arange(len(pieces)), [len(b) for b in begin])
    at = np.concatenate(begin)[:, None] + np.arange(WINDOW)
    numbers = np.append(np.int64(0), ids + 1)
    return words, places[owner], numbers[np.where(at < counts[owner][:, None], first[owner][:, None] + at + 1, 0)]


def _long_windows(text: str, place: int) -> Iterator[Chunk]:
    """The windows of one very long text: words are gathered part by part, cut at white space."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + 10 * CHUNK_CHARS)
        while end < len(text) and not text[end].isspace():
            end += 1
        parts.append((at, end))
        at = end
    words, ids, n = NO_WORDS, np.empty(0, np.int64), 0
    for k, (a, z) in enumerate(parts):
        more, own, _ = word_inputs([text[a:z]])
        ids = np.concatenate([ids, own + len(words)])
        words = words.then(more)
        last = k == len(parts) - 1
        begin = window_starts(len(ids)) if last else np.arange(0, max(0, len(ids) - WINDOW - STRIDE + 1), STRIDE)
        if last and n and len(ids) <= WINDOW - STRIDE:
            begin = begin[:0]
        if len(begin) == 0:
            continue
        at = begin[:, None] + np.arange(WINDOW) + 1
        yield words, np.full(len(begin), place), np.append(np.int64(0), ids + 1)[np.where(at <= len(ids), at, 0)]
        n += len(begin)
        left, ids = np.unique(ids[begin[-1] + STRIDE :], return_inverse=True)
        words = words.pick(left)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Embeddings, two gated recurrent layers (forward and backward), attention, and a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def random(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": random(WORD_BUCKETS, WORD_DIM, scale=0.05), "char": random(CHAR_BUCKETS, CHAR_DIM, scale=0.05),
            "in": random(2, d, 3 * h, scale=d**-0.5), "bias": np.zeros((2, 3 * h), np.float32), "gates": random(2, h, 2 * h, scale=h**-0.5), "cand": random(2, h, h, scale=h**-0.5),
            "attend": random(2 * h, scale=0.1), "out": random(2 * h, scale=0.3), "last": np.zeros(1, np.float32),
        }
        for k in ("word", "char"):
            self.p[k][0] = 0
        self.squares = {k: np.full(v.shape if k not in ("word", "char") else (len(v), 1), 1e-2, np.float32) for k, v in self.p.items()}

    def vectors(self, words: Words) -> np.ndarray:
        """The input of each word, after a row of zeros for no word."""
        x = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(words):
            x[1:, :WORD_DIM] = self.p["word"][words.buckets]
            x[1:, WORD_DIM:] = np.add.reduceat(self.p["char"][words.grams], words.begin, axis=0) / np.sqrt(words.counts)[:, None]
        return x

    def forward(self, words: Words, index: np.ndarray):
        """Logits of windows, given by their words' numbers, and what backward() needs."""
        p, h = self.p, HIDDEN
        n = len(index)
        used, inverse = np.unique(index, return_inverse=True)
        own = words.pick(used[used > 0] - 1)
        of = np.where(index > 0, inverse.reshape(index.shape) + int(used[0] > 0), 0).T
        x = self.vectors(own)[of]
        absent = of == 0
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        steps = []
        for side in (0, 1):
            a = x @ p["in"][side] + p["bias"][side]
            s = np.zeros((n, h), np.float32)
            order = range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1)
            for t in order:
                zr = _sigmoid(a[t, :, : 2 * h] + s @ p["gates"][side])
                z, r = zr[:, :h], zr[:, h:]
                g = np.tanh(a[t, :, 2 * h :] + (r * s) @ p["cand"][side])
                new = s + z * (g - s)
                steps.append((side, t, s, z, r, g))
                s = new
                states[t, :, side * h : (side + 1) * h] = s
        e = states @ p["attend"]
        e[absent] = -30
        e -= e.max(0)
        w = np.exp(e)
        w /= w.sum(0)
        pooled = np.einsum("tn,tnk->nk", w, states)
        logits = pooled @ p["out"] + p["last"][0]
        return logits, (own, of, x, states, steps, w, pooled)

    def projected(self, words: Words) -> list[np.ndarray]:
        """For each direction the input part of the gates of every word (row 0: no word)."""
        x = self.vectors(words)
        return [x @ self.p["in"][side] + self.p["bias"][side] for side in (0, 1)]

    def logits_of(self, inputs: list[np.ndarray], index: np.ndarray) -> np.ndarray:
        """forward() for windows given as rows of projected() (0: no word), a block of windows at a time."""
        return np.concatenate([self._block(inputs, index[i : i + 1024]) for i in range(0, len(index), 1024)])

    def _block(self, inputs: list[np.ndarray], index: np.ndarray) -> np.ndarray:
        p, h, n = self.p, HIDDEN, len(index)
        states = np.empty((WINDOW, 2 * h, n), np.float32)
        for side in (0, 1):
            gates, cand = np.ascontiguousarray(p["gates"][side].T), np.ascontiguousarray(p["cand"][side].T)
            s = np.zeros((h, n), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a = inputs[side][index[:, t]].T
                zr = gates @ s
                zr += a[: 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                g = cand @ (zr[h:] * s)
                g += a[2 * h :]
                np.tanh(g, out=g)
                g -= s
                g *= zr[:h]
                s = s + g
                states[t, side * h : (side + 1) * h] = s
        e = np.einsum("tkn,k->tn", states, p["attend"])
        e[index.T == 0] = -30
        e -= e.max(0)
        w = np.exp(e)
        w /= w.sum(0)
        return np.einsum("tn,tn->n", w, np.einsum("tkn,k->tn", states, p["out"])) + p["last"][0]

    def backward(self, kept, d_logit) -> dict:
        """Gradients of the loss, given its derivative by the logits."""
        p, h = self.p, HIDDEN
        own, of, x, states, steps, w, pooled = kept
        n = of.shape[1]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["out"], g["last"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_w = np.einsum("nk,tnk->tn", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_e[of == 0] = 0
        g["attend"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = w[:, :, None] * d_pooled + d_e[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        carry = np.zeros((n, h), np.float32)
        side_now = None
        for side, t, s, z, r, c in reversed(steps):
            if side != side_now:
                carry, side_now = np.zeros((n, h), np.float32), side
            d = carry + d_states[t, :, side * h : (side + 1) * h]
            d_c = d * z * (1 - c * c)
            d_rs = d_c @ p["cand"][side].T
            d_zr = np.concatenate([d * (c - s) * z * (1 - z), d_rs * s * r * (1 - r)], 1)
            g["cand"][side] += (r * s).T @ d_c
            g["gates"][side] += s.T @ d_zr
            d_a = np.concatenate([d_zr, d_c], 1)
            g["in"][side] += x[t].T @ d_a
            g["bias"][side] += d_a.sum(0)
            d_x[t] += d_a @ p["in"][side].T
            carry = d * (1 - z) + d_rs * r + d_zr @ p["gates"][side].T
        order = np.argsort(of, axis=None, kind="stable")
        first = np.searchsorted(of.ravel()[order], np.arange(1, len(own) + 1))
        if len(own):
            d_own = np.add.reduceat(d_x.reshape(-1, d_x.shape[2])[order], first, axis=0)
            g["word"] = (own.buckets, d_own[:, :WORD_DIM])
            g["char"] = (own.grams, np.repeat(d_own[:, WORD_DIM:] / np.sqrt(own.counts)[:, None].astype(np.float32), own.counts, axis=0))
        return g

    def step(self, g: dict, rate: float) -> None:
        for k, v in g.items():
            if isinstance(v, tuple):
                ids, d = v
                order = np.argsort(ids, kind="stable")
                ids, d = ids[order], d[order]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                ids, d = ids[first], np.add.reduceat(d, first, axis=0)
                d, ids = d[ids != 0], ids[ids != 0]
                self.squares[k][ids] += (d * d).mean(1, keepdims=True)
                self.p[k][ids] -= rate * d / np.sqrt(self.squares[k][ids])
            else:
                self.squares[k] += v * v
                self.p[k] -= (rate / 3) * v / np.sqrt(self.squares[k])

    def restricted(self, words: Words, index: np.ndarray, owner: np.ndarray) -> Words:
        """The words with bucket 0 for words and n-grams that fewer than MIN_TEXTS texts have: what only one text has
        would be learned by heart. Such buckets' embeddings are zero, and stay so."""
        texts = {"word": np.zeros(WORD_BUCKETS, np.int64), "char": np.zeros(CHAR_BUCKETS, np.int64)}
        for at in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            used = np.unique(index[at])
            own = words.pick(used[used > 0] - 1)
            texts["word"][np.unique(own.buckets)] += 1
            texts["char"][np.unique(own.grams)] += 1
        for k, n in texts.items():
            self.p[k][n < MIN_TEXTS] = 0
        out = Words(words.names, np.where(texts["char"][words.grams] < MIN_TEXTS, 0, words.grams), words.counts)
        out.buckets = np.where(texts["word"][words.buckets] < MIN_TEXTS, 0, words.buckets)
        return out

    def train(self, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int) -> None:
        rng = np.random.default_rng(11)
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                k = order[at : at + BATCH]
                logits, kept = self.forward(words, index[k])
                d = (weight[k] * (_sigmoid(logits) - y[k])).astype(np.float32) / len(k) * 8
                self.step(self.backward(kept, d), RATE / (1 + 3 * epoch / epochs))


class Model:
    """A network and the logistic function that turns window logits to a text's score."""

    def __init__(self, network: Network, coefficients: np.ndarray):
        self.network, self.coefficients = network, coefficients

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(pooled_logits(self.network, texts) @ self.coefficients)


NOTHING = -4.0  # the logit of a window that says nothing


def told(index: np.ndarray) -> np.ndarray:
    """The share of different words among each window's words."""
    ordered = np.sort(index, axis=1)
    return (np.diff(ordered, axis=1, prepend=0) > 0).sum(1) / np.maximum(1, (index > 0).sum(1))


def pooled_logits(network: Network, texts: list[str]) -> np.ndarray:
    """For each text: the largest and mean window logit, the mean window probability, its share over many windows, 1. What a
    window says counts by its share of different words: one word again and again says next to nothing."""
    largest, total = np.full(len(texts), -40.0), np.zeros(len(texts))
    toxic, n = np.zeros(len(texts)), np.zeros(len(texts))
    for words, owner, index in windows_of(texts):
        share = np.where(index[:, 0] > 0, told(index), 1)
        logits = NOTHING + share * (np.clip(network.logits_of(network.projected(words), index), -12, 12).astype(np.float64) - NOTHING)
        np.maximum.at(largest, owner, logits)
        np.add.at(total, owner, logits)
        np.add.at(toxic, owner, _sigmoid(logits))
        np.add.at(n, owner, 1)
    n = np.maximum(n, 1)
    return np.stack([largest / 4, total / n / 4, 4 * toxic / n, np.log(n) / 4, np.ones(len(texts))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps on a ridge-penalised log loss."""
    c = np.zeros(x.shape[1])
    pull = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        q = _sigmoid(x @ c)
        c = c - np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + pull, x.T @ (weight * (q - y)) + pull @ c)
    return c


def _taught(texts: list[str]) -> Chunk:
    """Of each text TRAIN_WINDOWS windows at most, evenly spread, and the distinct words of them all."""
    words, owners, indices = NO_WORDS, [], []
    for own, owner, index in windows_of(texts):
        count = np.bincount(owner)[owner]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        least = np.maximum(count, TRAIN_WINDOWS)
        kept = (rank * TRAIN_WINDOWS // least) != ((rank - 1) * TRAIN_WINDOWS // least)
        used, inverse = np.unique(index[kept], return_inverse=True)
        numbers = np.where(used > 0, np.arange(len(used)) - int(used[0] == 0) + 1 + len(words), 0)
        owners.append(owner[kept])
        indices.append(numbers[inverse].reshape(-1, WINDOW))
        words = words.then(own.pick(used[used > 0] - 1))
    _, first, same = np.unique(words.names, return_index=True, return_inverse=True)
    return words.pick(first), np.concatenate(owners), np.append(np.int64(0), same + 1)[np.concatenate(indices)]


def train(texts: list[str], labels: list[int], weight: list[float]) -> Model | None:
    """weight: how many labelled rows each one of the sample stands for. A window of few different words teaches less: by the
    square of their share."""
    y, weight = np.array(labels, np.float64), np.array(weight, np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or not ((y[held] == 1).any() and (y[held] == 0).any()):
        held[:] = False
    words, owner, index = _taught([t for t, h in zip(texts, held) if not h])
    of = y[~held][owner]
    balance = np.where(of == 1, len(of) / max(1, 2 * of.sum()), len(of) / max(1, 2 * (len(of) - of.sum())))
    network = Network()
    network.train(network.restricted(words, index, owner), index, of, balance * told(index) ** 2, min(MOST_EPOCHS, max(EPOCHS, TEACH // len(of))))
    judged = held if held.any() else ~held
    x = pooled_logits(network, [t for t, j in zip(texts, judged) if j])
    return Model(network, fit_logistic(x, y[judged], weight[judged] / weight[judged].mean()))


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Learns from a bounded sample (SAMPLE_ROWS rows and SAMPLE_BYTES of text of each class) of the labelled rows
    outside the held-out fifth."""
    marked = labels.filter((fold(key, 5) != 0) & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    got, counts = labelled_sample(docs, marked, key, text, "_toxic", SAMPLE_ROWS, SAMPLE_BYTES, "toxicity")
    drawn = Counter(y for _, _, y in got)
    return train([t for _, t, _ in got], [y for _, _, y in got], [max(1.0, counts[y] / drawn[y]) for _, _, y in got])


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", score: str = "toxic_score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text to docs, without a shuffle; the model is broadcast (a few MB)."""
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name != score]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[score] = shared.value.scores(texts_of(b[text])) if shared.value else 0.0
            yield b

    return docs.select([f.name for f in kept]).mapInPandas(run, T.StructType([*kept, T.StructField(score, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = score_toxicity(docs.select("doc_id", "text"), train_on(docs, read_table(spark, sf_dir, "labels")), score="score")
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    (score,) = free_names(docs, "toxic_score")
    found = score_toxicity(docs, train_on(docs, read_table(spark, sf_dir, "labels")), score=score)
    return found.filter(F.col(score) < 0.5).select(docs.columns)
