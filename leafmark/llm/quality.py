"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one vector w of weights on hashed character n-grams, shared by all grades,
and ordered thresholds. x is the share of each bucket among the text's n-grams (case kept, digits alike) and its words,
which are in one of two buckets as they repeat the word before or not; so a text's w.x is a mean over these. Results are the expected grade and the tail probability P(grade >= SELECT_FROM), by
which documents are selected. Grades of `labels`: 0 for quality 0; 1 for quality 1 with toxic 1; 2 for quality 1 else.

Handling of special cases: null and empty texts have x = 0 and are never selected (tail probability 0, grade 0);
without ratings of two grades every document has tail probability 0; null ratings teach nothing; of several ratings
the lowest counts; very long texts are summed piece by piece; repeated rows are answered each, equal texts alike,
whatever rows they are read with; columns of other names are left as they are, and columns of docs with the names of
the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import bounded_batches, read_table, texts_of
from leafmark.llm.grams import Pieces, SpanHash, chunks, gram_buckets, labelled_sample, points

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 8_000_000  # bounds of the training sample, for each grade
SELECT_FROM, SELECT_AT = 1, 0.5
AHEAD = ORDERS[-1] - 1
WORD_WEIGHT = 4  # n-grams that a word counts as, by whether it repeats the one before
EPOCHS, RATE, SCALE, PENALTY = 6, 0.3, 30.0, 1e-5


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


def _folded(cp: np.ndarray) -> np.ndarray:
    return np.where((cp >= 48) & (cp <= 57), np.uint32(48), cp)


SAME, NEW = np.unique(gram_buckets(points("SN"), (1,), BUCKETS)[0][::-1])  # buckets of words that repeat the one before, and of others


def _repeats(cp: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the pieces (between white space): the piece's number, and whether it is the word before it."""
    inside = np.ones(len(cp) + 2, np.int8)
    inside[1:-1] = (cp == 32) | (cp >= 9) & (cp <= 13) | (cp == 0xA0)
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    of = np.searchsorted(pieces.starts, begin, side="right") - 1
    own = begin < pieces.ends[of]  # words of what follows a piece aren't its own
    begin, end, of = begin[own], end[own], of[own]
    names = SpanHash(cp).of(begin, end)
    return of, np.concatenate([[False], (names[1:] == names[:-1]) & (of[1:] == of[:-1])])[: len(of)]


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, Pieces, list[np.ndarray], np.ndarray]]:
    """For chunks of the texts: the pieces' places, the pieces, the buckets of their n-grams by order, and for each
    piece how many of its words are new and repeat the one before."""
    for places, held, after in chunks(texts, AHEAD):
        pieces = Pieces(held, after, AHEAD)
        cp = _folded(pieces.cp)
        of, same = _repeats(cp, pieces)
        yield places, pieces, gram_buckets(cp, ORDERS, BUCKETS), np.bincount(2 * of + same, minlength=2 * len(held)).reshape(-1, 2)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, times SCALE."""
    parts = [p for _, pieces, buckets, words in _counted([text]) for p in [*(b[s:e] for b in buckets for s, e in zip(pieces.starts, pieces.ends)), np.repeat([NEW, SAME], WORD_WEIGHT * words.sum(0))]]
    found = np.concatenate(parts) if parts else np.empty(0, np.int32)
    ids, counts = np.unique(found, return_counts=True)
    return ids, counts * (SCALE / max(1, len(found)))


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * np.asarray(x, np.float64)) + 1)


def train(texts: list[str], grades: list[int]) -> Model | None:
    """Stochastic gradients (Adagrad) on the negative log likelihood; thresholds are a first one and positive gaps."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return None
    rows = [features(t) for t in texts]
    y = np.searchsorted(levels, grades)
    k = len(levels)
    share = np.cumsum(np.bincount(y, minlength=k)[:-1]) / len(y)
    theta = np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    w, gw, gf = np.zeros(BUCKETS), np.full(BUCKETS, 1e-4), np.full(k - 1, 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
            s = x @ w[ids]
            upper = _sigmoid(theta[y[i]] - s) if y[i] < k - 1 else 1.0
            lower = _sigmoid(theta[y[i] - 1] - s) if y[i] > 0 else 0.0
            p = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            g = (du - dl) * x + PENALTY * w[ids]
            gw[ids] += g * g
            w[ids] -= RATE * g / np.sqrt(gw[ids])
            d_theta = np.zeros(k - 1)
            if y[i] < k - 1:
                d_theta[y[i]] -= du
            if y[i] > 0:
                d_theta[y[i] - 1] += dl
            d_free = np.concatenate([[d_theta.sum()], [d_theta[j:].sum() * np.exp(free[j]) for j in range(1, k - 1)]])
            gf += d_free * d_free
            free -= RATE * d_free / np.sqrt(gf)
    return Model(levels, w * SCALE, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def grade(model: Model | None, texts: list[str], select_from: int = SELECT_FROM) -> tuple[np.ndarray, np.ndarray]:
    """Expected grades and tail probabilities."""
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    if model is None:
        return sums, n
    for places, pieces, buckets, words in _counted(texts):
        for b in buckets:
            np.add.at(sums, places, pieces.sums(model.weights[b]))
        np.add.at(sums, places, WORD_WEIGHT * words @ model.weights[[NEW, SAME]])
        np.add.at(n, places, (pieces.ends - pieces.starts) * len(ORDERS) + WORD_WEIGHT * words.sum(1))
    below = _sigmoid(model.thresholds - (sums / np.maximum(n, 1))[:, None])
    mass = np.diff(np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], 1))
    levels = np.array(model.grades)
    known = n > 0
    return np.where(known, mass @ levels, 0.0), np.where(known, np.clip(mass[:, levels >= select_from].sum(1), 0, 1), 0.0)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 for quality 0, 1 for quality 1 and toxic 1, 2 for quality 1 else."""
    return labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"))


def train_on(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Learns from a bounded sample (SAMPLE_ROWS rows and SAMPLE_BYTES of text of each grade) of the rated rows."""
    lowest = rated.filter("grade is not null").groupBy(key).agg(F.min("grade").alias("_grade"))
    got, _ = labelled_sample(docs.filter(F.length(text) > 0), lowest, key, text, "_grade", SAMPLE_ROWS, SAMPLE_BYTES, "quality")
    return train([t for _, t, _ in got], [g for _, _, g in got])


def grade_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds expected_grade, tail_probability and selected to docs, without a shuffle."""
    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name not in ("expected_grade", "tail_probability", "selected")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["expected_grade"], b["tail_probability"] = grade(model, texts_of(b[text]))
            yield b

    return docs.select([f.name for f in kept]).mapInPandas(run, T.StructType([*kept, *added])).withColumn("selected", F.col("tail_probability") >= SELECT_AT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every whole text of documents."""
    docs = read_table(spark, sf_dir, "documents")
    return grade_documents(docs.select("doc_id", "text"), train_on(docs, ratings(read_table(spark, sf_dir, "labels")))).drop("text")
