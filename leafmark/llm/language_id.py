"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and all that is no letter becomes a space; the n-grams of one to three characters are hashed.
A feature's value is its share of the text's n-grams times its inverse document frequency, so a text's logits are the
mean over its n-grams of one table's rows, and very long texts are summed piece by piece. The weights come from
follow-the-regularised-leader with an elastic-net penalty; a temperature fitted on rows kept out of it calibrates the
probabilities. The sample is drawn for each language, so rare ones are learned too, and the languages' true shares
are weighed in afterwards. A text's answer depends on that text alone, not on the rows it is read with.

Handling of special cases: a null or empty text, or one without a letter, is `und` with score 0; ties go to the
language first in alphabetical order; without any labelled row every text is `und`; repeated rows are answered each;
columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import bounded_batches, fold, free_names, read_table, texts_of
from leafmark.llm.grams import Pieces, bounded_sample, chunks, gram_buckets, letters_only

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 4_000_000  # bounds of the training sample, for each language
AHEAD = ORDERS[-1] - 1
COLDEST = 0.05  # least temperature
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: idf times weight, float32
    bias: np.ndarray
    temperature: float
    prior: np.ndarray  # logarithm of each language's share over its share of the sample


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, Pieces, list[np.ndarray], np.ndarray]]:
    """For chunks of the texts: the pieces' places, the pieces, their buckets by order, and which points are letters."""
    for places, held, after in chunks(texts, AHEAD):
        pieces = Pieces([p.lower() for p in held], [a.lower() for a in after], AHEAD)
        cp = letters_only(pieces.cp)
        yield places, pieces, gram_buckets(cp, ORDERS, BUCKETS), cp != 32


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = np.concatenate([b[s:e] for _, p, buckets, _ in _counted([text]) for b in buckets for s, e in zip(p.starts, p.ends)])
    ids, counts = np.unique(found, return_counts=True)
    return ids, counts / len(found)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, l1: float = 0.02, l2: float = 0.2, alpha: float = 4.0, beta: float = 1.0, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of (buckets, values), one pass after the other; returns weights and biases."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, values = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(ids)
            p = _softmax(values @ w)
            p[labels[i]] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm. One row's worth of doubt is spread
    over the languages, so that rows without an error don't make it vanish."""
    n, k = logits.shape
    doubt = 1 / (n + 2)

    def loss(t: float) -> float:
        p = np.maximum(_softmax(logits / np.exp(t)), 1e-300)
        return -((1 - doubt) * np.log(p[np.arange(n), labels]) + doubt * np.log(p).mean(1)).mean()

    a, b, r = np.log(COLDEST), 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(texts: list[str], labels: list[str], totals: dict[str, int] | None = None) -> Model | None:
    """A model of the labelled texts; one in five calibrates the temperature. totals: rows of each language."""
    usable = [(features(t), y) for t, y in zip(texts, labels) if t and y is not None and any(map(str.isalpha, t))]
    if not usable:
        return None
    languages = sorted({y for _, y in usable})
    at = {y: i for i, y in enumerate(languages)}
    y = np.array([at[c] for _, c in usable])
    df = np.bincount(np.concatenate([r[0] for r, _ in usable]), minlength=BUCKETS)
    idf = np.log((1 + len(usable)) / (1 + df)) + 0.05
    scaled = [(ids, values * idf[ids] * 100) for (ids, values), _ in usable]
    held = np.arange(len(usable)) % 5 == 4
    if held.all() or not held.any() or len(usable) < 20:
        held[:] = False
    w, bias = follow_leader([r for r, h in zip(scaled, held) if not h], y[~held], len(languages))
    test = held if held.any() else ~held
    logits = np.array([v @ w[i] + bias for (i, v), h in zip(scaled, test) if h])
    sampled = np.bincount(y, minlength=len(languages)) / len(y)
    rows = np.array([(totals or {}).get(c, n) for c, n in zip(languages, sampled * len(y))], np.float64)
    return Model(languages, (w * idf[:, None] * 100).astype(np.float32), bias, fit_temperature(logits, y[test]), np.log(rows / rows.sum() / sampled))


def predict(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text."""
    if model is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sums, grams, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for places, pieces, buckets, is_letter in _counted(texts):
        for b in buckets:
            np.add.at(sums, places, pieces.sums(model.table[b]))
        np.add.at(grams, places, (pieces.ends - pieces.starts) * len(buckets))
        np.add.at(letters, places, pieces.sums(is_letter.astype(np.int64)))
    p = _softmax((sums / np.maximum(grams, 1)[:, None] + model.bias) / model.temperature + model.prior)
    best = p.argmax(1)
    known = letters > 0
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def train_on(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from a bounded sample (SAMPLE_ROWS, SAMPLE_BYTES of each language) of the labelled rows outside the
    held-out third."""
    got, totals = bounded_sample(docs.filter(fold(key, 3) != 1), key, text, lang, SAMPLE_ROWS, SAMPLE_BYTES, "language")
    return train([t for _, t, _ in got], [y for _, _, y in got], totals)


def identify_languages(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Adds the predicted language and its probability to docs, without a shuffle; the model is a few MB. Columns of
    docs with the names of the new ones are replaced: name others to keep them."""
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name not in (lang_pred, score)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[lang_pred], b[score] = predict(model, texts_of(b[text]))
            yield b

    return docs.select([f.name for f in kept]).mapInPandas(run, T.StructType([*kept, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), train_on(docs), score="score")
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (no letters) or with a probability below LEAST_SCORE go."""
    lang_pred, score = free_names(docs, "lang_pred", "lang_score")
    found = identify_languages(docs, train_on(docs), lang_pred=lang_pred, score=score)
    return found.filter((F.col(lang_pred) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)
