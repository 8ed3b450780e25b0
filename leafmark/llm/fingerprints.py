"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w of them the smallest is chosen, the rightmost one
of equals; a choice is kept once, with its position (from 0, in code points). Two texts that share w + k - 1 code points share a choice.

Handling of special cases: a null text counts as empty; an empty text has an empty fingerprint; a text shorter than
k has one hash, of the whole; fewer than w grams make one window. Very long texts are hashed in segments that overlap
by a window, with the same result. Likeness is the Jaccard index of the chosen hashes; two empty fingerprints are
alike (1.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import BASE, INVERSE, NULL_KEY, bounded_batches, bucket_of, cut_points, mixed, powers, read_table, texts_of

GRAM, WINDOW = 12, 20  # a shared run of 31 code points is found for certain
SEGMENT = 1 << 22
LOW = np.uint64((1 << 24) - 1)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """40-bit rolling hashes of all k-grams, from prefix sums of a polynomial modulo 2**64."""
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1)) >> np.uint64(24)


def chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the windows' smallest hashes, the rightmost of equals, ascending."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    w = min(w, len(hashes))
    keys = hashes << np.uint64(24) | (LOW - np.arange(len(hashes), dtype=np.uint64))
    span, best = 1, keys
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return (LOW - (best & LOW)).astype(np.int64)


def winnow(text: str | None, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by ascending position."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(points))
    grams = len(points) - k + 1
    hashes, places = [], []
    for at in range(0, max(1, grams - w + 1), SEGMENT):
        h = gram_hashes(points[at : min(len(points), at + SEGMENT + w - 1 + k - 1)], k)
        p = chosen(h, w)
        hashes.append(h[p])
        places.append(p + at)
    if len(places) == 1:
        return hashes[0], places[0]
    at, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], at


def shown(hashes: np.ndarray) -> str:
    """Hashes as words of ten hexadecimal digits."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex(" ", 5) if len(hashes) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets given as sorted distinct hashes."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame, k: int = GRAM, w: int = WINDOW, text: str = "text") -> DataFrame:
    """Adds fp_hashes and fp_positions (arrays of long) to docs, without a shuffle."""
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name not in ("fp_hashes", "fp_positions")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [winnow(t, k, w) for t in texts_of(b[text])]
            b["fp_hashes"] = [h.astype(np.int64) for h, _ in found]
            b["fp_positions"] = [p for _, p in found]
            yield b

    longs = T.ArrayType(T.LongType())
    return docs.select([f.name for f in kept]).mapInPandas(run, T.StructType([*kept, T.StructField("fp_hashes", longs), T.StructField("fp_positions", longs)]))


def with_successors(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 1000) -> DataFrame:
    """Rows of bucket, tail, k, t such that, sorted by the first three (and t), each row's successor by key follows it.

    A bucket ends with a copy (tail) of the first row of the bucket after it; the last bucket's tail is the first row
    of all. The keys' boundaries and the buckets' first keys, at most MOST_BUCKETS of each, are what the driver holds.
    """
    cuts = cut_points(docs, key, rows_per_bucket)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"), F.col(text).alias("t"))
    firsts = sorted((r["b"], r["k"]) for r in rows.select("k", bucket_of("k", cuts).alias("b")).groupBy("b").agg(F.min("k").alias("k")).collect())
    first_keys = np.array([k for _, k in firsts], np.int64)
    previous = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int32)

    @F.pandas_udf("int")
    def tail_of(keys: pd.Series) -> pd.Series:
        x = keys.to_numpy(np.int64)
        i = np.minimum(np.searchsorted(first_keys, x), len(first_keys) - 1)
        return pd.Series(np.where(first_keys[i] == x, previous[i], -1).astype(np.int32))

    placed = rows.select("k", "t", F.explode(F.filter(F.array(F.struct(bucket_of("k", cuts).alias("bucket"), F.lit(False).alias("tail")), F.struct(tail_of("k").alias("bucket"), F.lit(True).alias("tail"))), lambda x: x["bucket"] >= 0)).alias("p"))
    return placed.select("p.bucket", "p.tail", "k", "t").repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "tail", "k", "t")


def edited_likeness(docs: DataFrame, k: int = GRAM, w: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text, in which the last half is replaced by the beginning
    of the next document, the likeness to both, and the places of the chosen hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # bucket, key, text, hashes, sorted hashes, positions of the row that waits for its successor

        def row(after: str, next_set: np.ndarray) -> tuple:
            _, at, mine, hashes, own, places = held
            half = len(mine) // 2
            edited = mine[: len(mine) - half] + after[:half]
            changed, changed_places = winnow(edited, k, w)
            return (at, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(hashes), shown(changed), likeness(own, np.unique(changed)), likeness(own, next_set), len(hashes), places, changed_places)

        for b in batches:
            out = []
            for bucket, tail, at, t in zip(b["bucket"].tolist(), b["tail"].tolist(), b["k"].tolist(), texts_of(b["t"])):
                if tail and held is None:  # a further row with the same key as the first tail
                    continue
                hashes, places = winnow(t, k, w)
                own = np.unique(hashes)
                if held is not None:
                    out.append(row(t, own))
                held = None if tail else (bucket, at, t, hashes, own, places)
            yield pd.DataFrame(out, columns=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_selected", "positions", "edited_positions"])

    schema = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected long, positions array<long>, edited_positions array<long>"
    bounded_batches(docs)
    found = with_successors(docs, key, text).mapInPandas(run, schema)
    return found.withColumn(key, F.when(F.col(key) != NULL_KEY, F.col(key)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents and of its edited text."""
    return edited_likeness(read_table(spark, sf_dir, "documents"))
