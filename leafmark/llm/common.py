"""Helpers shared by the operators: shared storage, ordered partitioning, sampling, hashing of text arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


# ---------------------------------------------------------------- storage that all executors share


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset a folder of our own, if all runs on one machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("leafmark.shared.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        where = f"file://{tempfile.mkdtemp(prefix='leafmark-')}"
        spark.conf.set("leafmark.shared.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/leafmark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW_IDS = 1_000_000  # keys that are broadcast, some 20 MB; more of them are joined by a shuffle


def few(keys: DataFrame) -> DataFrame:
    """The keys, stored, and marked for broadcast where they are at most FEW_IDS."""
    keys = stored(keys, "keys")
    return F.broadcast(keys) if keys.count() <= FEW_IDS else keys


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone; rows without a key stay. Texts aren't shuffled for a few keys."""
    return docs.join(few(gone.select(key).distinct()), key, "left_anti").select(docs.columns)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Lets Spark hand texts to Python workers in smaller batches than its own 10,000 rows, unless told otherwise: a
    task's memory then holds a few MB of usual texts at a time."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it needs to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


# ---------------------------------------------------------------- distributed order


NULL_KEY = -(1 << 63)
MOST_BUCKETS = 50_000


def cut_points(df: DataFrame, key: str, rows_per_bucket: int) -> np.ndarray:
    """Ascending boundaries of about equal shares of the rows by an integer key (null counts as the smallest).

    Only the key column is read. The percentiles are approximate, which results don't depend on: rows are placed
    by comparison. There are at most MOST_BUCKETS shares; beyond, shares hold more rows.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    wanted = min(MOST_BUCKETS, -(-n // rows_per_bucket))
    if wanted <= 1:
        return np.empty(0, np.int64)
    at = [i / wanted for i in range(1, wanted)]
    return np.unique(np.array(df.agg(F.percentile_approx(k, at, 20 * wanted).alias("q")).first()["q"], np.int64))


def bucket_of(key: str, cuts: np.ndarray) -> Column:
    """The number of boundaries at or below the key: equal keys share a bucket, and buckets ascend with the key."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return place(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)))


def hashed_share(key: str, share: float, seed: str) -> Column:
    """True for about this share of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))


def fold(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- hashing


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table of at most a million is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, whole and in order."""
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    values = BYTE_VALUE[LOWER[raw] if lower else raw]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(raw)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, len(raw))[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts, ends


SHINGLE_BASE = 0xD6E8FEB86659FD93


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, weight = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += words[j : j + n] * np.uint64(weight)
        weight = weight * SHINGLE_BASE & MASK
    return mixed(out + np.uint64(k))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct uint64 hashes of the k-word shingles of a text.

    Fewer words than k make one shingle of them all; no words (null, empty, white space) make an empty set.
    """
    words = word_hashes((text or "").encode())[0]
    if len(words) == 0:
        return words
    return np.unique(window_hashes(words, min(k, len(words))))


def texts_of(series) -> list[str]:
    """A column's texts with nulls as empty texts."""
    return [t if isinstance(t, str) else "" for t in series.tolist()]
