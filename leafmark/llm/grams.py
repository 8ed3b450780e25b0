"""Texts as code-point arrays: folding, words, hashed character n-grams, computed for many texts at once in chunks
of bounded length, and bounded samples for training."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import BASE, INVERSE, mixed, powers

CHUNK_CHARS = 400_000
LAST_POINT = 0x10FFFF


_letters: list[np.ndarray] = []


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letters_only(cp: np.ndarray) -> np.ndarray:
    """Code points with everything that is no letter, on any plane, turned to spaces."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(LAST_POINT + 1)]))
    return np.where(_letters[0][cp], cp, np.uint32(32))


def chunks(texts: list[str], ahead: int, most: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """Places of consecutive pieces, the pieces, and what follows each in its text (ahead characters at most).

    Texts are whole pieces, but those longer than most are cut every most characters, at places that only the text
    decides. With what follows, sums over the pieces of a text are sums over the text."""
    places, held, after, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), most):
            piece = t[at : at + most]
            if size and size + len(piece) > most:
                yield np.array(places), held, after
                places, held, after, size = [], [], [], 0
            places.append(i)
            held.append(piece)
            after.append(t[at + most : at + most + ahead])
            size += len(piece)
    if places:
        yield np.array(places), held, after


class Pieces:
    """Code points of pieces of texts, each with what follows it (spaces at a text's end), so that the n-grams that
    begin in a piece are those of its text, whatever its neighbours are."""

    def __init__(self, pieces: list[str], after: list[str], ahead: int):
        tails = [(a + " " * ahead)[:ahead] for a in after]
        self.cp = points("".join(x for pair in zip(pieces, tails) for x in pair))
        sizes = np.array([len(p) for p in pieces])
        self.starts = np.concatenate([[0], np.cumsum(sizes + ahead)[:-1]])
        self.ends = self.starts + sizes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each piece the sum of values (one for each code point) over it, without what follows."""
        bounds = np.stack([self.starts, self.ends], 1).ravel()
        return np.add.reduceat(values, bounds, axis=0)[::2]


def gram_buckets(cp: np.ndarray, orders: tuple[int, ...], buckets: int) -> list[np.ndarray]:
    """For each order n, the bucket of the n-gram that begins at each code point (the last n-1 are incomplete)."""
    x = mixed(cp.astype(np.uint64) + np.uint64(1))
    out = []
    for n in orders:
        h = np.zeros(len(cp), np.uint64)
        for j in range(n):
            h[: len(cp) - j] = h[: len(cp) - j] * np.uint64(BASE) + x[j:]
        out.append((mixed(h + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int32))
    return out


def joined(pieces: list[str], lead: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all pieces, each after a separator, and where each begins."""
    lowered = [lead + p.lower() for p in pieces]
    sizes = np.array([len(p) for p in lowered])
    return points("".join(lowered)), np.concatenate([[0], np.cumsum(sizes)[:-1]])


class SpanHash:
    """Polynomial hashes of any spans of a code-point array."""

    def __init__(self, cp: np.ndarray):
        n = len(cp)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(cp.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


LONGEST_TAUGHT = 1_000_000  # bytes: longer texts don't teach, so that a sample's bound holds


def bounded_sample(rows: DataFrame, key: str, text: str, label: str, most_rows: int, most_bytes: int, seed: str) -> tuple[list[tuple], dict]:
    """A sample of (key, text, label) by hash of the key, in an order that only depends on the rows, and the number of
    rows of each label. Of each label it has about most_rows rows and most_bytes bytes of text at most; only texts of up
    to LONGEST_TAUGHT bytes are drawn. Rows without a text or a label teach nothing; labels must be few."""
    usable = rows.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.octet_length(text) <= LONGEST_TAUGHT)).select(key, text, label)
    sizes = usable.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).collect()
    share = {r[label]: min(1.0, most_rows / r["n"], most_bytes / max(1, r["b"])) for r in sizes}
    if not share:
        return [], {}
    of_label = F.create_map(*(F.lit(x) for y, s in sorted(share.items()) for x in (y, int(1_000_000 * s))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(text)), F.lit(1_000_000)) < of_label[F.col(label)]
    got = usable.filter(drawn).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (hash_order(r[0]), r[1], str(r[2]))), {r[label]: r["n"] for r in sizes}


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_rows: int, most_bytes: int, seed: str) -> tuple[list[tuple], dict]:
    """bounded_sample() of the documents that labels (one row for each key) has a label for, and the labels' counts.

    The labels' sample is drawn first; it has about most_rows rows of each label, so it is broadcast and no text is
    shuffled, however many documents are labelled."""
    counts = {r[label]: r["n"] for r in labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], {}
    of_label = F.create_map(*(F.lit(x) for y, n in sorted(counts.items()) for x in (y, int(1_000_000 * min(1.0, most_rows / n)))))
    chosen = labels.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < of_label[F.col(label)])
    got, _ = bounded_sample(docs.select(key, text).join(F.broadcast(chosen), key), key, text, label, most_rows, most_bytes, seed)
    return got, counts


def hash_order(key) -> int:
    """A number that orders keys of any type at random."""
    return zlib.crc32(str(key).encode())
