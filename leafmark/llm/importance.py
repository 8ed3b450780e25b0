"""Target-distribution importance resampling over inverted postings that are partitioned by bucket.

Features of a text are its runs of 1 to ORDERS words; each falls into a bucket by its crc32. A bucket's gain says how much
likelier the target corpus is to draw from it than the source; a document's weight is the sum of its features' gains, and
Gumbel noise on the weights draws documents in proportion to them.

1. Tasks turn texts into blocks of postings (bucket, document, count), one packed row for each block and range of buckets,
   and into totals, one row for each task.
2. Totals of both corpora are summed by bucket, where the bucket's gain is computed (as many rows as there are buckets).
3. Postings are shuffled by range of buckets, together with their range's gains, and give each document's sum over the
   range: one packed row of contributions for each block. Ranges are cut into shares by block, so that no bucket, however
   frequent, is one task's: a share's rows come as a stream after its gains.
4. Contributions are shuffled by block and summed by document.
5. Documents are sorted by score over all tasks; a rank is a task's offset and the place in its share.

Every step's memory is one block's, whatever the sizes of the corpora. Blocks are stored once and read by steps 2 to 4.

Handling of special cases: a null or empty text, or one without words, has no features, weight 0 and no rank; rows that
repeat a key are documents of their own (equal scores, in no certain order); rows without a key have a weight, but no score
and no rank; very long texts are read in pieces that share two words, so that no feature is lost or counted twice; an empty
target gives every bucket t = 0; an empty table gives an empty table; columns of other names aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import LOWER, bounded_batches, read_table, stored, texts_of

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
RANGES = 16  # of buckets
BLOCK_FEATURES, BLOCK_DOCS = 3_000_000, 1 << 16
PIECE_BYTES = 1 << 21  # of a text, at a time
BLOCKS_PER_SHARE = 16
ROWS_PER_SORT_TASK = 1_000_000

# ---------------------------------------------------------------- crc32 of many word runs at once

# Fixed value: the polynomial of crc32.
POLYNOMIAL = 0xEDB88320
LONG = 64  # words of more bytes are hashed one by one


def _byte_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


STEP = _byte_steps()


def _after_zero(x: np.ndarray) -> np.ndarray:
    return STEP[x & 255] ^ (x >> 8)


def _shift_tables() -> np.ndarray:
    """For n up to LONG + 1: what each byte of a crc becomes when n bytes follow."""
    tables = np.zeros((LONG + 2, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 2):
        tables[n] = _after_zero(tables[n - 1])
    return tables.ravel()


SHIFT = _shift_tables()
BITS = np.arange(32, dtype=np.uint32)


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of crcs, given by the images of single bits."""
    return np.bitwise_xor.reduce(np.where(x[:, None] >> BITS & 1, images, np.uint32(0)), axis=1)


def _shifted_far(x: np.ndarray, n: int) -> np.ndarray:
    """Any number of bytes, by repeated squaring."""
    square = _after_zero(np.uint32(1) << BITS)
    while n:
        if n & 1:
            x = _apply(square, x)
        square, n = _apply(square, square), n >> 1
    return x


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the crcs of byte strings contribute to the crc of these followed by n other bytes each."""
    far = n > LONG + 1
    at = np.where(far, 0, n) << 10
    out = SHIFT[at + (crc & 255)] ^ SHIFT[at + 256 + (crc >> 8 & 255)] ^ SHIFT[at + 512 + (crc >> 16 & 255)] ^ SHIFT[at + 768 + (crc >> 24)]
    if far.any():
        for length in np.unique(n[far]):
            mine = np.flatnonzero(n == length)
            out[mine] = _shifted_far(crc[mine], int(length))
    return out


def span_crcs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of spans of bytes: byte by byte for all spans at once, the longest first."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    begin, size = starts[order], lengths[order]
    long = int(np.searchsorted(-size, -LONG, side="left"))
    held, begin, size = crc[long:], begin[long:], size[long:]
    left = np.searchsorted(-size, -np.arange(1, LONG + 1), side="right")  # spans of at least 1, 2, ... bytes
    for k, m in enumerate(left.tolist()):
        if m == 0:
            break
        held[:m] = STEP[(held[:m] ^ raw[begin[:m] + k]) & 255] ^ (held[:m] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        a, n = starts[order[i]], lengths[order[i]]
        crc[i] = zlib.crc32(raw[a : a + n].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ---------------------------------------------------------------- features

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IN_WORD[raw]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    return starts, np.flatnonzero(step == -1) - starts


def pieces_of(data: bytes, orders: int, most: int = PIECE_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text's bytes in pieces of about most bytes, cut between words, and how many words each repeats from before."""
    at, lead, repeated = 0, b"", 0
    while True:
        end = at + most
        while end < len(data) and IN_WORD[data[end]]:
            end += 1
        piece = lead + data[at:end]
        yield piece, repeated
        if end >= len(data):
            return
        tail = np.frombuffer(piece, np.uint8)
        starts, lengths = word_spans(tail)
        last = range(max(0, len(starts) - orders + 1), len(starts))
        lead = b"".join(piece[starts[i] : starts[i] + lengths[i]] + b" " for i in last)
        at, repeated = end, len(last)


def features(pieces: list[bytes], repeated: list[int], buckets: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature its piece's number and its bucket; for each piece its number of words that it doesn't repeat."""
    raw = LOWER[np.frombuffer(b"\0".join(pieces), np.uint8)]
    starts, lengths = word_spans(raw)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    piece = np.searchsorted(ends, starts, side="right")
    first = np.searchsorted(piece, np.arange(len(pieces)))
    own = np.arange(len(starts)) - first[piece] - np.array(repeated, np.int64)[piece]  # place among the piece's new words
    word = span_crcs(raw, starts, lengths)
    after_space = shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), lengths) ^ word
    run, out_piece, out_crc = word, [piece[own >= 0]], [word[own >= 0]]
    for n in range(1, orders):
        run = shifted(run[:-1], lengths[n:] + 1) ^ after_space[n:]
        mine = (piece[n:] == piece[:-n]) & (own[n:] >= 0) if len(piece) > n else np.zeros(0, bool)
        out_piece.append(piece[n:][mine])
        out_crc.append(run[mine])
    return np.concatenate(out_piece), (np.concatenate(out_crc) % np.uint32(buckets)).astype(np.int64), np.bincount(piece[own >= 0], minlength=len(pieces))


# ---------------------------------------------------------------- packing


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small ones take next to nothing."""
    v = values.astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


class Block:
    """Documents in order, and the counts of their (bucket, document) pairs."""

    def __init__(self, buckets: int, orders: int):
        self.buckets, self.orders = buckets, orders
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.none: list[bool] = []
        self.words: list[int] = []
        self.size: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.pieces: list[bytes] = []
        self.repeated: list[int] = []
        self.owner: list[int] = []
        self.waiting = self.held = 0

    def add(self, doc: int, none: bool, text: str) -> None:
        at = len(self.ids)
        self.ids.append(doc)
        self.none.append(none)
        self.words.append(0)
        self.size.append(0)
        for piece, again in pieces_of(text.encode(), self.orders):
            self.pieces.append(piece)
            self.repeated.append(again)
            self.owner.append(at)
            self.waiting += len(piece) + 1
            if self.waiting >= PIECE_BYTES:
                self.count()

    def count(self) -> None:
        if not self.pieces:
            return
        piece, bucket, words = features(self.pieces, self.repeated, self.buckets, self.orders)
        owner = np.array(self.owner, np.int64)
        keys, counts = np.unique(bucket * BLOCK_DOCS + owner[piece], return_counts=True)
        per_doc = np.bincount(owner[piece], minlength=len(self.ids))
        for i in np.unique(owner).tolist():
            self.size[i] += int(per_doc[i])
        for i, n in zip(self.owner, words.tolist()):
            self.words[i] += n
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        self.pieces, self.repeated, self.owner, self.waiting = [], [], [], 0
        if self.held > 2 * BLOCK_FEATURES:  # one very long text: its counts meet
            self.keys, self.counts = ([x] for x in self.pairs())
            self.held = len(self.keys[0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (bucket, document) and their counts."""
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.add.reduceat(counts, new)


DOCUMENTS, POSTINGS, TOTALS = range(3)
BLOCKS = "kind int, target boolean, block long, part int, a binary, b binary, totals array<long>"


def blocks_of(rows: DataFrame, buckets: int, orders: int, target: bool) -> DataFrame:
    """Packed rows of (k, none, t): documents of each block; its postings by range of buckets, unless rows are the
    target's; and each task's totals by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "target", "block", "part", "a", "b", "totals"]
        block, totals, task, n = Block(buckets, orders), np.zeros(buckets, np.int64), TaskContext.get().partitionId(), 0
        cuts = np.arange(RANGES + 1) * buckets // RANGES

        def closed() -> pd.DataFrame:
            block.count()
            keys, counts = block.pairs()
            at = np.searchsorted(keys, cuts * BLOCK_DOCS)
            np.add.at(totals, keys // BLOCK_DOCS, counts)
            out = []
            if not target:
                number = task << 32 | n
                out.append((DOCUMENTS, False, number, -1, packed(np.array(block.ids, np.int64)), packed(np.concatenate([block.none, block.words, block.size]).astype(np.int64)), None))
                for r in range(RANGES):
                    k, c = keys[at[r] : at[r + 1]] - cuts[r] * BLOCK_DOCS, counts[at[r] : at[r + 1]]
                    docs = max(1, len(block.ids))
                    dense = (k // BLOCK_DOCS) * docs + k % BLOCK_DOCS  # so that steps between them are small
                    if len(k):
                        out.append((POSTINGS, False, number, r, packed(np.diff(dense, prepend=0)), packed(np.append(c, docs)), None))
            block.clear()
            return pd.DataFrame(out, columns=columns)

        for b in batches:
            for doc, none, text in zip(b["k"].tolist(), b["none"].tolist(), texts_of(b["t"])):
                block.add(doc, none, text)
                if block.held >= BLOCK_FEATURES or len(block.ids) == BLOCK_DOCS:
                    yield closed()
                    n += 1
        if block.ids:
            yield closed()
        yield pd.DataFrame([(TOTALS, target, -1, -1, None, None, totals)], columns=columns)

    return rows.mapInPandas(run, BLOCKS)


def gains_of(blocks: DataFrame, buckets: int, orders: int) -> DataFrame:
    """Rows of part and gains (its buckets' gains in order), from the totals of both corpora, summed by bucket."""
    totals = blocks.filter(F.col("kind") == TOTALS).select("target", F.posexplode("totals").alias("bucket", "n"))
    of = lambda target: F.sum(F.when(F.col("target") == target, F.col("n")).otherwise(0))
    counts = stored(totals.groupBy("bucket").agg(of(False).alias("s"), of(True).alias("t")), "totals")
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up = (F.col("t") + 1).cast("double") * float(whole["s"] + buckets)
    down = (F.col("s") + 1).cast("double") * float(whole["t"] + buckets)
    gain = F.floor(F.lit(1000.0) * F.log(up / down)).cast("long")
    part = F.floor(((F.col("bucket") + 1) * RANGES - 1) / buckets).cast("int")  # the range that the cuts of blocks_of() give
    return counts.select("bucket", part.alias("part"), gain.alias("gain")).groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def contributions(blocks: DataFrame, gains: DataFrame) -> DataFrame:
    """Rows of block and a (packed: each document's sum over a range of buckets). A share of a range is its gains, then
    its blocks' postings, one after another."""
    postings = blocks.filter(F.col("kind") == POSTINGS)
    shares = max(1, -(-postings.count() // (RANGES * BLOCKS_PER_SHARE)))
    share = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")
    first = gains.select("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("turn"), F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "gains")
    then = postings.select("part", share.alias("share"), F.lit(1).alias("turn"), "block", "a", "b", F.lit(None).cast("array<long>").alias("gains"))
    met = first.unionByName(then).repartition(shares * RANGES, "part", "share").sortWithinPartitions("part", "share", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = np.empty(0)
        for batch in batches:
            out = []
            for turn, block, a, b, g in zip(*(batch[c].tolist() for c in ("turn", "block", "a", "b", "gains"))):
                if turn == 0:
                    gain = np.asarray(g, np.float64)
                    continue
                dense, last = np.cumsum(unpacked(a)), unpacked(b)
                counts, docs = last[:-1], int(last[-1])
                sums = np.bincount(dense % docs, gain[dense // docs] * counts, minlength=docs)  # whole numbers below 2**53
                out.append((block, packed(sums.astype(np.int64))))
            yield pd.DataFrame(out, columns=["block", "a"])

    return met.mapInPandas(run, "block long, a binary")


def weights_of(blocks: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of k, none, n_words, n_features and weight: the contributions of a block's ranges, summed by document."""
    first = blocks.filter(F.col("kind") == DOCUMENTS).select("block", F.lit(0).alias("turn"), "a", "b")
    then = given.select("block", F.lit(1).alias("turn"), "a", F.lit(None).cast("binary").alias("b"))
    met = first.unionByName(then).repartition("block").sortWithinPartitions("block", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = more = sums = None

        def closed() -> pd.DataFrame:
            none, words, size = more.reshape(3, -1)
            return pd.DataFrame({"k": ids, "none": none.astype(bool), "n_words": words, "n_features": size, "weight": sums})

        for batch in batches:
            for turn, a, b in zip(batch["turn"].tolist(), batch["a"], batch["b"]):
                if turn == 0:
                    if ids is not None:
                        yield closed()
                    ids, more = unpacked(a), unpacked(b)
                    sums = np.zeros(len(ids), np.int64)
                else:
                    sums += unpacked(a)
        if ids is not None:
            yield closed()

    return met.mapInPandas(run, "k long, none boolean, n_words long, n_features long, weight long")


# ---------------------------------------------------------------- drawing


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 x) of a Gumbel variate that a hash of the key decides."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, most: int, n: int) -> DataFrame:
    """rows (score, k and others; n of them) with rank 1, 2, ... by descending score and ascending k, null beyond most.

    The rows are dealt by range of their order; each task numbers its share, and the shares' sizes give the offsets."""
    tasks = max(1, -(-n // ROWS_PER_SORT_TASK), min(n // 1000, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(tasks, F.desc("score"), "k").sortWithinPartitions(F.desc("score"), "k")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, share int, at long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.assign(share=np.int32(share), at=np.arange(at, at + len(b)))
            at += len(b)

    numbered = stored(dealt.mapInPandas(run, schema), "numbered")
    sizes = sorted((r["share"], r["m"]) for r in numbered.groupBy("share").agg(F.count(F.lit(1)).alias("m")).collect())  # one row for each task
    offsets = dict(zip((s for s, _ in sizes), np.cumsum([0, *(m for _, m in sizes)]).tolist()))
    before = F.create_map(*(F.lit(x).cast("long") for pair in offsets.items() for x in pair)) if offsets else F.create_map().cast("map<long,long>")
    rank = before[F.col("share").cast("long")] + F.col("at") + 1
    return numbered.withColumn("rank", F.when(rank <= most, rank)).select(*rows.columns, "rank")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, n_features, n_words, weight, score and rank. Of the documents of at least
    least_words words, percent in a hundred are drawn: those of the highest scores, numbered by rank; others have none."""
    bounded_batches(docs)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(key).isNull().alias("none"), F.col(text).alias("t"))
    other = target.select(F.lit(0).cast("long").alias("k"), F.lit(False).alias("none"), F.col(target_text).alias("t"))
    blocks = stored(blocks_of(source, buckets, orders, False).unionByName(blocks_of(other, buckets, orders, True)), "postings")
    weights = weights_of(blocks, contributions(blocks, gains_of(blocks, buckets, orders)))
    scored = stored(weights.withColumn("score", F.when(~F.col("none"), F.col("weight") + gumbel(F.col("k"), seed))), "weights")
    fit = (F.col("n_words") >= least_words) & ~F.col("none")
    n = scored.filter(fit).count()
    drawn = ranked(scored.filter(fit), percent * n // 100, n)
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.when(~F.col("none"), F.col("k")).alias(key), "n_features", "n_words", "weight", "score", "rank")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighs every whole text of documents by the benchmark's texts and draws a twentieth of them."""
    return importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
