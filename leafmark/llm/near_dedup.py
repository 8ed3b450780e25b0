"""MinHash near-dedup by an LSH forest: documents whose sets of word shingles have a Jaccard index of at least a threshold
form groups, of which one document is kept.

1. Each text becomes its set of shingles, and one set of equal ones goes on. Several trees of min-hashes label it: the
   first DEPTHS[level] of a tree name its region, the next ones order the region.
2. All trees' labels are sorted. Neighbours in a region have the longest common prefixes: they are the first candidates, so
   that a group of thousands of near copies is linked by a chain, not by all its pairs.
3. Each document also meets two hubs, the first document of a region and the last of one, of all its regions the likest
   ones: copies of one text, however many, are linked through them.
4. Candidates pass a length filter and a sketch (one bit of each min-hash; DEVIATIONS are allowed), and are confirmed on the
   whole sets of both texts. Links form components.
5. In regions that still hold several components, what is left over meets the rest of its region with its whole set, if at most REGION_DOCS documents are left over there:
   blocks of sets give all their intersections at once, and only links between components leave the task. The documents of
   denser regions go to the next level, with longer labels and more trees, so that depth adapts to each region; at the last
   level this is done for regions of any size.
6. Each level has so many trees that a link of just the threshold has no common region in any with a chance of at most MISS.

Handling of special cases: null, empty and white-space texts have an empty set, link with nothing and are kept; fewer words
than k make one shingle; rows that repeat a key are one document that links with whatever either row links with, and each
gets an answer; rows without a key are no documents; equal sets link; ties have no influence on the result; very long texts
are whole sets; an empty table gives an empty table; columns of other names aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import BASE, bounded_batches, few, mixed, read_table, shingle_set, stored, texts_of
from leafmark.llm.jaccard_join import components, least_overlap, set_digest

WORDS, THRESHOLD = 5, 85  # shingle length; the least Jaccard index in hundredths
DEPTHS = (3, 6, 12)  # min-hashes that name a region, by level
ORDER = 5  # further min-hashes that order a region, of ORDER_BITS each
ORDER_BITS = 12
MISS = 1e-6
SKETCH_BITS, DEVIATIONS = 120, 4.5
REGION_DOCS, BLOCK_DOCS, STREAMED = 2048, 512, 64  # left over in a region; in a block; met by a block at a time
CHUNK = 200_000  # shingles hashed at a time
PARTNERS = 64  # that meet one copy of a text
ROWS_PER_SORT_TASK = 500_000


def trees_for(depth: int, percent: int) -> int:
    """The least number of trees whose regions all part a pair of the threshold with a chance of at most MISS."""
    return ceil(log(MISS) / log(1 - (percent / 100) ** depth))


def least_bits(percent: int, bits: int = SKETCH_BITS) -> int:
    """Equal sketch bits that a pair of the threshold has but for a chance beyond DEVIATIONS."""
    p = (1 + percent / 100) / 2
    return int(bits * p - DEVIATIONS * sqrt(bits * p * (1 - p)))


# ---------------------------------------------------------------- labels


class Labels:
    """Labels of many sets by one level's trees."""

    def __init__(self, depth: int, percent: int):
        self.depth, self.trees = depth, trees_for(depth, percent)
        n = self.trees * (depth + ORDER)
        seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(depth << 32))
        self.flip, self.by = seeds[:n], seeds[n:] | np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each set (none is empty) and tree the region and the order; for each set two words of sketch."""
        parts, group, size = [], [], 0
        for s in sets:
            group.append(s)
            size += len(s)
            if size >= CHUNK:
                parts.append(self._of(group))
                group, size = [], 0
        if group or not parts:
            parts.append(self._of(group))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(sets)
        regions, orders, sketch = np.zeros((n, self.trees), np.uint64), np.zeros((n, self.trees), np.int64), np.zeros((n, 2), np.uint64)
        if n:
            hashes = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
            for p in range(len(self.by)):
                tree, place = divmod(p, self.depth + ORDER)
                least = np.minimum.reduceat((hashes ^ self.flip[p]) * self.by[p], starts)
                if place < self.depth:
                    regions[:, tree] = mixed(regions[:, tree] * np.uint64(BASE) + least + np.uint64(tree))
                else:
                    orders[:, tree] = orders[:, tree] << ORDER_BITS | (least >> np.uint64(20)).astype(np.int64) & ((1 << ORDER_BITS) - 1)
                if p < SKETCH_BITS:
                    sketch[:, p & 1] |= (least >> np.uint64(40) & np.uint64(1)) << np.uint64(p >> 1)
        return regions.view(np.int64), orders, sketch.view(np.int64)


LABELLED = "doc_id long, first long, n long, digest binary, regions array<long>, orders array<long>, s1 long, s2 long"


def labelled(docs: DataFrame, k: int, depth: int, percent: int) -> DataFrame:
    """For each row (k, t) its set's size, and the first document of its task with an equal set, which alone has labels and
    the set's digest; empty sets have neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, firsts = Labels(depth, percent), {}
        for b in batches:
            rows, sets = [], []
            for i, t in zip(b["k"].tolist(), texts_of(b["t"])):
                s = shingle_set(t, k)
                digest = s[:8].tobytes() + set_digest(s) if len(s) else None
                first = firsts.setdefault(digest, i) if digest else i
                new = digest is not None and first == i
                rows.append((i, first, len(s), digest if new else None, len(sets) if new else -1))
                if new:
                    sets.append(s)
                if len(firsts) > 200_000:
                    firsts.clear()
            regions, orders, sketch = labels.of(sets)
            out = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "first", "n", "digest"])
            at = [r[4] for r in rows]
            out["regions"], out["orders"] = ([x[i] if i >= 0 else None for i in at] for x in (regions, orders))
            for j in (0, 1):
                out[f"s{j + 1}"] = [int(sketch[i, j]) if i >= 0 else 0 for i in at]
            yield out

    return docs.select("k", "t").mapInPandas(run, LABELLED)


# ---------------------------------------------------------------- candidates


def alike(n1, n2, equal, percent: int):
    """The length filter, and the sketch's."""
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (equal >= least_bits(percent))


def equal_bits(s1: np.ndarray, s2: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Equal sketch bits of rows with the words s1, s2 and r1, r2."""
    other = [np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in ((s1, r1), (s2, r2))]
    return SKETCH_BITS - other[0] - other[1]


PLACED = "region long, doc_id long, n long, s1 long, s2 long, before long"


def neighbours(sets: DataFrame, percent: int) -> DataFrame:
    """The labels of all trees in sorted order, without those that have their region alone (a task keeps the first and last
    of its rows, whose neighbours it can't see); before is the neighbour before, if it is in the region and may link."""
    rows = sets.select("doc_id", "n", "s1", "s2", F.explode(F.arrays_zip("regions", "orders")).alias("x")).select("x.regions", "x.orders", "doc_id", "n", "s1", "s2").toDF("region", "order", "doc_id", "n", "s1", "s2")
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_SORT_TASK))
    dealt = rows.repartitionByRange(tasks, "region", "order", "doc_id").sortWithinPartitions("region", "order", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in PLACED.split(", ")]
        held, must = None, True  # the task's first row stays

        def found(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
            """rows from the held one on, whose fate is known now; the last one is held, unless it is the task's last."""
            nonlocal held, must
            region, doc, n, s1, s2 = (rows[c].to_numpy(np.int64) for c in ("region", "doc_id", "n", "s1", "s2"))
            same = region[1:] == region[:-1]
            near = same & alike(n[1:], n[:-1], equal_bits(s1[1:], s2[1:], s1[:-1], s2[:-1]), percent)
            keep = np.concatenate([[must], same]) | np.concatenate([same, [last]])
            before = np.where(np.concatenate([[False], near]), np.concatenate([[0], doc[:-1]]), -1)
            if held is not None:
                before[0] = held["before"].iloc[0]
            out = pd.DataFrame({"region": region, "doc_id": doc, "n": n, "s1": s1, "s2": s2, "before": before})
            if not last:
                held, must = out.iloc[-1:], bool(same[-1]) if len(same) else must
                keep[-1] = False
            return out[keep][columns]

        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held[["region", "doc_id", "n", "s1", "s2"]], b], ignore_index=True)
            yield found(rows, False)
        if held is not None:
            yield found(held, True)

    return dealt.mapInPandas(run, PLACED).withColumn("before", F.when(F.col("before") != -1, F.col("before")))


def hubs(placed: DataFrame, last: bool, percent: int) -> DataFrame:
    """Pairs (a, b): each document and its region's first or last one, if they may link; of all its regions the likest."""
    hub = F.struct("doc_id", "n", "s1", "s2")
    chosen = placed.groupBy("region").agg((F.max if last else F.min)(hub).alias("h"))
    equal = SKETCH_BITS - F.bit_count(F.col("s1").bitwiseXOR(F.col("h.s1"))) - F.bit_count(F.col("s2").bitwiseXOR(F.col("h.s2")))
    near = (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")) & (F.col("equal") >= least_bits(percent))
    met = placed.join(chosen, "region").filter(F.col("doc_id") != F.col("h.doc_id")).withColumn("equal", equal).filter(near)
    return met.groupBy("doc_id").agg(F.max(F.struct("equal", F.col("h.doc_id").alias("h"))).alias("x")).select(F.col("doc_id").alias("a"), F.col("x.h").alias("b"))


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and set (packed) of rows (k, t)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, k) for t in texts_of(b["t"])]
            yield pd.DataFrame({"doc_id": b["k"], "n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]})

    return docs.select("k", "t").mapInPandas(run, "doc_id long, n long, set binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of left and right: a product of their incidences over shared elements."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), 1 << 15):
        part = shared[at : at + (1 << 15)]
        filled = []
        for (h, owner), x in zip(sides, (left, right)):
            place = np.minimum(np.searchsorted(part, h), len(part) - 1)
            mine = part[place] == h
            m = np.zeros((len(x), len(part)), np.float32)
            m[owner[mine], place[mine]] = 1
            filled.append(m)
        out += (filled[0] @ filled[1].T).astype(np.int64)  # whole numbers below 2**15
    return out


def across(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents of one region and of different components c, one for two components and group: rows left
    over (whose component isn't the region's least, c1; rest of them in all) with all m rows of the region, a group being a
    block of either. A group's left block is held, its right one comes as a stream."""
    blocks, parts = F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("rest") / BLOCK_DOCS)
    of = lambda k: F.pmod(F.xxhash64("doc_id"), k)
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    rows = opened.drop("n", "s1", "s2").join(sets, "doc_id")
    right = rows.withColumn("lo", every(parts)).withColumn("hi", of(blocks)).withColumn("side", F.lit(1))
    left = rows.filter("c <> c1").withColumn("lo", of(parts)).withColumn("hi", every(blocks)).withColumn("side", F.lit(0))
    columns = ["region", "lo", "hi", "side", "doc_id", "c", "n", "set"]
    met = left.unionByName(right).select(*columns).repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, left, right = None, [], []

        def links() -> list[tuple]:
            sizes = [np.array([r[2] for r in x]) for x in (left, right)]
            both = sizes[0][:, None] + sizes[1]
            ok = intersections([r[3] for r in left], [r[3] for r in right]) * (100 + percent) >= percent * both
            ok &= np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])
            found = {(left[i][1], right[j][1]): (left[i][0], right[j][0]) for i, j in zip(*np.nonzero(ok))}
            return list(found.values())

        for b in batches:
            out = []
            for r, lo, hi, side, *row, s in zip(*(b[c].tolist() for c in columns)):
                if (r, lo, hi) != group or len(right) == STREAMED:
                    out += links() if left and right else []
                    left, right, group = left if (r, lo, hi) == group else [], [], (r, lo, hi)
                (right if side else left).append((*row, np.frombuffer(s, np.uint64)))
            yield pd.DataFrame(out, columns=["a", "b"])
        if left and right:
            yield pd.DataFrame(links(), columns=["a", "b"])

    return met.mapInPandas(run, "a long, b long")


# ---------------------------------------------------------------- links


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the stored distinct pairs (a, b) whose whole sets link. A text goes once to each share of at most about
    PARTNERS of its partners as a, and once to each pair as b."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = docs.join(few(ids), "k", "left_semi")
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    first = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("k", "a"), "a").select("a", "share", F.lit(0).alias("turn"), F.col("a").alias("b"), "t")
    then = dealt.join(texts.withColumnRenamed("k", "b"), "b").select("a", "share", F.lit(1).alias("turn"), "b", "t")
    met = first.unionByName(then).repartition("a", "share").sortWithinPartitions("a", "share", "turn", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, begun = [], False
        for batch in batches:
            out = []
            for a, turn, b, t in zip(batch["a"].tolist(), batch["turn"].tolist(), batch["b"].tolist(), texts_of(batch["t"])):
                s = shingle_set(t, k)
                if turn == 0:
                    left = [s] if begun else [*left, s]  # rows that repeat a key come one after another
                    begun = False
                    continue
                begun = True
                if any(len(x) and len(s) and min(len(x), len(s)) >= (need := least_overlap(len(x), len(s), percent)) and len(np.intersect1d(x, s, assume_unique=True)) >= need for x in left):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return met.mapInPandas(run, "a long, b long")


class Forest:
    """Links found so far, the pairs tried for them, and the components that they form."""

    def __init__(self, docs: DataFrame, equal: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.tried: DataFrame | None = None
        self.found = components(equal) if equal.head(1) else None

    def join(self, candidates: DataFrame) -> None:
        """Confirms candidates (a, b) that weren't tried before and extends the components."""
        pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        pairs = stored(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.head(1):
            return
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.link(confirmed(pairs, self.docs, self.k, self.percent))

    def link(self, links: DataFrame) -> None:
        """Extends the components by confirmed links."""
        links = stored(links.distinct(), "links")
        if links.head(1):
            known = links if self.found is None else links.unionByName(self.found.filter("doc_id <> component_id").toDF("a", "b"))
            self.found = components(known)

    def with_components(self, rows: DataFrame) -> DataFrame:
        if self.found is None:
            return rows.withColumn("c", F.col("doc_id"))
        return rows.join(self.found, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id")

    def still_open(self, rows: DataFrame) -> DataFrame:
        """rows of regions that hold several components, with their component c."""
        placed = self.with_components(rows)
        groups = placed.groupBy("region").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2")
        return placed.join(groups.select("region"), "region", "left_semi")


def counted(opened: DataFrame) -> DataFrame:
    """opened with m, the region's documents, c1, its least component, and rest, its documents of others."""
    least = opened.groupBy("region", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.sum("k").alias("m"), F.min(F.struct("c", "k")).alias("x"))
    return opened.join(least.select("region", "m", F.col("x.c").alias("c1"), (F.col("m") - F.col("x.k")).alias("rest")), "region")


def near_groups(docs: DataFrame, k: int = WORDS, percent: int = THRESHOLD, depths: tuple[int, ...] = DEPTHS, region_docs: int = REGION_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs that has a key: doc_id, n_shingles, component_id (the smallest doc_id reachable by links,
    itself included) and kept (whether it is the component's)."""
    bounded_batches(docs)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    sets = stored(labelled(rows, k, depths[0], percent), "labelled")
    new = sets.filter("digest is not null")
    same = new.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    equal = stored(new.select("doc_id", "digest").join(same, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "equal")
    forest = Forest(rows, equal, k, percent)
    level = new.join(equal.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    for at, depth in enumerate(depths):
        placed = stored(neighbours(level, percent), "placed")
        near = placed.filter("before is not null").select(F.col("doc_id").alias("a"), F.col("before").alias("b"))
        forest.join(near.unionByName(hubs(placed, False, percent)).unionByName(hubs(placed, True, percent)))
        opened = stored(forest.still_open(placed.drop("before")), "open")
        if not opened.head(1):
            break
        left, last = stored(counted(opened), "left"), at + 1 == len(depths)
        met = left if last else left.filter(F.col("rest") <= region_docs)
        if met.head(1):
            ids = met.select(F.col("doc_id").alias("k")).distinct()
            forest.link(across(met, sets_of(rows.join(few(ids), "k", "left_semi"), k), percent))
        if last:
            break
        dense = stored(left.filter(F.col("rest") > region_docs).select(F.col("doc_id").alias("k")).distinct(), "dense")
        if not dense.head(1):
            break
        level = labelled(rows.join(few(dense), "k", "left_semi"), k, depths[at + 1], percent).filter("digest is not null")
        level = stored(level, "labelled")
    members = sets.select("doc_id", "first", F.col("n").alias("n_shingles"))
    # the documents of one task with equal sets: the first one stands for them, and the smallest names them
    least = members.groupBy("first").agg(F.min("doc_id").alias("least"))
    named = least.withColumnRenamed("first", "doc_id")
    named = forest.with_components(named).select(F.col("doc_id").alias("first"), "least", F.col("c").alias("group"))
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of = members.join(named.select("first", "group"), "first").join(groups, "group")
    return of.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over all whole texts of documents."""
    return near_groups(read_table(spark, sf_dir, "documents"))
