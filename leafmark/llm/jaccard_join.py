"""N-gram Jaccard join: pairs of documents whose sets of word shingles have a Jaccard index of at least a threshold,
found by rare-first prefix filtering and verified once per pair, and the groups that these links form.

1. Each text becomes its set of hashed shingles, in the one pass over the texts. Tasks send packed blocks of hashes,
   one for each range of hashes, not a row for each shingle; documents with equal sets in one block are sent once.
2. Each range counts its shingles over all documents and returns to each document those that others have too. What
   is unique to a document can be in no intersection, so all later steps, verification included, need only these.
   Shingles that a bounded sample finds in many documents (HOT_SHARE) are not sent: they count as most frequent. The
   sample decides the order of shingles and so the cost, never a result: any one order for all documents is right.
3. A document whose unique shingles exceed what the threshold allows has no partner and stops here.
4. The rest order their shingles rare-first. The first |x| - ceil(t|x|) + 1 are the prefix; two sets that pass share a
   shingle of their prefixes. Prefix rows meet by shingle, under the length and the positional filter.
5. Copies of one text would meet all in all. So first each document meets one hub, the one it shares most prefix
   shingles with; what these verified pairs link is one component, and later rounds pair only documents of different
   components, which keeps every component (a link inside a component changes none). Shingles whose documents are all
   of one component leave after each round. The last round pairs all that is left, of near lengths.
6. Each pair is verified once, after the suffix filter, on the two whole sets. Equality of words stands for 64-bit
   hashes of five words each: a wrong link would take hundreds of collisions in one pair.

At scale: ranges and partitions are at most MOST_RANGES, blocks grow with their number, and a range whose shingles exceed
PASS_SHINGLES is counted in several passes over parts of it, so that a task's memory is that of its packed blocks.

Handling of special cases: null, empty and white-space texts have an empty set and link with nothing; fewer words
than k make one shingle; each row gets an answer, and rows with one key count as one document (with all their
shingles, and the size of the largest set); null keys are no documents; very long texts are whole sets; columns of
other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import FEW_IDS, bounded_batches, few, hashed_share, mixed, read_table, shingle_set, stored, texts_of, without

WORDS, THRESHOLD = 5, 75  # shingle length; the least Jaccard index in hundredths
HUB_ROUNDS = 3
BYTES_PER_RANGE = 12_000_000  # of text, for each range of hashes
MOST_RANGES = 1 << 16
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 2000, 0.02, 20  # documents; a hot shingle is in this share and number of them
BLOCK_SHINGLES, MOST_BLOCK, ROW_SHINGLES = 400_000, 4_000_000, 64  # of a block; a block's rows have as many on average
PASS_SHINGLES = 4_000_000


def least_overlap(a, b, percent: int):
    """The smallest intersection of sets of a and b shingles with 100 i >= percent (a + b - i)."""
    return -((a + b) * -percent // (100 + percent))


def least_own(n, percent: int):
    """The smallest intersection of a set of n shingles with any partner's."""
    return -(n * -percent // 100)


# ---------------------------------------------------------------- sets, and the counts of all shingles


def hot_shingles(docs: DataFrame, k: int, rows: int) -> np.ndarray:
    """Sorted shingles of many documents of a bounded sample; at most 1 / HOT_SHARE sets' worth of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in texts_of(b["t"]):
                yield pd.DataFrame({"h": shingle_set(t, k).view(np.int64)})

    share = min(1.0, HOT_SAMPLE / max(1, rows))
    found = docs.filter(hashed_share("k", share, "hot")).select("t").mapInPandas(run, "h long").groupBy("h").count()
    least = max(HOT_LEAST, HOT_SHARE * min(HOT_SAMPLE, rows))
    return np.sort(np.array([r["h"] for r in found.filter(F.col("count") >= least).select("h").collect()], np.int64).view(np.uint64))


HOT_COUNT = (1 << 31) - 1


def sets_of(docs: DataFrame, k: int, percent: int, ranges: int, hot: np.ndarray) -> DataFrame:
    """One row for each document (k, t): doc_id, first (the document of its block that stands for its set), n (the
    set's size); and for those that may have partners also shingles (packed, sorted, without unique ones), set_key (a
    digest, of sets without unique shingles), n_unique and prefix (the shared shingles of the prefix, rare-first).

    Both shuffles carry packed blocks. The first deals hashes to ranges, where they are counted; the second takes
    those that several documents have back to their documents' buckets.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["part", "docs", "sizes", "hashes"]
        most = min(MOST_BLOCK, max(BLOCK_SHINGLES, ROW_SHINGLES * ranges))
        ids, sets_in, size, firsts = [], [], 0, {}

        def blocks() -> pd.DataFrame:
            hashes = np.concatenate(sets_in)
            owner = np.repeat(np.array(ids, np.int64), [len(s) for s in sets_in])
            place = range_of(hashes, ranges).astype(np.int16 if ranges < 32768 else np.int32)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(ranges + 1))
            rows = []
            for r in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[r] : cuts[r + 1]]
                docs_in, sizes = runs(owner[at])
                rows.append((int(r), docs_in.tobytes(), sizes.tobytes(), low_bytes(hashes[at])))
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            own = []
            for i, t in zip(b["k"].tolist(), texts_of(b["t"])):
                s = shingle_set(t, k)
                first = firsts.setdefault(s.tobytes()[:64] + set_digest(s), i) if len(s) else i
                common = s[:0]
                if first == i and len(s):
                    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                    common, rest = named(s[is_hot], ranges), s[~is_hot]
                    if len(rest):
                        ids.append(i)
                        sets_in.append(rest)
                        size += len(rest)
                own.append((-1 - i % ranges, np.array([i, first], np.int64).tobytes(), np.array([len(s)], np.int64).tobytes(), common.tobytes()))
                if size >= most:
                    yield blocks()
                    ids, sets_in, size, firsts = [], [], 0, {}
            yield pd.DataFrame(own, columns=columns)
        if size:
            yield blocks()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "info", "docs", "sizes", "hashes", "counts"]
        held: list[tuple] = []
        part = None

        def counted() -> Iterator[pd.DataFrame]:
            passes = 1 + sum(len(h) for _, _, h in held) // 6 // PASS_SHINGLES
            for k in range(passes):
                parts = [(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint16)), whole(h, part)) for d, n, h in held] if passes == 1 else [some(d, n, h, part, k, passes) for d, n, h in held]
                d, h, many = shared_of(*(np.concatenate(x) for x in zip(*parts)))
                bucket = bucket_of_doc(d, ranges)
                order = np.lexsort((d, bucket))
                d, h, many, bucket = d[order], h[order], many[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(d) else np.empty(0, np.int64)
                rows = []
                for a, z in zip(cuts, np.append(cuts[1:], len(d))):
                    docs_in, sizes = runs(d[a:z])
                    rows.append((int(bucket[a]), False, docs_in.tobytes(), sizes.tobytes(), h[a:z].tobytes(), many[a:z].tobytes()))
                yield pd.DataFrame(rows, columns=columns)

        for b in batches:
            own = []
            for p, d, n, h in zip(b["part"].tolist(), b["docs"], b["sizes"], b["hashes"]):
                if p < 0:
                    own.append((int(bucket_of_doc(np.frombuffer(d, np.int64)[:1], ranges)[0]), True, d, n, h, b""))
                    continue
                if p != part and held:
                    yield from counted()
                    held = []
                part = p
                held.append((d, n, h))
            yield pd.DataFrame(own, columns=columns)
        if held:
            yield from counted()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "first", "n", "shingles", "set_key", "n_unique", "prefix"]
        bucket, info, found = None, [], []

        def gathered() -> pd.DataFrame:
            docs_in = [np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint16)) for d, n, _, _ in found]
            hashes, counts = [np.frombuffer(h, np.uint64) for _, _, h, _ in found], [np.frombuffer(c, np.int32) for _, _, _, c in found]
            sizes: dict[int, int] = {}
            for d, n, h in info:
                i, first = np.frombuffer(d, np.int64).tolist()
                if first == i:
                    sizes[i] = max(sizes.get(i, 0), int(np.frombuffer(n, np.int64)[0]))
                if h:
                    hashes.append(np.frombuffer(h, np.uint64))
                    docs_in.append(np.full(len(h) // 8, first, np.int64))
                    counts.append(np.full(len(h) // 8, HOT_COUNT, np.int32))
            d, h, c = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((docs_in, np.int64), (hashes, np.uint64), (counts, np.int32)))
            order = np.lexsort((h, d))
            d, h, c = d[order], h[order], c[order]
            parts = {}
            for i, n in sizes.items():
                a, z = np.searchsorted(d, [i, i + 1])
                own, at = np.unique(h[a:z], return_index=True)
                if n and len(own) * 100 >= n * percent:
                    unique = max(0, n - len(own))
                    keep = max(0, n - least_own(n, percent) + 1 - unique)
                    parts[i] = (own.tobytes(), set_digest(own) if unique == 0 else None, unique, own[np.lexsort((own, c[a:z][at]))[:keep]].view(np.int64))
            rows = []
            for d, n, _ in info:
                i, first = np.frombuffer(d, np.int64).tolist()
                rows.append((i, first, int(np.frombuffer(n, np.int64)[0]), *((parts.pop(i, None) if i == first else None) or (None, None, 0, None))))
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            for k, is_info, d, n, h, c in zip(b["bucket"].tolist(), b["info"].tolist(), b["docs"], b["sizes"], b["hashes"], b["counts"]):
                if k != bucket and info:
                    yield gathered()
                    info, found = [], []
                bucket = k
                if is_info:
                    info.append((d, n, h))
                else:
                    found.append((d, n, h, c))
        if info:
            yield gathered()

    blocks = docs.mapInPandas(pack, "part int, docs binary, sizes binary, hashes binary")
    counted_rows = blocks.repartition(ranges, "part").sortWithinPartitions("part").mapInPandas(count, "bucket int, info boolean, docs binary, sizes binary, hashes binary, counts binary")
    return counted_rows.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInPandas(gather, "doc_id long, first long, n long, shingles binary, set_key binary, n_unique long, prefix array<long>")


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def bucket_of_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


LOW_48 = np.uint64((1 << 48) - 1)


def low_bytes(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash: the range says the rest."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def whole(low: bytes, part: int) -> np.ndarray:
    """Names of shingles from low_bytes() and their range."""
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((part & 0xFFFF) << 48)


def some(docs: bytes, sizes: bytes, low: bytes, part: int, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents and names of the shingles of a block that are a pass's, by their lowest bits."""
    h = whole(low, part)
    mine = h % np.uint64(turns) == turn
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.uint16))[mine], h[mine]


def named(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The same names from whole hashes."""
    return hashes & LOW_48 | (range_of(hashes, ranges).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)


def runs(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code of documents; longer runs are cut to fit 16 bits."""
    n = len(docs)
    if n == 0:
        return docs, np.empty(0, np.uint16)
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    if n > 65535:
        first = np.unique(np.concatenate([first, np.arange(0, n, 65535)]))
    return docs[first], np.diff(np.append(first, n)).astype(np.uint16)


def shared_of(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashes and numbers of documents, of the hashes that several documents have."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    d, h = docs[order[more]], h[more]
    by = np.lexsort((d, h))
    d, h = d[by], h[by]
    if len(d):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        d, h = d[new], h[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    each = np.diff(np.append(first, len(h)))
    many = np.repeat(each, each)
    return d[many > 1], h[many > 1], many[many > 1].astype(np.int32)


def set_digest(s: np.ndarray) -> bytes:
    return np.array([np.bitwise_xor.reduce(s), (s * (s | np.uint64(1))).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


# ---------------------------------------------------------------- verification


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection of two sorted sets: halves around a's middle element meet only each other."""
    if len(a) == 0 or len(b) == 0 or depth == 0:
        return min(len(a), len(b))
    mid = len(a) // 2
    at = int(np.searchsorted(b, a[mid]))
    same = at < len(b) and b[at] == a[mid]
    return suffix_bound(a[:mid], b[:at], depth - 1) + int(same) + suffix_bound(a[mid + 1 :], b[at + same :], depth - 1)


def linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """a, b: the shingles of two sets, of sizes n_a and n_b, that others have too."""
    least = least_overlap(n_a, n_b, percent)
    if min(len(a), len(b)) < least or suffix_bound(a, b) < least:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


PARTNERS = 256  # that meet one copy of a set


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. a's set goes once to each of its salted shares of at most about
    PARTNERS partners, b's set to the pair."""
    sets = sets.select("doc_id", "n", "shingles")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= FEW_IDS:  # then only their sets are shuffled
        sets = sets.join(F.broadcast(ids), "doc_id", "left_semi")
    dealt = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / PARTNERS)).alias("salt"))
    second = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "n", "shingles")
    first = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(-1).cast("long").alias("b"), "n", "shingles", F.lit(0).alias("turn"))
    met = first.unionByName(second.withColumn("turn", F.lit(1))).repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, n_left = None, 0
        for batch in batches:
            out = []
            for a, b, n, s, turn in zip(*(batch[c].tolist() for c in ("a", "b", "n", "shingles", "turn"))):
                s = np.frombuffer(s, np.uint64)
                if turn == 0:
                    left, n_left = s, n
                elif linked(left, n_left, s, n, percent):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return met.mapInPandas(run, "a long, b long")


# ---------------------------------------------------------------- components


LINKS_PER_TASK = 1 << 18  # that one task contracts at a time


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of links (u, v), ascending, and for each the smallest one that these links reach from it."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(at, 2)
    root = np.arange(len(ids))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return ids, ids[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))  # roots hang on smaller roots
        while (root[root] != root).any():
            root = root[root]


def forests(links: DataFrame) -> DataFrame:
    """Edges (u, v) that join the same documents as the links (a, b) do: each task replaces LINKS_PER_TASK of its links at a
    time by one edge for each of their documents, to the smallest one that they reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def edges() -> pd.DataFrame:
            u, v = contracted(*(np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("a", "b")))
            return pd.DataFrame({"u": u, "v": v})

        for b in batches:
            for at in range(0, len(b), LINKS_PER_TASK):
                part = b.iloc[at : at + LINKS_PER_TASK]
                if n and n + len(part) > LINKS_PER_TASK:
                    yield edges()
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield edges()

    return links.mapInPandas(run, "u long, v long")


def components(links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows of doc_id, component_id (the smallest doc_id reachable) for all documents in the stored links (a, b).

    Tasks contract their own shares of the links first. Up to LINKS_PER_TASK links are one share, and done then; of more,
    alternating large-star and small-star rounds go on until nothing changes (their number grows with the logarithm of the
    longest chain; most_rounds only ends what would never end); each round is a few shuffles of the edges,
    pre-aggregated, and is written to the shared folder."""
    links = links.select("a", "b")
    one = links.count() <= LINKS_PER_TASK
    edges = stored(forests(links.coalesce(1) if one else links), "edges")
    if not one and edges.count() <= LINKS_PER_TASK:
        one, edges = True, stored(forests(edges.toDF("a", "b").coalesce(1)), "edges")
    if one:
        return edges.toDF("doc_id", "component_id")
    edges = edges.filter("u <> v")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(edges)
    for _ in range(most_rounds):
        edges = stored(small_star(large_star(edges)), "edges")
        now = digest(edges)
        if now == seen:
            found = edges.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("doc_id"), "component_id")
            return found.union(found.select("component_id", "component_id").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


# ---------------------------------------------------------------- the join


def passes(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length filter and positional filter for two prefix rows of one token."""
    longest, least = F.greatest(n1, n2), F.least(n1, n2)
    need = F.ceil((n1 + n2) * percent / (100 + percent))
    return (least * 100 >= longest * percent) & (F.least(n1 - p1, n2 - p2) >= need)


def near_lengths(one: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows with one token and different components that pass the filters, the shorter set's row first.
    Rows meet by token and class of length: a class reaches from a length to what the length filter allows with it."""
    length = F.floor(F.log("n") / float(np.log(100 / percent)))
    classed = one.withColumn("class", length)
    longer = one.withColumn("class", F.explode(F.array(length, length - 1)))
    left, right = (x.select("token", "class", *(F.col(c).alias(c + k) for c in ("doc_id", "n", "place", "c"))) for x, k in ((classed, "1"), (longer, "2")))
    ordered = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("doc_id1") < F.col("doc_id2"))
    met = left.join(right, ["token", "class"]).filter(ordered & (F.col("c1") != F.col("c2")) & passes(F.col("n1"), F.col("place1"), F.col("n2"), F.col("place2"), percent))
    return met.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b"))


def links_of(sets: DataFrame, percent: int) -> DataFrame | None:
    """Components (doc_id, component_id) of the sets that link, by verified links that suffice for them."""
    same = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    equal = sets.select("doc_id", "set_key").join(same, "set_key").filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(equal, "links")
    lone = sets.select("doc_id", "n", "n_unique", "prefix").join(links.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    rows = lone.select("doc_id", "n", "n_unique", F.posexplode("prefix").alias("at", "token")).select("token", "doc_id", "n", (F.col("n_unique") + F.col("at")).alias("place"))
    found = components(links) if links.head(1) else None
    tried = None
    for turn in range(HUB_ROUNDS + 1):
        placed = rows.withColumn("c", F.col("doc_id")) if found is None else rows.join(found, "doc_id", "left").select("token", "doc_id", "n", "place", F.coalesce("component_id", "doc_id").alias("c"))
        hub = F.struct("doc_id", "n", "place", "c")
        groups = placed.groupBy("token").agg(F.min("c").alias("least_c"), F.max("c").alias("most_c"), (F.max if turn % 2 else F.min)(hub).alias("h")).filter("least_c != most_c")
        opened = stored(placed.join(groups.select("token", "h"), "token"), "open")  # the only rows that later rounds need
        if not opened.head(1):
            break
        if turn < HUB_ROUNDS:
            near = opened.filter((F.col("c") != F.col("h.c")) & passes(F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place"), percent))
            near = near.groupBy("doc_id", F.col("h.doc_id").alias("h")).agg(F.count(F.lit(1)).alias("shared")).select("doc_id", "shared", F.least("doc_id", "h").alias("a"), F.greatest("doc_id", "h").alias("b"))
            near = near if tried is None else near.join(tried, ["a", "b"], "left_anti")
            pairs = near.groupBy("doc_id").agg(F.max(F.struct("shared", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        else:
            pairs = near_lengths(opened.drop("h"), percent).distinct()
            pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        rows = opened.select("token", "doc_id", "n", "place")
        pairs = stored(pairs, "pairs")
        if not pairs.head(1):
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = stored(verified(pairs, sets, percent), "links")
        if new.head(1):
            known = new if found is None else new.unionByName(found.filter("doc_id != component_id").toDF("a", "b"))
            found = components(known)
    return found


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself
    included) and n_members (documents of the component)."""
    bounded_batches(docs)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    ranges = min(MOST_RANGES, max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size["b"] // BYTES_PER_RANGE)))
    sets = stored(sets_of(rows, k, percent, ranges, hot_shingles(rows, k, size["n"])), "sets")
    found = links_of(sets.filter("shingles is not null").select("doc_id", "n", "shingles", "set_key", "n_unique", "prefix"), percent)
    members = sets.select("doc_id", F.col("n").alias("n_shingles"), "first")
    # the documents of one block with equal sets: the first one stands for them, and the smallest names them
    least = members.groupBy("first").agg(F.min("doc_id").alias("least"))
    named = least if found is None else least.join(found.withColumnRenamed("doc_id", "first"), "first", "left").withColumn("group", F.coalesce("component_id", "first")).drop("component_id")
    named = named.withColumn("group", F.col("first")) if found is None else named
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of = members.join(named.select("first", "group"), "first").join(groups, "group").select("doc_id", "n_shingles", "component_id")
    sizes = of.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_members"))
    return of.join(sizes, "component_id").select("doc_id", "n_shingles", "component_id", "n_members")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that near-copies link, over all whole texts of documents."""
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest doc_id stays; documents without words stay. Of rows
    with one doc_id the least (by all columns) stays, and rows without a doc_id, which no group can name, all stay."""
    one = without(docs, jaccard_groups(docs).filter("component_id <> doc_id"), "doc_id")
    many = one.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id")
    if not many.head(1):
        return one
    many = few(many)  # repeated keys: only their rows are grouped whole
    repeated = one.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return one.join(many, "doc_id", "left_anti").select(docs.columns).unionByName(repeated)
