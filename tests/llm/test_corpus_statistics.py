"""Importance resampling, cross-tokenizer alignment and near-dedup against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from leafmark.llm import alignment, importance, near_dedup

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, score string, block string"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "one two"), (10**6 + 4, "é" * 90 + " ß" * 30), (10**6 + 5, "A b C " * 3000), (10**6 + 5, "A b C " * 3000), (10**6 + 6, "x" * 70_000 + " y " + "z" * 66), (10**6 + 7, "!!! ... ???")]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    return real + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "b") for r in rows], KIND).repartition(5).cache()


# ---------------------------------------------------------------- importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_importance(rows, target):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    total, other = sum(s.values()), sum(t.values())
    made = []
    for i, text in rows:
        found = buckets_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (other + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        made.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    fit = sorted((r for r in made if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    return made, [r[0] for r in fit[: 5 * len(fit) // 100]]


@pytest.mark.parametrize("small", [False, True])
def test_importance_equals_a_plain_version(spark, docs, rows, monkeypatch, small):
    if small:  # many blocks, pieces and shares
        for name, value in (("PIECE_BYTES", 1000), ("BLOCK_FEATURES", 2000), ("BLOCKS_PER_SHARE", 1)):
            monkeypatch.setattr(importance, name, value)
        monkeypatch.setattr(importance.pieces_of, "__defaults__", (1000,))
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = importance.importance(docs, target).collect()
    made, drawn = plain_importance(rows, [r.text for r in target.collect()])
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(r[:4] for r in made)
    assert [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_importance_of_rows_without_a_key_and_of_nothing(spark, docs):
    target = docs.limit(3).select("text")
    keyless = spark.createDataFrame([(None, "a b c " * 20, "", "")], KIND)
    got = importance.importance(keyless, target).collect()
    assert len(got) == 1 and (got[0].doc_id, got[0].score, got[0].rank, got[0].n_features) == (None, None, None, 177)
    assert importance.importance(docs.limit(0), target).count() == 0
    assert importance.importance(docs, target.limit(0)).filter("rank is not null").count() > 0


def test_crc_of_runs_of_any_length():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 256, int(n), np.uint8).tobytes() for n in rng.integers(0, 400, 2))
        crc = np.array([zlib.crc32(a)], np.uint32)
        assert importance.shifted(crc, np.array([len(b)]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)
    raw = np.frombuffer(a + b, np.uint8)
    starts = np.array([0, 1, 2, 0, 5]) if len(raw) > 5 else np.zeros(1, int)
    sizes = np.array([len(raw), 0, 3, 1, 64])[: len(starts)]
    want = [zlib.crc32(raw[s : s + n].tobytes()) for s, n in zip(starts, sizes)]
    assert importance.span_crcs(raw, starts, sizes).tolist() == want


# ---------------------------------------------------------------- alignment


def plain_alignment(a, la, b, lb):
    """Groups as text, and the pairs of tokens that overlap, by offsets alone."""
    ea, eb = np.cumsum(la), np.cumsum(lb)
    links = [(x, y) for x, e, n in zip(a, ea, la) for y, f, m in zip(b, eb, lb) if max(e - n, f - m) < min(e, f)]
    groups, before = [], 0
    for end in sorted(set(ea.tolist()) & set(eb.tolist())):
        sides = [",".join(str(t) for t, e in zip(x, ends) if before < e <= end) for x, ends in ((a, ea), (b, eb))]
        groups.append("|".join(sides))
        before = end
    return groups, links


def test_alignment_equals_a_plain_version(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    for name, value in (("BLOCK_WORDS", 60), ("GROUP_CHARS", 300), ("CALL_WORDS", 7), ("EXPANDED", 50)):
        monkeypatch.setattr(alignment, name, value)
    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    lib, other = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    lib.encode_special_tokens = True
    real = [(r.doc_id, r.text[:900]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    odd = ["", None, " ", "  a  b ", "a\0b", "x \n y", "▁ab c", "<|endoftext|> hi <s> </s>", "\x1cq", "é" * 70 + " z", "a\xa0b  　c", "日本語 テキスト\U0001f600", "the same", "the same", "\n", "tab\tsep x", "<unk> <0x41>"]
    rows = real + [(5000 + i // 2, t) for i, t in enumerate(odd)] + [(None, "no key")]
    of = alignment.byte_alphabet()
    made, held = [], collections.Counter()
    for i, t in rows:
        one = None
        if t:
            a, b = lib.encode(" " + t, add_special_tokens=False).ids, other.encode(t)
            x = [bytes(of[c] for c in lib.id_to_token(k)) for k in a]
            y = [bytes([int(other.id_to_piece(k)[1:-1], 16)]) if other.is_byte(k) else other.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                one = (a, b, *plain_alignment(a, [len(k) for k in x], b, [len(k) for k in y]))
                held.update(set(one[3]))
        made.append((i, one))
    best = collections.Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = [(i, 0, 0, 0, 0, 0, 0, "") if o is None else (i, len(o[0]), len(o[1]), len(o[2]), len(o[3]), sum(held[p] == best[p[0]] for p in o[3]), sum(held[p] for p in o[3]), hashlib.sha256(";".join(o[2]).encode()).hexdigest()) for i, o in made]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND).repartition(3)
    got = alignment.aligned(docs, *paths)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert alignment.aligned(docs.limit(0), *paths).count() == 0


def test_shards_find_counts_in_memory_maps(spark, tmp_path):
    keys = np.sort(np.random.default_rng(3).choice(1 << 40, 5000, replace=False))
    rows = [(int(k), int(n)) for k, n in zip(np.repeat(keys, 2), range(10000))]
    random.Random(1).shuffle(rows)
    table = alignment.written_shards(spark.createDataFrame(rows, "key long, n long"), f"file://{tmp_path}/t", 10_000_000)
    files = sorted((r["first"], r["path"]) for r in table.filter("path is not null").collect())
    assert len(files) > 1
    shards = alignment.Shards(np.array([f for f, _ in files]), [p for _, p in files])
    assert shards.counts(keys).tolist() == [4 * i + 1 for i in range(5000)] and all(isinstance(x[0], np.memmap) for x in shards.open.values())
    best = {r.a: r.m for r in table.filter("a is not null").groupBy("a").agg({"best": "max"}).withColumnRenamed("max(best)", "m").collect()}
    assert best == {a: max(4 * i + 1 for i in np.flatnonzero(keys >> 32 == a).tolist()) for a in np.unique(keys >> 32).tolist()}
    with pytest.raises(ValueError):
        shards.counts(np.array([keys[0] + 1]))


# ---------------------------------------------------------------- near-dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows, percent=85):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (i, s) in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def families(seed):
    """Copies whose likeness to each other lies about the threshold: some link, many just don't."""
    rng, out = random.Random(seed), []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(rng.choice([2, 5, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return [(2 * 10**6 + i, t) for i, t in enumerate(out)]


def test_near_dedup_equals_brute_force(spark, rows):
    all_rows = rows + families(1)
    docs = spark.createDataFrame([(*r, "s", "b") for r in all_rows], KIND).repartition(5)
    got = near_dedup.near_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == plain_groups(all_rows)


def test_near_dedup_of_dense_regions(spark, monkeypatch):
    """No hubs, so that blocks of all levels do the work."""
    monkeypatch.setattr(near_dedup, "hubs", lambda placed, last, percent: placed.limit(0).selectExpr("doc_id as a", "doc_id as b"))
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dedup, "STREAMED", 3)
    many = families(2)
    docs = spark.createDataFrame([(*r, "s", "b") for r in many], KIND).repartition(4)
    got = near_dedup.near_groups(docs, depths=(2, 4), region_docs=4).collect()
    assert sorted(map(tuple, got)) == plain_groups(many)


def test_near_dedup_without_keys_words_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "nothing alike here at all", "", ""), (2, "A b C d e F", "", ""), (3, None, "", "")], KIND)
    got = sorted(map(tuple, near_dedup.near_groups(docs).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_intersections_of_many_sets():
    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in rng.integers(1, 90, m)] for m in (7, 4))
    assert near_dedup.intersections(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
