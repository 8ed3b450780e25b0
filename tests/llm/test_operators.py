"""The training-data operators against brute force, libraries and planted cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import decontamination, fingerprints, html_extraction, jaccard_join, language_id, license_scan, quality, queries, sentencepiece_codec, token_files, toxicity
from leafmark.llm.common import fresh_path

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "Ünï  cödé ▁ <s> \U0001f600", "x" * 3000, "the same words " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(100, "one two three four five six", None, 0), (101, "one two three four five six", "fr", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def word_set(text):
    """Shingles as tuples of words, by the contract's own words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = collections.defaultdict(set)
    sizes = collections.Counter()
    for i, t in rows:
        own = word_set(t)
        sets[i] |= own
        sizes[i] = max(sizes[i], len(own))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for h in s:
            where[h].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for h in s for j in where[h] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (sizes[i], find(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark, docs):
    for table in (spark.read.parquet(f"{DATA}/documents.parquet"), docs):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(table).collect()}
        assert got == brute_components([(r.doc_id, r.text) for r in table.collect()])


def test_jaccard_join_of_no_rows(spark, docs):
    assert jaccard_join.jaccard_groups(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one_of_each_group(spark, docs.limit(0), "").count() == 0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_join_of_hot_groups_equals_brute_force(spark, monkeypatch):
    """Copies, near copies at and about the threshold, a line that all share, and ranges counted in several passes."""
    monkeypatch.setattr(jaccard_join, "PASS_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "BYTES_PER_RANGE", 20_000)
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(30))
    bases = [[f"b{k}x{i}" for i in range(rng.randint(8, 150))] for k in range(12)]
    texts = [" ".join(bases[0])] * 60 + [edited(rng, bases[1], rng.randint(0, 6)) for _ in range(80)]
    texts += [edited(rng, rng.choice(bases), rng.randint(0, 5)) for _ in range(150)] + [line + " " + edited(rng, rng.choice(bases), 8) for _ in range(80)]
    texts += [line + f" t{i}" for i in range(25)] + ["x" * 20_000, None, "", " ", "One two", "one TWO", "one two three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_members) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert {i: g[:2] for i, g in got.items()} == want
    sizes = collections.Counter(c for _, c in want.values())
    assert all(g[2] == sizes[g[1]] for g in got.values())


def test_the_stage_keeps_one_of_each_group(spark):
    rows = [(2, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "w", 1), (3, None, "x", 1), (3, None, "x", 1), (None, "a b c d e f g", "x", 1), (None, None, "x", 1), (4, "other words are in this one", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int")
    kept = jaccard_join.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f g", "w", 1), (3, None, "x", 1), (4, "other words are in this one", "x", 1), rows[6], rows[7]], key=str)


def test_suffix_bound_is_an_upper_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(2))
        assert jaccard_join.suffix_bound(a, b) >= len(np.intersect1d(a, b))


def test_decontamination_finds_passages_and_new_parameters(spark):
    item = "A train leaves Boston at 9 am and travels 300 miles at 60 miles per hour before it stops near the old river station"
    other = item.replace("Boston", "Denver").replace("300", "450").replace("60", "90")
    clash = "A train leaves Boston at 9 am and travels 300 miles. Nothing else here is like it at all, the weather was fine and warm"
    rows = [(1, "Before. " + item + ". After"), (2, other), (3, clash), (4, None), (5, "")]
    got = {r.doc_id: r.reparameterised for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


def test_decontamination_finds_every_exact_passage(spark):
    d, b = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()}
    want = {(x.doc_id, y.item_id) for x in d.collect() for y in b.collect() if x.text and y.text in x.text}
    assert want and want <= got


def test_language_id_is_right_on_held_out_documents(spark, docs):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify_languages(docs, None).collect()}
    assert set(odd.values()) == {("und", 0.0)}
    model = language_id.train(["the cat and dog"] * 30 + ["le chat et chien"] * 30, ["en"] * 30 + ["fr"] * 30)
    assert language_id.predict(model, [t or "" for t in ODD])[0][:4] == ["und"] * 4


def test_pieces_of_long_texts_sum_up():
    model = language_id.train(["the cat and dog"] * 30 + ["le chat et chien"] * 30, ["en"] * 30 + ["fr"] * 30)
    long = "le chat et le chien sont la " * 40_000
    assert language_id.predict(model, [long])[0] == ["fr"]


def slope(net, words, index, name, at):
    net.p[name][at] += 1e-2
    up = net.forward(words, index)[0].sum()
    net.p[name][at] -= 2e-2
    down = net.forward(words, index)[0].sum()
    net.p[name][at] += 1e-2
    return (up - down) / 2e-2


def test_toxicity_gradient_and_learning():
    net = toxicity.Network()
    words, owner, index = next(toxicity.windows_of(["some words are here to see " * 6, "b"]))
    logits, kept = net.forward(words, index)
    assert np.allclose(logits, net.logits_of(net.projected(words), index), atol=1e-5)
    g = net.backward(kept, np.ones(len(index), np.float32))
    gram = int(words.grams[4])
    for name, row in (("word", int(words.buckets[1])), ("char", gram)):
        ids, d = g[name]
        assert math.isclose(d[ids == row, 2].sum(), slope(net, words, index, name, (row, 2)), rel_tol=0.05, abs_tol=2e-3)
    for name, at in (("out", 3), ("gates", (0, 2, 5)), ("cand", (1, 3, 4)), ("attend", 2)):
        assert math.isclose(slope(net, words, index, name, at), g[name][at], rel_tol=0.05, abs_tol=2e-3)
    good, bad = ["the fine day went on well " * 8] * 60, ["the fine day idiot went on " * 8] * 60
    model = toxicity.train(good + bad, [0] * 60 + [1] * 60, [1.0] * 120)
    scores = model.scores([good[0], bad[0], "", "x" * 50_000])
    assert scores[0] < 0.5 <= scores[1] and 0 <= scores[2] <= 1


def test_long_texts_give_the_same_windows(monkeypatch):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))
    whole = np.concatenate([np.append(np.uint64(0), w.names)[i] for w, _, i in toxicity.windows_of([text])])
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 200)
    cut = np.concatenate([np.append(np.uint64(0), w.names)[i] for w, _, i in toxicity.windows_of([text])])
    assert np.array_equal(whole, cut)


def test_html_extraction(spark):
    article = "<html><head><title>t</title></head><body><nav>menu</nav><main><article><h1>H &amp; x</h1><p>One <b>two</b>.<p>Three&nbsp;four<div class='ad'>ad</div></article></main><section class='comments'>c</section><footer>f</footer></body></html>"
    rows = [(1, "http://a/1", article), (2, None, None), (3, "http://a/3", ""), (4, "x", "plain &lt;text")]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "H & x One two. Three four", 2: "", 3: "", 4: "plain <text"}
    site = [(i, f"http://s/{i}", f"<body><div><span>Follow our site</span></div><p>Text number {i} is here.</p></body>") for i in range(30)]
    texts = {r.text for r in html_extraction.extract_pages(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    assert texts == {f"Text number {i} is here." for i in range(30)}


def test_license_scan_is_native_and_finds_families(spark, docs):
    lines = ["text\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "he lost his fishing license", "mit der Zeit", None, ""]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in found.collect()}
    assert got == {(0, 1): ("mit", True), (1, 0): ("apache-2.0", True), (2, 0): ("gpl", True), (3, 0): ("cc-by-nc", True), (4, 0): ("unknown", False)}
    assert license_scan.scan(docs).count() == 0


def test_license_scores_equal_brute_force(spark):
    table, bias, temperature, least = license_scan.model()
    held = {}
    for f, t in license_scan.LINES:
        for g in license_scan.ngrams(license_scan.tokens(t)):
            held.setdefault(g, set()).update({f} - {"unknown"})
    legal = [{g for g in license_scan.ngrams(license_scan.tokens(t)) if license_scan.is_legal(g) and len(held[g]) <= 4} for f, t in license_scan.LINES]
    lines = [t for _, t in license_scan.LINES] + ["A license for the museum and its garden", "text Licensed under the Apache License and the MIT License text"]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert len(found) == len(lines)
    for i, line in enumerate(lines):
        grams = license_scan.ngrams(license_scan.tokens(line))
        known = [g for g in grams if g in table]
        z = (np.array(bias) + sum((np.array(table[g][0]) for g in known), np.zeros(len(bias))) / math.sqrt(max(1, len(known)))) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, own = license_scan.FAMILIES[int(p.argmax())], {g for g in grams if license_scan.is_legal(g) and (g not in table or 1 <= len(held.get(g, ())) <= 4)}
        told = collections.Counter(min(held[g]) for g in own if len(held.get(g, ())) == 1)
        share = max(len(own & t) / max(1, min(len(own), len(t))) for (f, _), t in zip(license_scan.LINES, legal) if f == family)
        others = max([0, *(n for f, n in told.items() if f != family)])
        share *= others == 0 or told[family] > others
        if family == license_scan.UNKNOWN or p.max() < least and not (p.max() >= license_scan.LIKELY and share >= license_scan.CONFIRM):
            family, share = license_scan.UNKNOWN, 0
        assert math.isclose(found[i].probability, p.max(), abs_tol=1e-5) and found[i].family == family
        assert math.isclose(found[i].template_share, share, abs_tol=1e-5) and found[i].confirmed == (share >= license_scan.CONFIRM)


def test_quality_tells_junk_from_prose(spark):
    found = queries.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([(r.selected) == (r.quality == 1) for r in found]) > 0.95
    model = quality.train(["aa bb"] * 20 + ["!! ??"] * 20 + ["cc dd"] * 20, [1] * 20 + [0] * 20 + [2] * 20)
    assert all(np.diff(model.thresholds) > 0)
    grades, tails = quality.grade(model, ["!! ??", "cc dd", ""])
    assert grades[0] < grades[1] and tails[0] < tails[1] and tails[2] == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    k, w = fingerprints.GRAM, fingerprints.WINDOW
    shared = text[500 : 500 + w + k - 1]
    a, _ = fingerprints.winnow(text)
    b, _ = fingerprints.winnow("zz" * 40 + shared + "yy" * 40)
    assert np.intersect1d(a, b).size > 0
    hashes = fingerprints.gram_hashes(fingerprints.np.frombuffer(text.encode("utf-32-le"), "<u4"), k)
    want = sorted({max(range(i, i + w), key=lambda j: (-int(hashes[j]), j)) for i in range(len(hashes) - w + 1)})
    assert list(fingerprints.winnow(text)[1]) == want


def test_edited_texts(spark, docs):
    table = docs.filter("doc_id < 50")
    rows = [t or "" for t in ODD]
    for r in fingerprints.edited_likeness(table).collect():
        mine, after = rows[r.doc_id], rows[(r.doc_id + 1) % len(rows)]
        half = len(mine) // 2
        assert r.edited_sha256 == hashlib.sha256((mine[: len(mine) - half] + after[:half]).encode()).hexdigest() and r.n_chars == len(mine)


def test_sentencepiece_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    mine = sentencepiece_codec.codec(tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = lib.encode(t)
        assert mine.encode(t) == ids and mine.decode(ids) == lib.decode(ids)


def test_token_files_round_trip(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    manifest = token_files.write_token_files(docs, tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "t"), bytes_per_file=400, rows_per_share=2)
    start = 0
    got = sorted(token_files.digests_of_files(manifest).collect(), key=lambda r: r.doc_id)
    for r, d in zip(got, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in token_files.read_token_files(manifest, np.array([4, 100])).collect()} == {4, 100}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == columns and kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, DATA).filter(F.col("n_tokens") != F.size("ids")).count() == 0


def test_byte_encoder_equals_the_library_across_generations(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmark.llm import token_files

    monkeypatch.setattr(token_files, "KEPT", 3)
    monkeypatch.setattr(token_files, "GROUP_CHARS", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", " ", "a\x1cb!\x1c c", " x  y \n\n\n z\t", "it's  a　b   ¬ <|endoftext|> q", "w" * 300 + " \U0001f600 end", " \x1d a", "the cat\r\n the  cat"] * 2
    found = token_files.ByteEncoder(path).encode_all(texts)
    wanted = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [f.tolist() for f in found] == [w.ids for w in wanted]


def test_plain_pieces_spare_the_pattern_and_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    enc = token_files.ByteEncoder(path)
    sent = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return lib.encode_batch_fast(texts, **kw)

    enc.library = Counted()
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é{'%%%' if i % 3 else ','}" for i in range(600)]
    texts = ["at " + " ".join(words)] * 3 + [" a" + chr(c) + "b x" + chr(c) for c in range(1, 0x260)] + ["it's don't, x'y ×a a÷ ª1 ǀ! ɐ.", "", " ", "  a"]
    found = enc.encode_all(texts[:3])
    assert sum(map(len, sent)) < 10  # the texts' first word alone
    found += enc.encode_all(texts[3:])
    assert [f.tolist() for f in found] == [w.ids for w in lib.encode_batch_fast(texts, add_special_tokens=False)]
