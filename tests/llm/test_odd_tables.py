"""Nulls, empty tables, ties, repeated rows, long texts and clashing columns; fingerprints across buckets."""

import hashlib
import zlib

import numpy as np
import pytest

from leafmark.llm import fingerprints, license_scan, sentencepiece_codec, token_files
from leafmark.llm.common import fresh_path, without

LONG = "A long text says much, again and again. " * 30_000
ROWS = [(3, "b", "x"), (1, None, "x"), (1, "same text here", "y"), (1, "same text here", "y"), (None, "no key", "z"), (2, "", None), (5, LONG, "w"), (4, "Released under the MIT License.", "v")]
KIND = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


def test_licence_scan(spark, docs):
    assert [(r.doc_id, r.family) for r in license_scan.scan(docs).collect()] == [(4, "mit")]
    assert license_scan.scan(docs.limit(0)).count() == 0
    long = license_scan.scan(spark.createDataFrame([(1, LONG + "\nReleased under the MIT License.\n" + LONG, "x")], KIND)).collect()
    assert [(r.paragraph, r.family, r.confirmed) for r in long] == [(1, "mit", True)]


def test_fingerprints_equal_brute_force_across_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints.with_successors, "__defaults__", ("doc_id", "text", 2))
    rng = np.random.default_rng(8)
    rows = [(int(i), "".join(rng.choice(list("abcdef "), int(rng.integers(0, 300))))) for i in rng.permutation(40) * 3] + [(1000, "equal text " * 9), (1001, "equal text " * 9)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows) and got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1
    for (i, mine), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + after[:half]
        a, b, c = (set(fingerprints.winnow(t)[0].tolist()) for t in (mine, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert np.isclose(r.near_edited, len(a & b) / len(a | b) if a | b else 1) and np.isclose(r.near_next, len(a & c) / len(a | c) if a | c else 1)
        assert r.edited_fingerprint == fingerprints.shown(fingerprints.winnow(edited)[0])
    odd = fingerprints.edited_likeness(docs).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(r[0]) for r in ROWS) and fingerprints.edited_likeness(docs.limit(0)).count() == 0


def test_sentencepiece_stage(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sentencepiece_codec.encode_and_decode(docs, model)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded"] or set(got.columns) == {"doc_id", "ids", "n_tokens", "decoded"}
    want = sorted((str(i), lib.encode(t or "")) for i, t, _ in ROWS)
    rows = got.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want and all(r.decoded == lib.decode(list(r.ids)) and r.n_tokens == len(r.ids) for r in rows)
    assert sentencepiece_codec.encode_and_decode(docs.limit(0), model).count() == 0 and sentencepiece_codec.round_trip_digests(docs.limit(0), model).count() == 0


def test_token_files(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    lib, start = Tokenizer.from_file(path), 0
    got = token_files.digests_of_files(token_files.write_token_files(docs, path, fresh_path(spark, "odd"), bytes_per_file=50, rows_per_share=1)).collect()
    want = []
    for i, t in sorted(((i, t or "") for i, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.digests_of_files(token_files.write_token_files(docs.limit(0), path, fresh_path(spark, "none"))).count() == 0


def test_rows_without_a_key_stay(spark, docs):
    gone = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    assert sorted(str(r.doc_id) for r in without(docs, gone, "doc_id").collect()) == sorted(["3", "None", "2", "5", "4"])


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Every stage takes nulls, empty texts, repeated rows, columns named as its own, and an empty table."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{source}/documents.parquet")
    added = ["score", "toxic_score", "lang_pred", "lang_score", "component_id", "item_id"]
    docs = real.selectExpr("*", *(f"doc_id as {c}" for c in added))
    odd = spark.createDataFrame([(None, "the and of a day", None), (-1, None, "en"), (-2, "", None), (-3, "!!", "en"), (-4, "the and of a day here", "en"), (-4, "the and of a day here", "en")], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd, allowMissingColumns=True).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, source)
        assert kept.columns == docs.columns and kept.filter("score <> doc_id or item_id <> doc_id or lang_pred <> doc_id").count() == 0
        assert kept.exceptAll(docs).count() == 0 and kept.count() > 100
        assert stage(spark, docs.limit(0), source).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, source)
    assert last.count() == docs.count() and last.filter("doc_id = -1").first().decoded == "" and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), source).count() == 0
