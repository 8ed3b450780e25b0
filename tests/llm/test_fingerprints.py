"""Fingerprints of short texts and short shared passages."""

import numpy as np

from leafmark.llm import fingerprints


def test_short_edited_texts_stay_alike(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefghijklmnop "), int(n)))) for i, n in enumerate(rng.integers(100, 400, 60))]
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.near_edited > 0 and r.near_next == 0 for r in got)
    for r in got:
        hashes, places = fingerprints.winnow(dict(rows)[r.doc_id])
        assert r.positions == places.tolist() and len(r.edited_positions) == len(r.edited_fingerprint.split())
        assert r.n_selected == len(r.positions) == len(r.fingerprint.split()) == len(hashes)


def test_passages_under_forty_code_points_are_found():
    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    for _ in range(50):
        shared = draw(39)
        a, b = (fingerprints.winnow(draw(700) + shared + draw(700))[0] for _ in range(2))
        assert np.intersect1d(a, b).size
