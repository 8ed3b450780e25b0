"""Benchmark decontamination: verbatim items of every kind, re-parameterised ones, and clean documents."""

import random

import pytest

from leafmark.llm import decontamination as D

NAMES = "Boston Denver Paris Madrid Alice Robert Maria Chen Oslo Kyoto Lima Nairobi".split()
UNITS = "km miles kg litres hours minutes dollars meters".split()
PLAIN = "the train leaves before noon and every second wagon carries wood to small river towns where people wait near an old station while rain falls on green hills until night comes slowly over quiet fields with cattle".split()


def question(rng):
    """A question's words with slots, and how to fill them."""
    words = rng.sample(PLAIN, 18)
    for at, kind in zip(sorted(rng.sample(range(1, 17), 4), reverse=True), ("number", "name", "number", "number")):
        words[at:at] = ["{" + kind + str(at) + "}"] + ([rng.choice(UNITS)] if kind == "number" else [])
    return "Suppose " + " ".join(words) + ", how many are left"


def filled(text, rng):
    out = []
    for w in text.split():
        if w.startswith("{number"):
            w = str(rng.randint(2, 9999))
        elif w.startswith("{name"):
            w = rng.choice(NAMES)
        out.append(w)
    return " ".join(out)


def found(spark, docs, items):
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_reparameterised_questions_are_found(spark):
    rng = random.Random(4)
    shapes = [question(rng) for _ in range(250)]
    items = [(i, filled(q, rng)) for i, q in enumerate(shapes)]
    docs = [(i, f"Some text goes before it here. {filled(q, rng)}? And {' '.join(rng.sample(PLAIN, 12))} after it.") for i, q in enumerate(shapes)]
    clean = [(1000 + i, " ".join(rng.choices(PLAIN, k=120))) for i in range(200)]
    got = found(spark, docs + clean, items)
    right = sum((i, i) in got for i in range(250))
    assert right >= 0.9 * 250 and not [k for k in got if k[0] >= 1000]
    assert sum(got[i, i].reparameterised for i in range(250) if (i, i) in got) >= 0.95 * right


def test_items_of_numbers_are_found_word_for_word(spark):
    items = [(1, "What is 12 + 35 * 4 - 7 ?"), (2, "3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"), (3, "Alice Bob 12 km Carol Dave 13 km Erin Frank 15 km Grace"), (4, "Paris"), (5, "12 7"), (6, None), (7, "")]
    docs = [(i, f"Here it is: {t} and so on. Paris 12 7") for i, t in items[:3]] + [(9, "What is 13 + 35 * 4 - 7 ? 3 4 5 6 7 9 9 10 12 11 Paris")]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (3, 3)}


def test_a_clash_drops_only_windows_with_other_values(spark):
    item = "The bus goes 300 miles on the first day through the green valley, and then it goes 300 miles again on the last day back to the sea"
    other = item.replace("300 miles again", "450 miles again")
    got = found(spark, [(1, other), (2, item.replace("300", "450"))], [(1, item)])
    assert (1, 1) in got and got[2, 1].reparameterised


def test_every_verbatim_window_is_a_match_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["12", "Paris", "km", "of", "the", "a", "is", "."]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    items = [(i, t) for i, t in enumerate(texts) if len(D.template(t)[0]) >= D.LEAST]
    docs = [(100 + i, "start now. " + t + " . end now") for i, t in items] + [(500, None), (501, "")]
    got = found(spark, docs, items + items)
    assert {(100 + i, i) for i, _ in items} <= set(got)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_odd_tables(spark, empty):
    docs = spark.createDataFrame([("a", "What is 12 + 35 * 4 - 7 ?", 1), (None, "What is 12 + 35 * 4 - 7 ?", 1), ("b", None, 2), ("a", "What is 12 + 35 * 4 - 7 ?", 1)], "doc_id string, text string, item_id int")
    items = spark.createDataFrame([(1, "What is 12 + 35 * 4 - 7 ?", "x"), (1, "What is 12 + 35 * 4 - 7 ?", "x"), (None, "What is it", "x")], "item_id int, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()] == [("a", 1)]
    got = D.contaminated(docs.limit(0) if empty != "items" else docs, items.limit(0) if empty != "docs" else items)
    assert got.count() == 0


def test_bitmap_has_the_bits_of_all_hashes(spark):
    import numpy as np

    rows = spark.range(5000).selectExpr("xxhash64(id) as h")
    bits = D.bitmap_of(rows, 5000)
    low = np.array([r.h for r in rows.collect()]) & (8 * len(bits) - 1)
    assert np.array_equal(np.flatnonzero(np.unpackbits(bits, bitorder="little")), np.unique(low))
