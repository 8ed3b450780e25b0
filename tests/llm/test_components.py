"""Components of links, by one task's contraction and by star rounds."""

import random

import pytest

from leafmark.llm import jaccard_join


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def mixed_links():
    """A long chain in random order, a star, a clique, random links, and repeated ones."""
    draw = random.Random(5)
    chain = list(range(1000, 1600))
    draw.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(5000, 5000 + i) for i in range(1, 200)]
    links += [(a, b) for a in range(20) for b in range(a)] + [(draw.randrange(6000, 6300), draw.randrange(6300, 6600)) for _ in range(250)]
    links += [(b, a) for a, b in links[:100]] + links[:50]
    draw.shuffle(links)
    return links


def tables_of(spark, links, monkeypatch):
    """What components() finds, and how many tables it stores on the way."""
    rows = jaccard_join.stored(spark.createDataFrame(links, "a long, b long").repartition(7), "links")
    made, kept = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: made.append(name) or kept(df, name))
    found = jaccard_join.components(rows).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert len(got) == len(found)
    return got, len(made)


def test_few_links_are_one_contraction(spark, monkeypatch):
    links = mixed_links()
    got, tables = tables_of(spark, links, monkeypatch)
    assert got == plain(links)
    assert tables == 1  # each star round stores one more, and takes some six shuffles


@pytest.mark.parametrize("most", [40, 250])
def test_many_links_take_star_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "LINKS_PER_TASK", most)
    links = mixed_links()
    got, tables = tables_of(spark, links, monkeypatch)
    assert got == plain(links)
    assert tables > 1
