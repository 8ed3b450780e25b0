"""Section analysis on pages whose best section is known, and its special cases."""

from pyspark.sql import functions as F

from leafmark.operators import analysis

FILL = "Readers learn what happens in each part and why the parts belong together in this order for most projects. " * 3


def analysed(spark, rows, kind="page_id long, section long, page_type string, title string, body string"):
    placed = analysis.ranked(analysis.scored(spark.createDataFrame(rows, kind))).cache()
    best = {r.page_id: r for r in analysis.recommendations(placed).collect()}
    return placed, best


def test_best_sections_of_known_pages(spark):
    rows = [
        (1, 0, "docs", "Changelog", "Version history and release notes with breaking changes. " + FILL), (1, 1, "docs", "Quick start", "Getting started takes one step: run this command, install the package and copy the example request. " + FILL), (1, 2, "docs", "About the authors", "Subscribe to our newsletter and follow us. Sponsored links. " + FILL),
        (2, 0, "research", "References", "References and bibliography [1] [2] [3] doi: 10.1 https://a.b " + FILL), (2, 1, "research", "Results", "The results show a significant effect; findings and analysis support the claim. " + FILL), (2, 2, "research", "Appendix", "Supplementary materials. " + FILL),
        (3, 0, "article", "Copyright", "All rights reserved. Privacy policy. Terms of service. " + FILL),
    ]
    placed, best = analysed(spark, rows)
    assert (best[1].section, best[1].kind) == (1, "quick_start") and (best[2].section, best[2].kind) == (1, "results")
    assert best[1].confidence >= 46 and best[1].tier != "none" and 3 not in {p for p, r in best.items() if r.strong}
    kinds = {(r.page_id, r.section): r.kind for r in placed.collect()}
    assert kinds[1, 0] == "changelog" and kinds[2, 0] == "works_cited" and kinds[3, 0] == "boilerplate"
    important = {(r.page_id, r.section) for r in analysis.important_units(placed).collect()}
    assert {(1, 1), (2, 1)} <= important and not {(1, 0), (2, 0), (3, 0)} & important
    known = analysis.explained(placed)
    assert {(r.page_id, r.section) for r in known.filter("askable").collect()} >= {(1, 1), (2, 1)} and known.filter("page_id = 3 and askable").count() == 0
    assert {r.page_id: r.target for r in analysis.skip_targets(placed, analysis.important_units(placed)).collect()}[1] == 1
    assert {r.page_id: r.tier for r in analysis.status_records(placed, analysis.recommendations(placed)).collect()}[1] == best[1].tier


def test_a_corrected_answer_is_best_in_a_chat(spark):
    kind = "page_id long, section long, page_type string, title string, body string, role string, is_latest boolean, has_revision boolean, answers_latest boolean"
    rows = [(1, 0, "chat", "", "Question: how do I fix the parser error when it reads this file on my machine today", "user", False, False, False), (1, 1, "chat", "", "One possible fix is a draft. " + FILL, "assistant", False, False, False), (1, 2, "chat", "", "The corrected answer: use this version, step by step. " + FILL, "assistant", True, True, True)]
    placed, best = analysed(spark, rows, kind)
    assert (best[1].section, best[1].kind, best[1].strong) == (2, "corrected_answer", True)
    assert {r.kind for r in placed.filter("section = 0").collect()} == {"prompt_echo"}


def test_null_empty_and_repeated_units(spark):
    rows = [(1, 0, None, None, None), (1, 1, "article", "", ""), (2, 0, "article", "A", FILL), (2, 0, "article", "A", FILL), (None, 0, "article", "B", "In short, the main argument is clear. " + FILL)]
    units = spark.createDataFrame(rows, "page_id long, section long, page_type string, title string, body string")
    found = analysis.scored(units)
    assert found.count() == 5 and found.filter(F.col("score").isNull() | F.col("kind").isNull()).count() == 0
    assert analysis.recommendations(analysis.ranked(analysis.scored(units.limit(0)))).count() == 0
    placed = analysis.ranked(found)
    assert placed.filter("page_id = 1").count() == 0 and placed.filter("is_best").groupBy("page_id").count().filter("count > 1").count() == 0
