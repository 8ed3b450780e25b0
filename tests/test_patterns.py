"""Patterns searched in batches, and what of the planner must not grow with the rules above them."""

import random
import re

from pyspark.sql import functions as F

from leafmark import config as C
from leafmark.functions import patterns as P
from leafmark.functions import text as T
from leafmark.operators import analysis, topics


def test_patterns_found_equal_python_s(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 97 == 0 else " ".join(rng.choice("fix fixed prefix fix_it résumé isn’t a is 12 doi: é fix-it".split()) for _ in range(rng.randint(0, 9)))) for i in range(2500)]
    texts = spark.createDataFrame(rows, "i long, t string")
    made = P.found({"a": F.col("t"), "b": F.lit("x")}, [("hit", "a", P.bounded("fix(?:ed)?|doi:")), ("both", "ab", P.bounded("doi: x")), ("first", "start", P.bounded("is"))], [("n", "a", P.free("{B}is{B}"))], {"ab": ("a", "b")}, {"start": ("a", 5)})
    got = {r.i: tuple(r.f) for r in texts.select("i", made.alias("f")).collect()}
    bounded = lambda p, s: re.search(rf"\b(?:{p})\b", s, re.A) is not None
    for i, t in rows:
        t = t or ""
        assert got[i] == (bounded("fix(?:ed)?|doi:", t), bounded("doi: x", t + " x"), bounded("is", t[:5]), len(re.findall(r"\bis\b", t, re.A)))


def test_faster_java_patterns_read_as_the_plain_ones(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("aZ09_'-./+#  \t\n\r\x0b\f\x1c\x85\xa0   ​‍ 　﻿é\U0001f600") for _ in range(rng.randint(0, 30))),) for _ in range(3000)]
    read = spark.createDataFrame(rows, "t string")
    plain = F.trim(F.regexp_replace(F.regexp_replace("t", C.SPACES, " "), C.ZERO_WIDTH, ""))
    assert read.filter((T.clean_text(F.col("t")) != plain) | (T.count_words(F.col("t")) != F.regexp_count("t", F.lit(C.WORD)))).count() == 0


def test_time_of_phrases_grows_with_the_words(spark):
    """A section of 20,000 different words: reading it again for each phrase would take hours."""
    words = [f"w{a}{b}x" for a in "abcdefghijklmnopqrst" for b in range(1000)]
    units = spark.createDataFrame([(1, k, "", " ".join(words)) for k in range(2)], "page_id long, section long, title string, body string")
    sources = spark.createDataFrame([(1, "", "")], "page_id long, title string, url string")
    got = topics.theme_terms(units, sources).filter("sources = 'repeated_phrase'").orderBy("rank").collect()
    assert len(got) == C.MOST_REPEATED and got[0].term == "wa100x wa101x wa102x" and got[0].weight == 4


def test_plan_of_recommendations_stays_small(spark):
    """The condition on the confidence isn't written out over all rules below it."""
    units = spark.createDataFrame([(1, 0, "a", "b")], "page_id long, section long, title string, body string")
    plan = analysis.recommendations(analysis.ranked(analysis.scored(units)))._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 100_000


def test_distinctive_terms_are_dealt_by_page_only(spark):
    from leafmark.plans.registry import QUERIES

    plan = QUERIES["distinctive_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" in plan and "section#" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_patterns_searched_together_equal_each_one_alone(spark):
    rng = random.Random(6)
    tests = [(f"p{k}", "t", P.bounded(f"w{k}(?:x|y z)?")) for k in range(19)] + [("free", "t", P.free("^w1{B}"))]
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}{rng.choice(['', 'x', 'y z', '_'])}" for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    made = P.found({"t": F.col("t")}, tests)
    for i, t, f in spark.createDataFrame(rows, "i long, t string").select("i", "t", made.alias("f")).collect():
        assert tuple(f) == tuple(re.search(p, t, re.A) is not None for _, _, p in tests)


def test_repeats_of_clean_texts_equal_those_of_any(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice(["This is one sentence here", "another SENTENCE of İ words", "ΑΣ short", "third one ​ with ‌ gaps in it"]) + rng.choice([". ", "! ", "?\n", ".", " ​. ", ".​ ", " . ﻿ "]) for _ in range(rng.randint(0, 9))),) for _ in range(1500)]
    clean = T.clean_text(F.col("t"))
    read = spark.createDataFrame(rows, "t string").select("t", T.repeats(clean).alias("a"), T.repeats_of_clean(F.lower(clean)).alias("b"))
    assert read.filter("a <> b").count() == 0 and read.filter("b > 0").count() > 100


def test_titles_need_no_more_than_the_first_words(spark):
    from leafmark.plans import registry, topics_sql

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["ab", "c.", " ", "\n", "​", "　", "﻿", "\x1c", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(3000)] + [(-1, None)]
    texts = spark.createDataFrame(rows, "page_id long, text string")
    whole = texts.select("page_id", F.regexp_extract(T.clean_text(F.col("text")), topics_sql.FIRST_WORDS, 0).alias("plain"))
    assert registry._titled(texts).join(whole, "page_id").filter("title <> plain").count() == 0


def test_words_of_units_are_those_of_title_and_body(spark):
    units = spark.createDataFrame([(1, 0, "It's a", "well-known  x_1 ​ é 'q -"), (1, 1, None, None), (1, 2, "", "b")], "page_id long, section long, title string, body string")
    got = analysis.flags(units).orderBy("section").select("words", "body_words").collect()
    assert [tuple(r) for r in got] == [(5, 3), (0, 0), (1, 1)]


def test_phrases_are_counted_where_their_first_pair_is_repeated(spark):
    """Phrases whose first two words meet in one section only never reach the count by terms; no repeated one is lost."""
    texts = {1: ["alpha beta gamma", "delta epsilon zeta"], 2: ["alpha beta gamma", "zeta alpha beta gamma", "beta gamma"], 3: ["lonely section words"], 4: [None, ""]}
    units = spark.createDataFrame([(p, k, "", t) for p, parts in texts.items() for k, t in enumerate(parts)], "page_id long, section long, title string, body string")
    sources = spark.createDataFrame([(p, "", "") for p in texts], "page_id long, title string, url string")
    split = topics.with_tokens(units, F.col("body"), "words")
    runs = sorted((r.page_id, r.section, r.term, r.i) for r in topics._repeated_runs(split).collect())
    assert runs == [(2, 0, "alpha beta", 0), (2, 0, "alpha beta gamma", 2), (2, 0, "beta gamma", 1), (2, 1, "alpha beta", 1), (2, 1, "alpha beta gamma", 4), (2, 1, "beta gamma", 2), (2, 2, "beta gamma", 0)]
    got = {(r.page_id, r.term, r.weight) for r in topics.theme_terms(units, sources).collect()}
    assert got == {(2, "beta gamma", 5), (2, "alpha beta gamma", 4), (2, "alpha beta", 4)}
