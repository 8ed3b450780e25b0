"""Lifts and salience: shuffled by page once, and held against plain versions."""

import random

from pyspark.sql import functions as F

from leafmark import config as C
from leafmark.operators import analysis, topics


def _units(spark, rows):
    """Units of (page_id, section, title, body) that no rule keeps from being lifted."""
    made = analysis.scored(spark.createDataFrame(rows, "page_id long, section long, title string, body string"))
    plain = {n: F.lit(False) for n, kind in made.dtypes if kind == "boolean"} | {"words": F.lit(50), "fluff": F.lit(0), "score": F.lit(30), "theme_boost": F.lit(0), "kind": F.lit("x"), "kind_label": F.lit("")}
    return made.withColumns(plain)


def test_texts_are_shuffled_by_page_once(spark):
    units = _units(spark, [(1, 0, "a", "b")])
    plan = topics.salience(units, spark.createDataFrame([(1, "t")], "page_id long, title string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode(") + plan.count(" explode(") == 1
    assert "term" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_repeated_rows_nulls_and_lone_sections(spark):
    """Rows that repeat a page and section share their sums; pages of one unit have no row; units without terms have 0."""
    rows = [(1, 0, "", "alpha beta gamma"), (1, 0, "", "alpha delta"), (1, 1, "", "omega sigma"), (2, 0, "", "alone here"), (3, 0, None, None), (3, 1, "", "zeta theta"), (None, 0, "", "kappa lambda"), (None, 1, "", "kappa iota")]
    found = topics.salience(_units(spark, rows), spark.createDataFrame([(1, "alpha"), (2, "alone"), (4, "no units")], "page_id long, title string"))
    got = sorted((r.page_id, r.section, r.n_terms, r.n_title) for r in found.collect())
    assert got == [(1, 0, 4, 1), (1, 0, 4, 1), (1, 1, 2, 0), (3, 0, 0, 0), (3, 1, 2, 2)]
    sums = {(r.page_id, r.section): r.raw for r in found.collect()}
    assert sums[3, 0] == 0 and sums[1, 0] > sums[1, 1] > 0


def test_haystack_reads_as_the_plain_one(spark):
    rng = random.Random(9)
    parts = ["the", "Alpha", "beta-gamma", "c++", "x", "http://a.b/c", "HTTPS://q", "see://", "é", "snake_case", "1.5", "#tag", "and", "a/b.", "İx", "\t", "\n", "-", "_"]
    rows = [("".join(rng.choice(parts) + rng.choice([" ", " ", "", ", ", "　"]) for _ in range(rng.randint(0, 8))),) for _ in range(3000)] + [(None,)]
    low = F.regexp_replace(F.lower(F.coalesce(F.col("t"), F.lit(""))), r"https?://[^ ]+", " ")
    plain = F.regexp_replace(F.regexp_replace(low, "[_-]+", " "), r"[^a-z0-9./+#]+", " ")
    split = F.filter(F.split(plain, " +"), lambda p: (p != "") & ~p.isin(C.THEME_STOP_WORDS))
    joined = F.array_join(split, " ")
    want = F.when(F.length(joined) >= F.when(F.size(split) == 1, 3).otherwise(7), F.concat(F.lit(" "), joined, F.lit(" "))).otherwise("  ")
    read = topics._with_haystack(spark.createDataFrame(rows, "t string"), F.col("t")).withColumn("want", want)
    assert read.filter("hay <> want").count() == 0 and read.filter("length(hay) > 10").count() > 1000
    terms = spark.createDataFrame([(t,) for t in ("alpha", "c++", "beta gamma", "case", "1.5", "a/b", "a/b.", "tag", "#tag", "snake case", "b")], "term string")
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace("term", r"([.+])", r"\\$1"), F.lit(r"\b"))
    plain_in = F.contains("hay", "term") & F.when(F.contains("term", F.lit(" ")), F.contains("hay", F.concat(F.lit(" "), "term", F.lit(" ")))).otherwise(F.rlike(F.col("hay"), pattern))
    met = read.crossJoin(terms).withColumn("a", topics._stands_in(F.col("term"), F.col("hay"))).withColumn("b", plain_in)
    assert met.filter("a <> b").count() == 0 and met.filter("a").count() > 1000


def test_tasks_that_cut_texts_are_not_merged(spark):
    """Few bytes, much work: tasks stay as many as the shuffle has partitions, instead of one for a small shuffle."""
    units = _units(spark, [(p, k, "", f"alpha beta w{p}x") for p in range(40) for k in range(2)])
    told = spark.createDataFrame([(1, "t")], "page_id long, title string")
    able = units.select("page_id", "section", "title", "body", "kind_label")
    assert topics._page_terms(able, told.withColumnRenamed("title", "text")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
