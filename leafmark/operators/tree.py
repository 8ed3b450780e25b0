"""Operators on node tables as trees: intervals (pre, post) say what is inside what, so that closures over ancestors are running
maxima and sums over subtrees are differences of running sums. Each page is one window or one sorted stream; work grows with
its elements.

Null classes, roles and ids are empty; pages without a body have no root; ties go to the earlier element.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmark.functions import text as T

# Elements of little value by tag, role, or part of a class or id; names of content roots; their order of choice.
LOW_TAGS = ("nav", "footer", "form", "aside", "script", "style", "noscript", "template", "svg")
LOW_ROLES = ("navigation", "banner", "contentinfo")
LOW_NAMES = "cookie|banner|advert|sponsor|newsletter|subscribe|promo|upsell"
ROOT_CLASSES = ("post-content", "entry-content", "article-content", "article-body", "story-body", "content")
LINK_COST = 560
REPLACING = 0.74  # share of its container's words with which an inner element takes its place


def upto(last: int = 0) -> WindowSpec:
    """A page's nodes up to each one (0), or to the one before (-1)."""
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, last)


def is_low() -> Column:
    """Whether a node is of little value by itself."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.col("tag").isin(*LOW_TAGS) | empty("role").isin(*LOW_ROLES) | empty("classes").rlike(LOW_NAMES) | empty("ident").rlike(LOW_NAMES)


def inside(rule: Column, reach: str = "post") -> Column:
    """Whether a row, or one that it is inside of, fulfils the rule: a running maximum of the intervals open so far."""
    return F.coalesce(F.max(F.when(rule, F.col(reach))).over(upto()) >= F.col("pre"), F.lit(False))


def visible(nodes: DataFrame) -> DataFrame:
    """The nodes that are in no subtree of little value."""
    return nodes.withColumn("hidden", inside(is_low())).filter("not hidden").drop("hidden")


def with_readable_words(nodes: DataFrame) -> DataFrame:
    """nodes with readable and readable_links: the words of their subtrees, and of links in them, that aren't in a subtree
    of little value (0 for nodes inside one)."""
    marked = nodes.withColumn("low", is_low()).withColumn("hidden", inside(F.col("low")))
    before = F.coalesce(F.max(F.when(F.col("low"), F.col("post"))).over(upto(-1)), F.lit(-1))
    outermost = F.col("low") & (before < F.col("pre"))
    sums = marked.withColumn("gone", F.sum(F.when(outermost, F.col("words")).otherwise(0)).over(upto())).withColumn("gone_links", F.sum(F.when(outermost, F.col("link_words")).otherwise(0)).over(upto()))
    ends = sums.select("page_id", F.col("pre").alias("post"), F.col("gone").alias("end_gone"), F.col("gone_links").alias("end_links"))
    joined = sums.join(ends, ["page_id", "post"])
    left = lambda of, gone, end: F.when(F.col("hidden"), 0).otherwise(F.col(of) - F.col(end) + F.col(gone)).cast("long")
    return joined.withColumn("readable", left("words", "gone", "end_gone")).withColumn("readable_links", left("link_words", "gone_links", "end_links")).select(*nodes.columns, "readable", "readable_links")


def content_root(nodes: DataFrame) -> DataFrame:
    """page_id, pos, tag, words, link_words, score and by_score of each page's content root: the first element that is an
    article or a main part by tag, role, class or id, unless the candidate of the highest score (words less what links cost)
    holds much more; by_score says that this one was taken. The body is a candidate too."""
    measured = with_readable_words(nodes)
    named = F.col("tag").isin("article", "main") | (F.col("role") == "main") | F.arrays_overlap(F.split("classes", r"\s+"), F.array(*map(F.lit, ROOT_CLASSES))) | (F.col("ident") == "content")
    found = measured.withColumn("named", F.coalesce(named, F.lit(False)) & (F.col("readable") > 0)).filter("named or tag = 'body'")
    density = F.when(F.col("readable") > 0, F.col("readable_links") / F.col("readable")).otherwise(1.0)
    scored = found.withColumn("score", T.half_up(F.col("readable") - density * LINK_COST))
    row = F.struct("pre", "tag", "readable", "readable_links", "score")
    ordered = F.struct(F.greatest("score", F.lit(0.0)).alias("s"), (F.col("tag") == "body").alias("body"), (-F.col("pre")).alias("p"), row.alias("x"))
    picked = scored.groupBy("page_id").agg(F.max(ordered)["x"].alias("best"), F.min(F.when(F.col("named"), row)).alias("first"), F.min(F.when(F.col("tag") == "body", row)).alias("body"))
    best, first = F.coalesce("best", "body"), F.coalesce("first", "body")
    much = (first["readable"] < 20) & (best["readable"] >= 60) | (best["readable"] > first["readable"] * 1.45) & (best["readable"] >= 100)
    by_score = (best["pre"] != first["pre"]) & much
    chosen = picked.filter(F.col("body").isNotNull() | F.col("first").isNotNull()).select("page_id", F.when(by_score, best).otherwise(first).alias("x"), by_score.alias("by_score"))
    return chosen.select("page_id", F.col("x.pre").cast("long").alias("pos"), "x.tag", F.col("x.readable").alias("words"), F.col("x.readable_links").alias("link_words"), "x.score", "by_score")


def visible_sections(sections: DataFrame) -> DataFrame:
    """page_id, pos, level of the sections under no collapsed one (page_id, pos, level from 1 to 6, collapsed): a section
    reaches up to the next one of its level or a higher one."""
    later = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    after = F.coalesce(*(F.when(level == n, F.min(F.when(level <= n, F.col("pos"))).over(later)) for n in range(1, 7)), F.lit((1 << 62)))
    earlier = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    closed = sections.withColumn("until", after).withColumn("closed_to", F.max(F.when(F.coalesce("collapsed", F.lit(False)), F.col("until"))).over(earlier))
    return closed.filter("closed_to is null or pos >= closed_to").select("page_id", "pos", "level")


def without_nested(nodes: DataFrame, replacing: float = REPLACING) -> DataFrame:
    """Of candidate nodes (page_id, pre, post, words, has_role) those that no other one stands for: an element inside a kept
    one goes, unless it has a role and nearly all of its words: then it takes the other's place. Elements meet the last
    kept one only, in page order: a stream over each task's sorted pages that holds one row."""
    dealt = nodes.select("page_id", "pre", "post", "words", "has_role").repartition("page_id").sortWithinPartitions("page_id", "pre")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if held is None or held.page_id != row.page_id or row.pre > held.post:
                    out += [held] if held is not None else []
                    held = row
                elif row.has_role and row.words > held.words * replacing:
                    held = row
            yield pd.DataFrame(out, columns=b.columns)
        if held is not None:
            yield pd.DataFrame([held])

    return dealt.mapInPandas(run, nodes.select("page_id", "pre", "post", "words", "has_role").schema)
