"""Page operators over node tables: headings, blocks, sections by interval, hierarchy, and page features from URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T

HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = ("p", "li", "pre", "blockquote", "table", "figure")


def page_statistics(nodes: DataFrame) -> DataFrame:
    """page_id, paragraphs, list_items, links, headings, words (of the body), link_words, link_density."""
    n = lambda *tags: F.coalesce(F.sum(F.col("tag").isin(*tags).cast("long")), F.lit(0))
    body = F.max(F.when(F.col("tag") == "body", F.col("words").cast("long")))
    linked = F.max(F.when(F.col("tag") == "body", F.col("link_words").cast("long")))
    made = nodes.groupBy("page_id").agg(n("p").alias("paragraphs"), n("li").alias("list_items"), n("a").alias("links"), n(*HEADINGS).alias("headings"), body.alias("words"), linked.alias("link_words"))
    return made.withColumn("link_density", T.half_up(F.when(F.col("words") > 0, F.col("link_words") / F.col("words")).otherwise(0.0)))


def headings(nodes: DataFrame) -> DataFrame:
    """page_id, pos, level and title of the headings of three characters or more; a heading repeated next to itself
    is taken once."""
    page = Window.partitionBy("page_id").orderBy("pre")
    found = nodes.filter(F.col("tag").isin(*HEADINGS) & (F.length("text") >= 3)).withColumn("before", F.lag(F.lower("text")).over(page))
    kept = found.filter(F.col("before").isNull() | (F.col("before") != F.lower("text")))
    return kept.select("page_id", F.col("pre").cast("long").alias("pos"), F.substring("tag", 2, 1).cast("int").alias("level"), F.col("text").alias("title"))


def blocks(nodes: DataFrame) -> DataFrame:
    """page_id, pos, tag, words and text of the readable blocks: eight words or more (pre and table always), none inside
    the block before it."""
    page = Window.partitionBy("page_id").orderBy("pre")
    found = nodes.filter(F.col("tag").isin(*BLOCKS)).withColumn("words", F.col("words").cast("long"))
    kept = found.filter((F.col("words") >= 8) | F.col("tag").isin("pre", "table") | ((F.col("tag") == "figure") & (F.length("text") >= 45)))
    outer = kept.withColumn("reach", F.lag("post").over(page)).filter(F.col("reach").isNull() | (F.col("pre") > F.col("reach")))
    return outer.select("page_id", F.col("pre").cast("long").alias("pos"), "tag", "words", "text")


def heading_sections(heads: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, pos, title, words and blocks of each heading's section: the blocks up to the next heading of its level
    or a higher one, or where there is none up to the next heading. Running sums and the next headings of each level
    come from windows, so the work grows with a page's elements, not with their square."""
    later = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    same = F.coalesce(*(F.when(level == n, F.max(F.when(level <= n, -F.col("pos"))).over(later)) for n in range(1, len(HEADINGS) + 1)))
    after = heads.withColumn("until", -F.coalesce(same, F.max(-F.col("pos")).over(later)))
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = after.select("page_id", "pos", "title", "until", F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("head")).unionByName(found.select("page_id", "pos", F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("until"), F.col("words").cast("long").alias("w"), F.lit(1).cast("long").alias("b"), F.lit(False).alias("head")))
    page = Window.partitionBy("page_id")
    summed = all_.withColumn("words", F.sum("w").over(upto)).withColumn("blocks", F.sum("b").over(upto)).withColumn("all_words", F.sum("w").over(page)).withColumn("all_blocks", F.sum("b").over(page)).filter("head")
    ends = summed.groupBy("page_id", F.col("pos").alias("until")).agg(F.max("words").alias("end_words"), F.max("blocks").alias("end_blocks"))
    closed = summed.join(ends, ["page_id", "until"], "left")
    return closed.select("page_id", "pos", "title", (F.coalesce("end_words", "all_words") - F.col("words")).alias("words"), (F.coalesce("end_blocks", "all_blocks") - F.col("blocks")).alias("blocks"))


def hierarchy(sections: DataFrame) -> DataFrame:
    """page_id, pos, parent: the nearest earlier section of a smaller level (1 to 6)."""
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    parent = F.coalesce(*(F.when(level == n, F.max(F.when(level < n, F.col("pos"))).over(before)) for n in range(2, 7)))
    return sections.select("page_id", "pos", parent.alias("parent"))


def merged_sections(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The union of two section tables (page_id, top, title); of those with one rounded top and title the first stays."""
    both = primary.withColumn("rank", F.lit(0)).unionByName(fallback.withColumn("rank", F.lit(1)))
    key = Window.partitionBy("page_id", F.floor(F.col("top") / 80 + 0.5), F.lower("title")).orderBy("rank", "top")
    return both.withColumn("k", F.row_number().over(key)).filter("k = 1").select("page_id", "top", "title")


def url_features(url: Column) -> dict[str, Column]:
    """host, whether a PDF or a search page, and the path's terms."""
    u = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    words = F.filter(F.split(F.lower(F.regexp_replace(path, "[^A-Za-z]+", " ")), " "), lambda w: F.length(w) >= 3)
    return {"host": F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1), "is_pdf": F.lower(path).rlike(r"\.pdf$"), "is_search": u.rlike(r"[?&](q|query|search)="), "terms": F.array_join(F.slice(words, 1, 16), " ")}
