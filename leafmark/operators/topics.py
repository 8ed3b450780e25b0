"""What a page is about: its theme terms, and the lift that they, the page's intent and terms that tell its sections apart
give to its units.

Theme terms come from several sources (title, address, headings, phrases that sections share, technical terms, the latest
questions of a conversation); each term takes its largest weight. Two passes lift the units: themes and intent first, then
salience, a BM25 over the page's own sections that favours the page's topic terms. Theme terms meet by (page, term); for
salience a page's texts go to one task, which groups and sorts their terms and may spill. What returns to the units are at
most MOST_THEMES terms and one number for each unit.

Null titles, texts and addresses are empty; a page without terms has no row among the themes and lifts nothing; ties go to
the term met first; rows that repeat a page and section share their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import config as C
from leafmark import lexicon as L
from leafmark.functions import text as T
from leafmark.operators import analysis
from leafmark.operators.sections import bm25, idf
from leafmark.sources.storage import stored



def by_page(rows: DataFrame) -> DataFrame:
    """rows dealt by page to as many tasks as the session has shuffle partitions: where texts are cut after a shuffle, tasks
    merged by its bytes would be few and long, since the work is many times what the bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


# ---------------------------------------------------------------- terms of a text


def theme_term(c: Column) -> Column:
    """A word or phrase in lower case without stop words; null if it is too short to be a theme."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(c), "[_-]+", " "), " "), lambda p: (p != "") & ~p.isin(C.THEME_STOP_WORDS))
    joined = F.array_join(parts, " ")
    return F.when(F.length(joined) >= F.when(F.size(parts) == 1, 3).otherwise(7), joined)


def theme_tokens(c: Column) -> Column:
    """The distinct theme terms of a text's words, in order."""
    return F.array_distinct(F.filter(F.transform(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(C.THEME_TOKEN), 0), F.lower), _theme_word), lambda t: t.isNotNull()))


def _theme_word(t: Column) -> Column:
    """theme_term() of a word of three characters or more in lower case; most have nothing to be split at."""
    return F.when(F.contains(t, F.lit("-")) | F.contains(t, F.lit("_")), theme_term(t)).when(~t.isin(C.THEME_STOP_WORDS), t)


def single_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.contains(t, F.lit(" ")))


def phrases(single: Column, size: int) -> Column:
    """Runs of so many of the single words, which are distinct and so are they: neighbours meet by shifted arrays, so the work
    grows with the words. single should be a column of a table, since it is read several times."""
    n = F.greatest(F.lit(0), F.size(single) - (size - 1))
    made = F.slice(single, F.lit(1), n)
    for k in range(1, size):
        made = F.zip_with(made, F.slice(single, F.lit(k + 1), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return made


def _pairs(single: Column) -> Column:
    """Hashes of neighbouring single words, as many as phrases(single, 2)."""
    n = F.greatest(F.lit(0), F.size(single) - 1)
    return F.zip_with(F.slice(single, F.lit(1), n), F.slice(single, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _repeated_pairs(split: DataFrame) -> DataFrame:
    """page_id and pair of the neighbouring words that two sections of a page or more have, as hashes: a clash of two only
    makes phrases be counted that needn't be."""
    met = by_page(split.select("page_id", "words_single")).select("page_id", F.explode(_pairs(F.col("words_single"))).alias("pair"))
    return met.groupBy("page_id", "pair").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("page_id", "pair")


def _repeated_runs(split: DataFrame) -> DataFrame:
    """page_id, section, term and i (its place) of each section's phrases of two and three words that may be repeated on its
    page: those that begin with a repeated pair."""
    single, again = F.col("words_single"), stored(_repeated_pairs(split), "pairs")
    rows = split.select("page_id", "section", "words_single").join(again.select("page_id").distinct(), "page_id", "left_semi").withColumn("pairs", _pairs(single))
    led = F.concat("pairs", F.slice("pairs", F.lit(1), F.greatest(F.lit(0), F.size(single) - 2)))
    runs = F.zip_with(F.concat(phrases(single, 2), phrases(single, 3)), led, lambda t, p: F.struct(t.alias("term"), p.alias("pair")))
    return rows.select("page_id", "section", F.posexplode(runs).alias("i", "e")).select("page_id", "section", "i", "e.term", "e.pair").join(again, ["page_id", "pair"], "left_semi").drop("pair")


def technical_terms(c: Column) -> Column:
    # such terms begin a word, and after small letters go on with none: this is asked first
    pattern = C.java_bounds(C.THEME_TECHNICAL.replace("{B}", r"(?<!\w)(?=[a-z]*+[A-Z0-9_.-])", 1))
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0)
    return F.array_distinct(F.filter(F.transform(found, theme_term), lambda t: t.isNotNull()))


def url_text(url: Column) -> Column:
    """An address without scheme, query and top-level domains, its separators turned to spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "(?i)^https?://", " "), "[?#].*$", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)\.[a-z]{2,}(?:/|$)", " "), "[/_-]+", " ")


def with_tokens(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with a text's theme terms (name) and those of one word (name_single) as columns, made once."""
    return rows.withColumn(name, theme_tokens(text)).withColumn(f"{name}_single", single_words(F.col(name)))


def _entries(name: str, weight: int, at: Column) -> Column:
    """Array of (term, weight, at) of a text's tokens (as with_tokens() names them) and, one heavier, of its first phrases
    of two."""
    one = lambda w, shift: lambda t, i: F.struct(t.alias("term"), F.lit(w).cast("long").alias("weight"), (at + shift + i).alias("at"))
    return F.concat(F.transform(F.col(name), one(weight, 0)), F.transform(F.slice(phrases(F.col(f"{name}_single"), 2), 1, C.MOST_PHRASES), one(weight + 1, 1 << 20)))


# ---------------------------------------------------------------- themes of a page


def _stage(k: int, section: Column | None = None) -> Column:
    """Where the terms of a source come among all: by source, then by section."""
    base = F.lit(k << 52)
    return base if section is None else base + F.shiftleft(section.cast("long"), 22)


def theme_terms(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """page_id, term, weight, sources and rank of at most MOST_THEMES terms of each page. sections: page_id, section, title,
    body and, for conversations, role; sources: page_id, title, url (a row for each page)."""
    w = C.THEME_WEIGHTS
    top = lambda *order: F.row_number().over(Window.partitionBy("page_id").orderBy(*order))

    def listed(rows: DataFrame, entries: Column, source: str) -> DataFrame:
        return rows.select("page_id", F.explode(entries).alias("e")).select("page_id", "e.term", F.col("e.weight").cast("long").alias("weight"), F.col("e.at").cast("long").alias("at"), F.lit(source).alias("source"))

    named = with_tokens(with_tokens(sources, F.col("title"), "in_title"), url_text(F.col("url")), "in_url")
    address = F.slice(F.concat("in_url", phrases(F.col("in_url_single"), 2)), 1, C.MOST_URL_TERMS)
    found = listed(named, _entries("in_title", w["title"], _stage(0)), "title")
    found = found.unionByName(listed(named, F.transform(address, lambda t, i: F.struct(t.alias("term"), F.lit(w["url"]).alias("weight"), (_stage(1) + i).alias("at"))), "url"))
    # Sections are read once; each gives the terms of its title, its technical terms and those of its phrases that may be
    # repeated; their first place is their section's number and their place in it.
    title = F.coalesce("title", F.lit(""))
    read = sections.select("page_id", "section", title.alias("title"), F.concat_ws(" ", "title", "body").alias("text"))
    split = with_tokens(with_tokens(read, F.col("title"), "heading"), F.col("text"), "words").withColumn("technical", technical_terms(F.col("text")))
    split = stored(split.select("page_id", "section", "heading", "heading_single", "words_single", "technical"), "split")
    place = F.shiftleft(F.col("section").cast("long"), 32)
    bare = lambda k: lambda t, i: F.struct(F.lit(k).alias("kind"), t.alias("term"), F.lit(0).cast("long").alias("weight"), (place + i).alias("at"))
    heads = F.transform(_entries("heading", w["heading"], _stage(2, F.col("section"))), lambda e: F.struct(F.lit("heading").alias("kind"), e["term"].alias("term"), e["weight"].alias("weight"), e["at"].alias("at")))
    met = split.select("page_id", F.explode(F.concat(heads, F.transform("technical", bare("technical")))).alias("e"))
    repeated = _repeated_runs(split).select("page_id", bare("repeated_phrase")(F.col("term"), F.col("i")).alias("e"))
    met = met.unionByName(repeated).select("page_id", "e.*")
    counted = met.groupBy("page_id", "kind", "term").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.min("at").alias("at")).filter("kind <> 'repeated_phrase' or n >= 2")
    shared = F.col("kind") == "repeated_phrase"
    order = Window.partitionBy("page_id", "kind").orderBy(F.when(shared, -F.col("n")), F.when(shared, -F.length("term")), "at")
    kept = counted.withColumn("k", F.row_number().over(order).cast("long")).filter(f"k <= case kind when 'repeated_phrase' then {C.MOST_REPEATED} when 'technical' then {C.MOST_TECHNICAL} else k end")
    weight = F.when(shared, F.least(F.lit(5), F.col("n") + 2)).when(F.col("kind") == "technical", w["technical"]).otherwise(F.col("weight"))
    at = F.when(shared, _stage(3) + F.col("k")).when(F.col("kind") == "technical", _stage(4) + F.col("k")).otherwise(F.col("at"))
    found = found.unionByName(kept.select("page_id", "term", weight.cast("long").alias("weight"), at.cast("long").alias("at"), F.col("kind").alias("source")))
    if "role" in sections.columns:
        asked = sections.filter("role = 'user'").select("page_id", "section", F.when(F.col("body") != "", F.col("body")).otherwise(title).alias("text")).withColumn("k", top(F.desc("section"))).filter("k <= 2")
        found = found.unionByName(listed(with_tokens(asked, F.col("text"), "asked"), _entries("asked", w["latest_question"], _stage(5, F.col("k"))), "latest_question"))
    best = found.groupBy("page_id", "term").agg(F.max("weight").alias("weight"), F.min("at").alias("at"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    ranked = best.withColumn("rank", top(F.desc("weight"), F.desc(F.length("term")), "at")).filter(F.col("rank") <= C.MOST_THEMES)
    return ranked.select("page_id", "term", "weight", "sources", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- lifts


def _with_haystack(rows: DataFrame, c: Column) -> DataFrame:
    """rows with a text as theme terms are written, between spaces (hay): the runs of their characters, without addresses and
    stop words."""
    lower = rows.withColumn("low", F.lower(F.coalesce(c, F.lit(""))))
    bare = F.when(F.contains("low", F.lit("://")), F.regexp_replace("low", r"https?://[^ ]+", " ")).otherwise(F.col("low"))
    parts = F.filter(F.regexp_extract_all(bare, F.lit("[a-z0-9./+#]+"), F.lit(0)), lambda p: ~p.isin(C.THEME_STOP_WORDS))
    joined = lower.withColumn("parts", parts).withColumn("joined", F.array_join("parts", " "))
    enough = F.length("joined") >= F.when(F.size("parts") == 1, 3).otherwise(7)
    return joined.withColumn("hay", F.when(enough, F.concat(F.lit(" "), "joined", F.lit(" "))).otherwise("  ")).drop("low", "parts", "joined")


def _stands_in(term: Column, hay: Column) -> Column:
    """Whether a term is in the text, between word bounds; most stand between spaces, which needs no pattern."""
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace(term, r"([.+])", r"\\$1"), F.lit(r"\b"))
    spaced = F.contains(hay, F.concat(F.lit(" "), term, F.lit(" ")))
    return F.contains(hay, term) & F.when(F.contains(term, F.lit(" ")), spaced).otherwise((spaced & term.rlike("^[a-z0-9](.*[a-z0-9])?$")) | F.rlike(hay, pattern))


def lifted_by_themes(scored: DataFrame, themes: DataFrame) -> DataFrame:
    """The scored units with theme_boost, intent_match and matched (their terms), and score, useful and importance lifted."""
    terms = themes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))).alias("themes"))
    blocks = Window.partitionBy("page_id")
    wanted = F.coalesce(*(F.max(F.when(F.col("search_block") == b, F.lit(b))).over(blocks) for b in L.WANTED_BLOCKS[:-1]), F.lit(L.WANTED_BLOCKS[-1]))
    read = _with_haystack(by_page(scored).join(terms, "page_id", "left").withColumn("wanted_block", wanted), F.concat_ws(" ", "title", "body"))
    skip = F.expr(L.UNLIFTED)
    matched = F.when(~skip & F.col("themes").isNotNull(), F.slice(F.filter("themes", lambda t: _stands_in(t["term"], F.col("hay"))), 1, C.MOST_MATCHED)).otherwise(F.array().cast("array<struct<rank:bigint,term:string,weight:bigint>>"))
    made = read.withColumn("matched_themes", matched).withColumn("intent_weight", F.when(~skip, F.expr(L.INTENT_WEIGHT)).otherwise(0))
    by_theme = F.least(F.lit(8.0), F.aggregate("matched_themes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(1).cast("long"), t["weight"])) * 0.7)
    raw = F.least(F.lit(18), F.floor(by_theme + F.least(F.lit(10), F.col("intent_weight")) + 0.5))
    evident = F.expr("score >= 30 or useful >= 24 or importance >= 20 or signals > 0 or search_block <> ''")
    boost = F.when(evident, raw).otherwise(F.least(F.lit(4), raw)).cast("long")
    up = lambda name, share, most: (F.col(name) + F.least(F.lit(most), F.ceil(F.col("theme_boost") * share))).cast("long")
    out = made.withColumn("theme_boost", boost).withColumn("intent_match", F.col("intent_weight") > 0)
    out = out.withColumn("score", (F.col("score") + F.col("theme_boost")).cast("long")).withColumn("useful", up("useful", 0.56, 10)).withColumn("importance", up("importance", 0.44, 8))
    return out.withColumn("matched", F.transform("matched_themes", lambda t: t["term"])).drop("hay", "themes", "matched_themes", "wanted_block", "intent_weight")


def _page_terms(able: DataFrame, told: DataFrame) -> DataFrame:
    """page_id, section, told, term, w, in_title and times (rows summed) of the units' terms (able: page_id, section, title,
    kind_label, body) and, with told set and without a section, of those of texts about the page (told: page_id, text). A row
    of the empty term stands for each unit. Texts are shuffled by page once and cut where they then are, so that whatever is
    grouped or ordered within a page afterwards needs no shuffle."""
    none = F.lit(None).cast("string")
    about = told.select("page_id", F.lit(None).cast("long").alias("section"), F.lit(True).alias("told"), none.alias("title"), none.alias("kind_label"), F.col("text").alias("body"))
    texts = able.select("page_id", F.col("section").cast("long").alias("section"), F.lit(False).alias("told"), "title", "kind_label", "body").unionByName(about)
    read = by_page(texts.filter(F.col("page_id").isNotNull())).withColumn("heads", T.raw_tokens(F.col("title"))).withColumn("labels", T.raw_tokens(F.col("kind_label")))
    every = F.posexplode(F.concat("heads", "labels", T.raw_tokens(F.col("body")), F.array(F.lit("")))).alias("i", "t")
    raw = read.select("page_id", "section", "told", F.size("heads").alias("n_heads"), (F.size("heads") + F.size("labels")).alias("n_named"), every)
    in_title, part = F.col("i") < F.col("n_heads"), F.when(F.col("i") < F.col("n_heads"), C.TITLE_WEIGHT).when(F.col("i") < F.col("n_named"), C.LABEL_WEIGHT).otherwise(1.0)
    made = T.terms_of(raw.select("page_id", "section", "told", "t", in_title.alias("in_title"), part.alias("part")), F.col("t") == "")
    return made.groupBy("page_id", "section", "told", "term").agg(F.sum(F.when(F.col("term") == "", 0.0).otherwise(F.col("weight") * F.col("part"))).alias("w"), F.max("in_title").alias("in_title"), F.count(F.lit(1)).alias("times"))


def salience(units: DataFrame, sources: DataFrame) -> DataFrame:
    """page_id, section, raw, title_overlap, n_terms, n_title and contribution of the units that salience can lift (units as
    lifted_by_themes() gives them, with kind_label), on pages that have two of them or more."""
    able = units.filter(~F.expr(L.UNSALIENT))
    # the page's topic: its title and the labels of its units, or else its most telling terms
    labels = units.filter(~F.lower("kind_label").rlike(L.PLAIN_LABELS) & (F.col("kind_label") != "")).groupBy("page_id", "kind_label").agg(F.min("section").alias("s"))
    first = labels.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("s", "kind_label"))).filter("k <= 12").select("page_id", F.col("kind_label").alias("text"))
    told = sources.select("page_id", F.col("title").alias("text")).unionByName(first)
    page, section, term = (Window.partitionBy(*keys) for keys in (["page_id"], ["page_id", "section"], ["page_id", "term"]))
    unit, in_unit = F.col("term") == "", ~F.col("told")
    sized = _page_terms(able, told).withColumn("length", F.greatest(F.lit(1.0), F.sum("w").over(section)))
    paged = sized.withColumn("n", F.sum(F.when(unit & in_unit, F.col("times"))).over(page)).withColumn("lengths", F.sum(F.when(unit & in_unit, F.col("times") * F.col("length"))).over(page)).withColumn("has_topic", F.max(F.col("told") & ~unit).over(page))
    counted = paged.filter("n >= 2").withColumn("df", F.sum(in_unit.cast("long")).over(term)).withColumn("total", F.sum(F.when(in_unit, F.col("w"))).over(term)).withColumn("topic", F.sum(F.when(F.col("told"), F.col("w"))).over(term) * C.TOPIC_WEIGHT)
    valued = counted.filter(in_unit).withColumn("idf", idf(F.col("n"), F.col("df"))).withColumn("weight", F.col("idf") * F.sqrt("total"))
    telling = valued.withColumn("telling", ~unit & (F.col("df") < F.col("n")) & (F.col("weight") > 0.18))
    order = page.orderBy(F.desc("telling"), F.desc("weight"), F.desc("idf"), "term")
    ranked = telling.withColumn("rank", F.dense_rank().over(order)).withColumn("distinctive", F.col("telling") & (F.col("rank") <= 40))
    fallback = F.when(~F.col("has_topic") & F.col("distinctive") & (F.col("rank") <= C.FALLBACK_TOPICS), C.FALLBACK_WEIGHT)
    each = ranked.withColumn("topic", F.coalesce("topic", fallback, F.lit(0.0))).withColumn("led", F.col("has_topic") | F.max("distinctive").over(page))
    favour = 0.62 + F.least(F.lit(1.8), F.col("topic") * 0.38) + F.least(F.lit(0.6), F.when(F.col("distinctive"), F.greatest(F.lit(0.45), F.col("weight"))).otherwise(0.0) * 0.12)
    base = bm25(F.col("w"), F.col("length"), F.col("lengths") / F.col("n")) * F.col("idf") * F.when(F.col("in_title"), 1.45).otherwise(1.0) * favour
    value = F.when(F.col("topic") > 0, base * 1.75).when(F.col("led") & ~F.col("term").rlike("[0-9]|[-_./+#]"), base * 0.18).otherwise(base)
    # the units' own rows stay for the sums: their value is 0
    on_topic, counts = F.col("topic") > 0, F.col("value") > 0.04
    kept = each.select("page_id", "section", "topic", "distinctive", "term", F.when(unit, 0.0).otherwise(value).alias("value")).filter(counts | unit)
    zero = lambda c: F.coalesce(c, F.lit(0))
    summed = kept.groupBy("page_id", "section").agg(F.sum("value").alias("sum"), zero(F.sum(F.when(counts & on_topic, F.least(F.lit(1.8), F.col("value") * 0.38 + F.col("topic") * 0.18)))).cast("double").alias("overlap"), F.sum((counts & (F.col("distinctive") | on_topic)).cast("long")).alias("n_terms"), F.sum((counts & on_topic).cast("long")).alias("n_title"))
    evident = F.expr("score >= 30 or useful >= 24 or signals > 0 or search_block <> '' or role = 'assistant'")
    joined = able.select("page_id", "section", "theme_boost", evident.alias("evident")).join(summed, ["page_id", "section"])
    raw = F.col("sum") * F.when((F.col("n_terms") < 2) & (F.col("n_title") < 2), 0.35).otherwise(1.0) * F.when(F.col("n_terms") >= 4, 1.12).otherwise(1.0)
    full = F.floor(F.least(F.lit(float(C.SALIENCE_MOST)), F.col("raw") * 1.9 + F.least(F.lit(4), F.col("n_terms")) + F.least(F.lit(3), F.col("n_title"))) + 0.5)
    within = F.greatest(F.lit(0), F.least(full, F.greatest(F.lit(0), C.LOCAL_MOST - F.col("theme_boost"))))
    made = joined.withColumn("raw", raw).withColumn("contribution", F.when(F.col("evident"), within).otherwise(F.least(F.lit(4), within)).cast("long"))
    return made.select("page_id", "section", T.half_up(F.col("raw")).alias("raw"), T.half_up(F.col("overlap")).alias("title_overlap"), "n_terms", "n_title", "contribution")


def lifted(units: DataFrame, sources: DataFrame) -> DataFrame:
    """The units scored and lifted by their pages' themes and intents, with kind_label: stored, since salience reads them
    several times and conditions on them shouldn't be pushed through all rules."""
    made = lifted_by_themes(analysis.scored(units), theme_terms(units, sources))
    return stored(made.withColumn("kind_label", F.expr(L.KIND_LABEL)), "lifted")


def topical(lifted: DataFrame, sources: DataFrame) -> DataFrame:
    """lifted() units lifted by salience too: what analysis.ranked() takes. salience, salience_terms and title_terms,
    inputs of the confidence, are filled in."""
    found = salience(lifted, sources).select("page_id", "section", "contribution", "n_terms", "n_title")
    joined = lifted.drop("salience", "salience_terms", "title_terms").join(found, ["page_id", "section"], "left").fillna(0, ["contribution", "n_terms", "n_title"])
    up = lambda name, share, most: (F.col(name) + F.least(F.lit(most), F.ceil(F.col("contribution") * share))).cast("long").alias(name)
    changed = {"score", "useful", "importance", "contribution", "n_terms", "n_title", "kind_label", "matched"}
    return joined.select(*(c for c in joined.columns if c not in changed), (F.col("score") + F.col("contribution")).cast("long").alias("score"), up("useful", 0.54, 8), up("importance", 0.42, 6), F.col("contribution").alias("salience"), F.least(F.lit(8).cast("long"), F.col("n_terms")).alias("salience_terms"), F.least(F.lit(6).cast("long"), F.col("n_title")).alias("title_terms"))
