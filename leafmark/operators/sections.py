"""Sections of documents: greedy word-budget chunks, and their terms and statistics.

A page is a document: every operator here groups by page_id, so pages never see each other's statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import config as C
from leafmark.functions import patterns as P
from leafmark.functions import text as T

MARK = "␞"


def sentence_parts(c: Column) -> Column:
    """The clean text cut after . ! ? before a capital letter or digit."""
    return F.filter(F.split(F.regexp_replace(T.clean_text(c), "([.!?]) ([A-Z0-9])", "$1" + MARK + "$2"), MARK), lambda p: p != "")


def greedy_sections(parts: Column, budget: int) -> Column:
    """Array of struct(body, words): the parts joined in order; a section closes once its words reach the budget."""
    kind = "struct<body:string,words:bigint,out:array<struct<body:string,words:bigint>>>"
    start = F.struct(F.lit(None).cast("string").alias("body"), F.lit(0).cast("bigint").alias("words"), F.array().cast("array<struct<body:string,words:bigint>>").alias("out")).cast(kind)
    one = lambda a: F.struct(a["body"].alias("body"), a["words"].alias("words"))

    def step(a: Column, p: Column) -> Column:
        closed = a["words"] >= budget
        out = F.when(closed, F.concat(a["out"], F.array(one(a)))).otherwise(a["out"])
        return F.struct(F.when(closed | a["body"].isNull(), p["text"]).otherwise(F.concat(a["body"], F.lit(" "), p["text"])).alias("body"), F.when(closed, p["words"]).otherwise(a["words"] + p["words"]).alias("words"), out.alias("out"))

    sized = F.transform(parts, lambda t: F.struct(t.alias("text"), T.count_words(t).alias("words")))
    return F.aggregate(sized, start, step, lambda a: F.when(a["body"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(one(a)))))


def text_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """page_id, section (from 0), body and words of each document's chunks; chunks of few words are left out, their
    numbers stay. A document's sections are made inside its row, without a shuffle."""
    made = docs.select(F.col(key).alias("page_id"), F.posexplode(greedy_sections(sentence_parts(F.col(text)), C.CHUNK_WORDS)).alias("section", "s"))
    return made.select("page_id", "section", "s.body", "s.words").filter(F.col("words") >= C.CHUNK_LEAST_WORDS)


def section_terms(sections: DataFrame) -> DataFrame:
    """page_id, section, term, weight: summed term weights."""
    return T.exploded_tokens(sections, "page_id", "section", text="body").groupBy("page_id", "section", "term").agg(F.sum("weight").alias("weight"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def bm25(weight: Column, length: Column, average: Column) -> Column:
    ratio = F.greatest(F.lit(C.LENGTH_FLOOR), length / F.greatest(F.lit(1.0), average))
    return weight * (C.BM25_K1 + 1) / (weight + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * ratio))


def distinctive_terms(terms: DataFrame, most: int = 40) -> DataFrame:
    """page_id, term, df, weight: the terms that tell a page's sections apart, at most 40 of each page."""
    n = terms.groupBy("page_id").agg(F.count_distinct("section").alias("n"))
    totals = terms.groupBy("page_id", "term").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("df")).join(n, "page_id")
    weighed = totals.withColumn("weight", T.half_up(idf(F.col("n"), F.col("df")) * F.sqrt("total"))).filter("df < n and weight > 0.18")
    ranked = weighed.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("weight"), "df", "term")))
    return ranked.filter(F.col("rank") <= most).select("page_id", "term", "df", "weight", F.col("rank").cast("long").alias("rank"))


MOST_QUERY_TERMS = 10_000  # of all queries together


def search(sections: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (query_id, query) and page the best section: score, margin to the next, status and snippet.

    Scores are BM25 over the page's sections, with bonuses for the phrase and for coverage. Texts are read once: a
    section's length and the terms it shares with any query are found in its row, so what is shuffled are lengths, and
    bodies only of sections with such a term. The queries' terms come to the driver: MOST_QUERY_TERMS at most, of
    QUERY_TOKENS terms and QUERY_CHARS characters each."""
    asked = queries.select("query_id", F.lower(T.clean_text(F.col("query")).substr(1, C.QUERY_CHARS)).alias("phrase"), F.slice(F.array_distinct(F.transform(T.tokens(F.col("query")), lambda t: t["term"])), 1, C.QUERY_TOKENS).alias("wanted"))
    wanted = asked.select("query_id", "phrase", F.size("wanted").alias("n_wanted"), "wanted", F.explode("wanted").alias("term"))
    known = [r["term"] for r in wanted.select("term").distinct().limit(MOST_QUERY_TERMS + 1).collect()]
    if len(known) > MOST_QUERY_TERMS:
        raise ValueError(f"more than {MOST_QUERY_TERMS} different terms are asked for at once: search in several calls")
    page = Window.partitionBy("page_id")
    read = sections.select("page_id", "section", "body", T.tokens(F.col("body")).alias("t")).filter(F.size("t") > 0)
    sized = read.select("page_id", "section", "body", F.greatest(F.lit(1.0), F.aggregate("t", F.lit(0.0), lambda a, t: a + t["weight"])).alias("length"), F.filter("t", lambda t: t["term"].isin(known) if known else F.lit(False)).alias("hits"))
    small = sized.select("page_id", "section", F.when(F.size("hits") > 0, F.col("body")).alias("body"), "length", "hits")
    placed = small.withColumn("n", F.count(F.lit(1)).over(page)).withColumn("average", F.avg("length").over(page)).filter(F.size("hits") > 0)
    hit = placed.select("*", F.explode("hits").alias("h")).groupBy("page_id", "section", "n", "average", "length", "body", F.col("h.term").alias("term")).agg(F.sum("h.weight").alias("weight"))
    counted = hit.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("page_id", "term")))
    raw = counted.join(F.broadcast(wanted), "term")  # bounded by MOST_QUERY_TERMS terms
    gain = bm25(F.col("weight"), F.col("length"), F.col("average")) * F.greatest(F.lit(C.IDF_FLOOR), idf(F.col("n"), F.col("df")))
    entry = raw.groupBy("query_id", "phrase", "n_wanted", "wanted", "page_id", "section", "body").agg(F.sum(gain).alias("raw"), F.count(F.lit(1)).alias("matches"))
    in_body = (F.length("phrase") >= 4) & F.contains(F.lower("body"), F.col("phrase"))
    coverage = F.least(F.lit(18.0), 16 * F.col("matches") / F.col("n_wanted") + F.when(F.col("matches") >= 3, 4).otherwise(0))
    score = F.col("raw") * 18 + F.when(in_body, 12).otherwise(0) + coverage
    scored = entry.withColumn("in_body", in_body).withColumn("score", T.half_up(F.when((F.col("n_wanted") == 1) & ~in_body, F.least(score, F.lit(32.0))).otherwise(score)))
    by_score = Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), F.desc("matches"), "section")
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).withColumn("next_score", F.lead("score").over(by_score)).filter("rank = 1")
    evidence = F.col("matches") >= 2
    status = F.when((F.col("score") >= C.STRONG) & evidence, "strong").when((F.col("score") >= C.POSSIBLE) & (evidence | F.col("in_body")), "possible").when(F.col("score") >= C.WEAK, "weak").otherwise("none")
    close = status.isin("strong", "possible") & (F.col("next_score") >= C.WEAK) & (F.col("score") - F.col("next_score") < C.MARGIN)
    return ranked.select("query_id", "page_id", F.col("section").cast("long").alias("section"), "score", T.half_up(F.col("score") - F.col("next_score")).alias("margin"), F.when(close, "weak").otherwise(status).alias("status"), T.snippet(F.col("body"), F.col("wanted")).alias("snippet"))


def repeated_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """page_id, repeats: how many sentences of a document repeat one before."""
    return docs.select(F.col(key).alias("page_id"), T.repeats(F.col(text)).alias("repeats"))


def signals(sections: DataFrame) -> DataFrame:
    """The sections with a boolean for each signal (columns s_...), and the fluff patterns (f_...)."""
    tests = [(f"s_{n}", "low", P.bounded(p)) for n, p, *_ in C.SIGNALS] + [(f"f_{n}", "low", P.bounded(p)) for n, p, _ in C.FLUFF]
    return sections.select("page_id", "section", "words", P.found({"low": F.lower("body")}, tests).alias("found")).select("page_id", "section", "words", "found.*")


def scores(flagged: DataFrame) -> DataFrame:
    """useful, importance, fluff and score of each section, from the weights of its signals."""
    total = lambda pairs: sum((F.when(F.col(c), w).otherwise(0) for c, w in pairs), F.lit(0))
    useful, importance = total([(f"s_{n}", u) for n, _, u, _ in C.SIGNALS if u]), total([(f"s_{n}", i) for n, _, _, i in C.SIGNALS if i])
    fluff = total([(f"f_{n}", w) for n, _, w in C.FLUFF] + [(f"s_{n}", w) for n, w in C.FLUFF_OF_SIGNALS.items()])
    made = flagged.select("page_id", "section", "words", useful.alias("u"), importance.alias("i"), fluff.alias("fluff"))
    return made.select("page_id", "section", "words", F.greatest("u", F.lit(0)).cast("long").alias("useful"), F.greatest("i", F.lit(0)).cast("long").alias("importance"), F.col("fluff").cast("long").alias("fluff"), F.floor(0.86 * F.col("u") + 0.48 * F.col("i") - F.col("fluff") + 0.5).cast("long").alias("score"))


def ranked(scored: DataFrame, best_from: int = 42, cutoff_floor: int = 34, most: int | None = None) -> DataFrame:
    """Marks each page's best section and its important ones (about the top 28 %, three to nine). most: of so many first
    sections of each page."""
    page = Window.partitionBy("page_id")
    kept = scored.filter("words >= 18")
    if most is not None:
        kept = kept.withColumn("place", F.row_number().over(page.orderBy("section"))).filter(F.col("place") <= most)
    open_ = (F.col("fluff") < 82) | (F.col("score") >= 96)
    order = page.orderBy(F.desc("open"), F.desc("score"), "section")
    placed = kept.withColumn("open", open_).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(page)).withColumn("n_open", F.sum(F.col("open").cast("int")).over(page))
    limit = F.least(F.lit(9), F.greatest(F.lit(3), F.ceil(F.col("n") * 0.28)))
    placed = placed.withColumn("cut_rank", F.least(limit, F.col("n_open"))).withColumn("cutoff", F.greatest(F.lit(cutoff_floor), F.coalesce(F.max(F.when(F.col("rank") == F.col("cut_rank"), F.col("score"))).over(page), F.lit(cutoff_floor))))
    able = F.col("open") & (F.col("score") >= best_from) & (F.col("useful") >= 26)
    placed = placed.withColumn("best_rank", F.min(F.when(able, F.col("rank"))).over(page))
    is_best = F.coalesce(F.col("rank") == F.col("best_rank"), F.lit(False))
    important = ((F.col("score") >= F.col("cutoff")) | is_best) & ((F.col("words") >= 28) | is_best) & (F.col("useful") >= 20) & ((F.col("fluff") < 82) | is_best)
    return placed.select("page_id", "section", "score", is_best.alias("is_best"), important.alias("is_important"))


def saved_minutes(sections: DataFrame) -> DataFrame:
    """Minutes of reading that starting at a section saves: the words of the sections above it."""
    above = F.coalesce(F.sum("words").over(Window.partitionBy("page_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sections.select("page_id", "section", F.floor(above / C.READING_WORDS_PER_MINUTE).cast("long").alias("saved_minutes"))


def neighbour_similarity(sections: DataFrame) -> DataFrame:
    """Jaccard index of the terms of each section and the one before it in its page."""
    sets = sections.select("page_id", "section", T.term_set(F.col("body")).alias("terms"))
    pairs = sets.withColumn("before", F.lag("terms").over(Window.partitionBy("page_id").orderBy("section"))).filter("before is not null")
    union = F.size(F.array_union("terms", "before"))
    return pairs.select("page_id", "section", T.half_up(F.when(union > 0, F.size(F.array_intersect("terms", "before")) / union).otherwise(0.0)).alias("similarity"))


def paged_type(c: Column) -> Column:
    """Section type of paged documents: the first pattern that matches."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(C.PAGED_TYPES):
        out = F.when(T.has(c, pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def current_section(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """As-of lookup: for each request (page_id, marker) the last section whose top (800 each) is at most marker + 24."""
    placed = sections.select("page_id", "section", (F.col("section") * 800).cast("double").alias("top"))
    met = requests.join(placed, "page_id").filter(F.col("top") <= F.col("marker") + 24)
    return met.groupBy("page_id", "marker").agg(F.max_by("section", "top").cast("long").alias("section"))


def step_bonus(gap: Column) -> Column:
    """What the distance to the next section is worth."""
    return F.when(gap <= 1, 12).when(gap == 2, 10).when(gap == 3, 8).when(gap <= 5, 6).when(gap <= 8, 4).otherwise(2)


def next_section(marked: DataFrame, similar: DataFrame) -> DataFrame:
    """From the first section of each page: the section of the greatest utility after it (usefulness, distance,
    likeness to the section before it), if that is 8 or more."""
    first = marked.groupBy("page_id").agg(F.min("section").alias("current"))
    after = marked.join(first, "page_id").filter("section > current").join(similar, ["page_id", "section"], "left")
    utility = F.least(F.lit(30.0), F.greatest(F.lit(0), F.col("score")) * 0.3) + F.when(F.col("is_important"), 6).otherwise(0) + step_bonus(F.col("section") - F.col("current")) - F.least(F.lit(32.0), 26 * F.coalesce(F.col("similarity"), F.lit(0.0)))
    scored = after.withColumn("utility", T.half_up(utility)).filter("utility >= 8")
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("utility"), "section"))).filter("rank = 1")
    return best.select("page_id", F.col("section").cast("long").alias("section"), "utility")


def neighbours(words: DataFrame, word: str) -> DataFrame:
    """Each word and the one before it in order among those with its first letter (before). Windows are by the first
    three characters, and a window's first word takes the last one of the window before, from a table of a row for
    each beginning."""
    begin = F.substring(word, 1, 3)
    placed = words.withColumn("before", F.lag(word).over(Window.partitionBy(begin).orderBy(word)))
    ends = words.groupBy(begin.alias("begin")).agg(F.max(word).alias("end"))
    ends = ends.select("begin", F.lag("end").over(Window.partitionBy(F.substring("begin", 1, 1)).orderBy("begin")).alias("end"))
    return placed.withColumn("begin", begin).join(ends, "begin").select(word, F.coalesce("before", "end").alias("before")).filter("before is not null")


def query_expansion(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, term, other, kind: words of the vocabulary that a query's terms also mean, as another word form, a
    synonym or a slip of spelling. Equi-joins: by stem, by synonym, and by first letter and length for slips."""
    words = terms.select("term").distinct().select(F.col("term").alias("other"), T.stem(F.col("term")).alias("stem"), F.substring("term", 1, 1).alias("letter"), F.length("term").alias("n"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(T.tokens(F.col("query")), lambda t: t["term"]))).alias("term"))
    asked = F.broadcast(asked.withColumn("stem", T.stem(F.col("term"))).withColumn("letter", F.substring("term", 1, 1)).withColumn("len", F.length("term")))
    forms = words.join(asked, "stem").filter("term != other").select("query_id", "term", "other", F.lit("word_form").alias("kind"))
    known = [w for g in C.SYNONYMS for w in g if w not in C.STOP_WORDS]
    pairs = [(a, b) for g in C.SYNONYMS for a in g for b in g if a != b and a in known and b in known]
    table = queries.sparkSession.createDataFrame(pairs, "term string, other string")
    same = words.join(F.broadcast(table), "other").join(asked.select("query_id", "term"), "term").select("query_id", "term", "other", F.lit("synonym").alias("kind"))
    slips = words.join(asked.select("query_id", "term", "letter", "len"), "letter").filter((F.abs(F.col("n") - F.col("len")) <= 1) & T.is_minor_typo(F.col("term"), F.col("other"))).select("query_id", "term", "other", F.lit("typo").alias("kind"))
    return forms.unionByName(same).unionByName(slips).distinct()
