"""Section analysis: flags, kinds, scores, ranking and the recommendation of each page, from the rules of the lexicon.

A table of units (page_id, section, title, body and any of lexicon.UNIT_COLUMNS) goes through projections of built-in
expressions; only ranking and recommendation shuffle, by page. Null titles and bodies are empty texts, null columns take
their default, pages without a candidate give no row, and ties go to the earlier section.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import config as C
from leafmark import lexicon as L
from leafmark.functions import patterns as P
from leafmark.functions import text as T


def layered(rules: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The rules in as few layers as their references to each other need."""
    level: dict[str, int] = {}
    for name, rule in rules:
        level[name] = 1 + max((level[w] for w in re.findall(r"[a-z_0-9]+", rule) if w in level), default=-1)
    return [[(n, r) for n, r in rules if level[n] == k] for k in range(max(level.values()) + 1)]


def total(weights: list[tuple[str, int]]) -> str:
    return " + ".join(f"case when {rule} then {w} else 0 end" for rule, w in weights)


FLAG_LAYERS = layered(L.RULES)
SCORE_LAYERS = [
    [("kind", L.KIND)],
    [("u", f"{total([(r, u) for r, u, _ in L.WEIGHTS if u])} + {L.PRIORITY}"), ("i", total([(r, i) for r, _, i in L.WEIGHTS if i])), ("structure", L.STRUCTURE), ("fluff", f"cast({total(L.PENALTIES)} as bigint)"), ("signals", f"cast({total([(s, 1) for s in L.SIGNALS_COUNTED])} as bigint)")],
    [("useful", "cast(greatest(0, u) as bigint)"), ("importance", "cast(greatest(0, i + structure) as bigint)"), ("score", "cast(floor(u * 86e-2 + i * 48e-2 + structure * 58e-2 - fluff + 5e-1) as bigint)")],
]
RANK_RULES = {
    "open": "fluff < 82 or score >= 96 or has_final_code",
    "able": f"open and score >= {L.BEST_FROM} and (useful >= {L.USEFUL_FROM} or has_final_code) and kind not in {L.LOW_KINDS}",
    "important": f"(score >= cutoff or is_best or (score >= 42 and code)) and (words >= 28 or (is_best and words >= 16) or (concise_answer and words >= 14) or (code and words >= 10)) and (useful >= 20 or {L.ALWAYS_USEFUL}) and kind not in {L.LOW_KINDS} and (fluff < 82 or is_best)",
}
CONFIDENCE_LAYERS = [
    [(n, f"least(100, greatest(0, floor({' + '.join(parts)} + 5e-1)))") for n, parts in L.FAMILIES.items()],
    [("intent_kept", "case when role_family >= 70 and intent_family >= 28 and structural < 50 and document_family < 28 and adapter_family < 28 then least(24, intent_family) else intent_family end"), ("negative", f"least(100, greatest(0, floor({' + '.join(L.NEGATIVE)} + 5e-1)))")],
    [("strong_adapter", L.STRONG_ADAPTER.replace("intent_family", "intent_kept")), ("families", total([(f"{n} >= 28", 1) for n in ("structural", "role_family", "intent_kept", "document_family", "adapter_family")])), ("average", "({}) / greatest(1e0, {})".format(" + ".join(f"case when {n} >= 18 then {n} else 0e0 end" for n in ("structural", "role_family", "intent_kept", "document_family", "adapter_family")), total([(f"{n} >= 18", 1) for n in ("structural", "role_family", "intent_kept", "document_family", "adapter_family")])))],
    [("uncapped", "floor(average * 64e-2 + least(18, families * 5) + least(1e2, greatest(0e0, (margin + 4) / 44e0 * 1e2)) * 8e-2 + page_confidence * 14e-2 - negative * 18e-2 + 5e-1)")],
    [("confidence", "cast(least(96, greatest(0, least(uncapped, {}))) as bigint)".format(", ".join(f"case when {rule.replace('intent_family', 'intent_kept')} then {cap} else 100 end" for rule, cap in L.CAPS)))],
    [("tier", "case " + " ".join(f"when confidence >= {least} then '{tier}'" for tier, least in L.TIERS) + " else 'none' end"), ("strong", f"confidence >= {L.MINIMA['confidence']} and score >= {L.MINIMA['score']} and useful >= {L.MINIMA['useful']} and page_confidence >= {L.MINIMA['page_confidence']} and (not ({L.AMBIGUOUS}) or margin >= 8 or score >= 104 or has_final_code)")],
]


def through(df: DataFrame, layers: list[list[tuple[str, str]]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(f"{rule} as {name}" for name, rule in layer))
    return df


def with_defaults(units: DataFrame) -> DataFrame:
    have = set(units.columns)
    default = lambda n, kind, value: F.expr(f"coalesce(cast({n if n in have else 'null'} as {kind}), {value})").alias(n)
    return units.select("page_id", F.col("section").cast("bigint").alias("section"), "title", "body", *(default(n, k, v) for n, (k, v) in L.UNIT_COLUMNS.items()))


def flags(units: DataFrame) -> DataFrame:
    """The units with words, the patterns found and all rules' columns (lexicon.FLAGS among them)."""
    title, body = T.clean_text(F.col("title")), T.clean_text(F.col("body"))
    read = with_defaults(units).withColumn("title", title).withColumn("body", body).withColumn("text", F.trim(F.concat_ws(" ", "title", "body")))
    read = read.withColumn("head", F.lower("title")).withColumn("low", F.lower("text"))
    read = read.withColumn("repeats", T.repeats_of_clean(F.col("low")))
    read = read.withColumn("page_label", F.lower("page_label")).withColumn("class_trail", F.lower("class_trail"))
    found = read.withColumn("found", _patterns()).select("*", "found.*", (F.col("found.title_words") + F.col("found.body_words")).alias("words"))
    return through(found.drop("found", "text", "head", "low", "title_words"), FLAG_LAYERS)


def _patterns() -> Column:
    """All patterns and words of a unit, searched once."""
    texts = {n: F.col(n) for n in ("title", "body", "head", "low", "page_label", "class_trail")} | {"ocr_quality": F.lower("ocr_quality")}
    tests = [(n, where, P.bounded(p)) for n, where, p in L.PATTERNS] + [(f"f_{n}", "joint", P.bounded(p)) for n, p, _ in C.FLUFF] + [("low_ocr", "ocr_quality", P.bounded(L.LOW_OCR))] + [(n, where, P.free(p)) for n, where, p in L.FREE_PATTERNS]
    return P.found(texts, tests, [(n, where, P.free(p)) for n, where, p in L.COUNTED] + [("title_words", "title", C.WORD_RE2), ("body_words", "body", C.WORD_RE2)], {"joint": ("head", "low")}, {f"start_{n}": ("low", n) for n in (180, 800, 900)})


def scored(units: DataFrame) -> DataFrame:
    """flags(), and kind, useful, importance, structure, fluff, signals (their number) and score."""
    return through(flags(units), SCORE_LAYERS)


def ranked(found: DataFrame) -> DataFrame:
    """The scored units of enough words, with is_best and is_important within their page."""
    page = Window.partitionBy("page_id")
    kept = found.filter(f"words >= {L.LEAST_WORDS}").withColumn("open", F.expr(RANK_RULES["open"]))
    placed = kept.withColumn("rank", F.row_number().over(page.orderBy(F.desc("open"), F.desc("score"), "section"))).withColumn("n", F.count(F.lit(1)).over(page)).withColumn("n_open", F.sum(F.col("open").cast("int")).over(page))
    last = F.least(F.lit(9), F.greatest(F.lit(3), F.ceil(F.col("n") * 0.28)), F.col("n_open"))
    cut = placed.withColumn("last", last).withColumn("cutoff", F.greatest(F.expr(L.CUTOFF_FLOOR), F.coalesce(F.max(F.when(F.col("rank") == F.col("last"), F.col("score"))).over(page), F.lit(0)))).withColumn("able", F.expr(RANK_RULES["able"]))
    best = cut.withColumn("best_rank", F.min(F.when(F.col("able"), F.col("rank"))).over(page)).withColumn("is_best", F.coalesce(F.col("rank") == F.col("best_rank"), F.lit(False)))
    return best.withColumn("is_important", F.expr(RANK_RULES["important"]))


def recommendations(placed: DataFrame) -> DataFrame:
    """page_id, section (the best, or the first candidate), kind, margin, families, negative, confidence, tier, strong
    (a strong target) of each page that isn't quiet; pages of no confidence give no row."""
    page = Window.partitionBy("page_id")
    candidates = placed.withColumn("candidate", F.expr("fluff < 82 or is_best or score >= 92 or has_final_code")).filter("candidate or is_best")
    first = candidates.withColumn("order", F.row_number().over(page.orderBy(F.desc("is_best"), F.desc("score"), "section"))).withColumn("second", F.max(F.when(F.col("order") > 1, F.col("score"))).over(page))
    top = first.filter("order = 1 and not quiet").withColumn("has_second", F.col("second").isNotNull()).withColumn("margin", F.coalesce(F.col("score") - F.col("second"), F.lit(28)))
    # the row number, which isn't deterministic, keeps the condition above the layers: pushed below them it would be written
    # out over all of their rules, many times each
    return through(top, CONFIDENCE_LAYERS).withColumn("row", F.monotonically_increasing_id()).filter("row >= 0 and (strong or tier <> 'none')").drop("row")


EXPLAIN_LAYERS = [
    [("kind_label", L.KIND_LABEL), ("reason", L.REASON), ("role_confidence", L.ROLE_CONFIDENCE), ("skipped", L.SKIPPED), ("progress", L.PROGRESS_ROLE)],
    [("label", L.SIGNAL_LABEL), ("next_able", L.NEXT_ABLE), ("strong_content", L.STRONG_CONTENT), ("progress_at", L.PROGRESS_AT)],
    [("askable", L.ASKABLE)],
]


def explained(placed: DataFrame) -> DataFrame:
    """The ranked units with kind_label, label (by signals), reason, role_confidence, progress (their role in the page's
    progression), and whether they may be a next section (next_able) and answer a query (askable)."""
    return through(placed, EXPLAIN_LAYERS)


def important_units(placed: DataFrame) -> DataFrame:
    """page_id, section, place: the best unit and the highest important ones, 9 in all (12 of a chat), in page order."""
    page = Window.partitionBy("page_id")
    chosen = placed.filter("(is_important or is_best) and not quiet").withColumn("k", F.row_number().over(page.orderBy(F.desc("is_best"), F.desc("score"), "section")))
    kept = chosen.filter("k <= case when page_type = 'chat' then 12 else 9 end")
    return kept.select("page_id", "section", F.row_number().over(page.orderBy("section")).cast("long").alias("place"))


def skip_targets(placed: DataFrame, important: DataFrame, intro: int = 420, height: int = 800) -> DataFrame:
    """page_id, target: where to go past an introduction: the first important unit further down than intro, else the
    first that isn't the page's first, else the first; without one the page's second unit. Units lie height apart."""
    page = Window.partitionBy("page_id")
    listed = placed.select("page_id", "section", "index", F.min("section").over(page).alias("top")) if "index" in placed.columns else placed.select("page_id", "section", F.row_number().over(page.orderBy("section")).alias("index"), F.min("section").over(page).alias("top"))
    joined = listed.join(important.select("page_id", "section", F.lit(True).alias("important")), ["page_id", "section"], "left")
    low = F.min(F.when(F.col("important") & ((F.col("section") - F.col("top")) * height > intro), F.col("section")))
    later = F.min(F.when(F.col("important") & (F.col("section") > 0), F.col("section")))
    second = F.coalesce(F.min(F.when(F.col("index") == 2, F.col("section"))), F.min("section"))
    return joined.groupBy("page_id").agg(F.coalesce(low, later, F.min(F.when(F.col("important"), F.col("section"))), second).alias("target"))


def next_units(known: DataFrame, similar: DataFrame) -> DataFrame:
    """page_id, section, utility: from the page's first unit on, the unit of the greatest utility (usefulness, the
    progression of roles, distance, likeness to the current one), if that is 8 or more. similar: page_id, section and
    similarity, to the first unit."""
    page = Window.partitionBy("page_id")
    order = page.orderBy("section")
    placed = known.withColumn("nr", F.row_number().over(order)).withColumn("now_at", F.first("progress_at").over(order)).withColumn("now_role", F.first("progress").over(order)).withColumn("gap", F.col("nr") - 1)
    after = placed.filter("nr > 1 and next_able and not quiet").join(similar, ["page_id", "section"], "left")
    utility = F.expr(f"floor(({L.NEXT_USEFUL} + {L.PROGRESS_BONUS} + {L.NEXT_DISTANCE} - least(32e0, 26e0 * coalesce(similarity, 0e0))) * 1e3 + 5e-1) / 1e3")
    best = after.withColumn("utility", utility).withColumn("k", F.row_number().over(page.orderBy(F.desc("utility"), "section"))).filter("k = 1 and utility >= 8")
    return best.select("page_id", "section", "utility")


def first_similarity(sections: DataFrame) -> DataFrame:
    """page_id, section, similarity: Jaccard index of the terms of each section and of its page's first one."""
    sets = sections.select("page_id", F.col("section").cast("bigint").alias("section"), T.term_set(F.col("body")).alias("terms"))
    first = F.first("terms").over(Window.partitionBy("page_id").orderBy("section"))
    union = F.size(F.array_union("terms", "first"))
    return sets.withColumn("first", first).select("page_id", "section", F.when(union > 0, F.size(F.array_intersect("terms", "first")) / union).otherwise(0.0).alias("similarity"))


def status_records(placed: DataFrame, best: DataFrame) -> DataFrame:
    """One flat record for each page: its type, units, important ones, words, minutes, best unit, tier and confidence.
    placed and best should be read from one stored table, since both are scored units."""
    pages = placed.groupBy("page_id").agg(F.max("page_type").alias("page_type"), F.count(F.lit(1)).alias("units"), F.sum(F.col("is_important").cast("long")).alias("important"), F.sum("words").alias("words"))
    found = best.select("page_id", F.col("section").alias("best_section"), "kind", "confidence", "tier", "strong")
    joined = pages.join(found, "page_id", "left")
    return joined.select("page_id", "page_type", "units", "important", "words", F.greatest(F.lit(1), F.ceil(F.col("words") / C.READING_WORDS_PER_MINUTE)).cast("long").alias("minutes"), F.when(F.col("strong"), F.col("best_section")).alias("best_section"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("tier", F.lit("none")).alias("tier"))
