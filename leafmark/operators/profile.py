"""Page profiles: what kind of page a page is, how sure reading it is, and whether it is better left quiet.

A page's elements give counts (paragraphs, controls, links, cards, shops, search boxes, speakers), its text gives hits of word
lists; one aggregation by page turns the node table into a row. Rules then run as cascades of conditions: the first kind
that fits names the page, evidence for reading and for quiet moves the confidence, and strong structure overrides a
wrong first guess. All rules are SQL conditions over the row's columns.

Pages without html have no row; a page without a body counts its words as 0 and is left quiet; null addresses match no
kind by address. Word lists are looked for in the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark import config as C
from leafmark.functions import text as T
from leafmark.operators import pages as P
from leafmark.operators.analysis import through

# Word lists, and names of classes, by which pages are told apart.
HITS = {
    "commerce_hits": r"add to cart|buy now|checkout|shipping|returns?|in stock|out of stock|sku|price|customers also bought|recommended products?",
    "app_hits": r"dashboard|settings|billing|workspace|analytics|reports?|saved views?|export|permissions|account",
    "result_hits": r"search results|results for|all results|filters|sort by|sponsored result|people also ask",
    "assistant_hits": r"assistant|model|response|reply|bot|generated|copilot|gemini|grok|claude|chatgpt|perplexity",
    "user_hits": r"user|human|prompt|question|you|me|ask|asked",
    "cue_hits": r"final answer|latest answer|corrected|correction|working version|copy code|copy and paste|regenerate|reply|chat|conversation|summary|final code|assistant|response|question|answer",
    "recipe_hits": r"recipe|ingredients|instructions|prep time|cook time|servings|nutrition",
    "abstract_hits": r"abstract",
    "research_hits": r"references|methodology|results|discussion|doi",
    "docs_hits": r"api reference|quickstart|installation|parameters|examples|usage",
    "tutorial_hits": r"how to|tutorial|walkthrough|guide|step by step|learn how|setup|install",
}
SPEAKERS = r"(?:^|[.!?] )(?:user|assistant|human|model|bot|you|me|question|answer|response|reply|prompt|q|a) ?[:-]"
NODE_COUNTS = {
    "paragraphs": "tag = 'p'", "controls": "tag in ('input', 'textarea', 'select', 'button') or role in ('button', 'tab')", "links": "tag = 'a'", "headings": "tag in ('h1', 'h2', 'h3')", "code_blocks": "tag in ('pre', 'code')", "articles": "tag = 'article'",
    "navs": "tag in ('nav', 'aside') or role = 'navigation' or contains(classes, 'sidebar')", "cards": "classes rlike 'card|tile|grid' or role = 'listitem'", "result_items": "role = 'listitem' or classes rlike 'result|listing'",
    "commerce_nodes": "classes rlike 'product|price|cart'", "app_nodes": "classes rlike 'dashboard|settings|app-shell|workspace' or role in ('tablist', 'toolbar')", "search_nodes": "role = 'search' or contains(classes, 'search')", "speaker_nodes": "classes rlike 'assistant|response|prompt|markdown|prose|message'", "docs_nodes": "classes rlike 'docs|api-reference|docsearch'",
}
SEARCH_HOSTS = "google|bing|duckduckgo|yahoo|ecosia|kagi|brave"
LEAST_WORDS = 160
QUIET_TYPES = "('search_results', 'shopping_product', 'app_dashboard', 'low_structure')"

# The kinds of pages, the first that fits: name, condition, confidence.
KINDS = [
    ("pdf", "is_pdf", 36), ("search_results", f"(host rlike '{SEARCH_HOSTS}' and is_search) or (search_nodes > 0 and result_hits > 0)", 82),
    ("shopping_product", "not readable and not spoken and (commerce_nodes >= 3 or commerce_hits >= 4 or (path_commerce and commerce_hits >= 3))", 24),
    ("app_dashboard", "not readable and not spoken and (app_nodes > 0 or (path_app and controls >= 8 and paragraphs < 20) or (controls >= 28 and navs >= 1 and paragraphs < 14 and words < 1400))", 22),
    ("recipe", "recipe_hits > 0", 86), ("research", "host rlike 'arxiv[.]org|doi[.]org' or (abstract_hits > 0 and research_hits > 0)", 84), ("docs", "path_docs or docs_nodes > 0 or docs_hits > 0", 86), ("discussion", "host rlike 'reddit[.]com|stackoverflow[.]com'", 66), ("tutorial", "tutorial_hits > 0 or path_tutorial", 82),
    ("article", "articles > 0 or (words >= 520 and headings >= 3) or (words >= 420 and paragraphs >= 4 and link_density < 34e-2) or (words >= 620 and headings >= 2 and paragraphs >= 4 and link_density < 42e-2)", 74),
    ("chat", "spoken and not readable", 82),
]
# What fits no kind.
MIXED = ("case when spoken and not thin then 'chat' when thin then 'low_structure' else 'article' end", "case when spoken and not thin then least(94, 58 + conversation_evidence * 8) when thin then 32 when words >= 420 and headings >= 1 then 58 else 52 end")


def points(rules: list[tuple[str, int]]) -> str:
    return " + ".join(f"case when {rule} then {n} else 0 end" for rule, n in rules)


PATHS = {"path_commerce": "product|products|shop|store|cart|checkout|sku", "path_app": "dashboard|admin|account|settings|billing|profile|reports?|analytics|console|workspace", "path_docs": "docs?|documentation|developer|reference|api|sdk", "path_tutorial": "how to|tutorial|walkthrough|guide|step by step|learn how|setup|install"}
EVIDENCE_LAYERS = [
    [("link_density", "case when words > 0 then link_words * 1e0 / words else 0e0 end")],
    [("readable", "controls <= 32 and link_density < 42e-2 and (articles > 0 or (words >= 640 and headings >= 2 and paragraphs >= 4) or (words >= 420 and paragraphs >= 4 and link_density < 34e-2) or (words >= 520 and headings >= 1 and paragraphs >= 5 and link_density < 36e-2))"),
     ("conversation_evidence", points([("speaker_nodes >= 4", 2), ("assistant_hits >= 2 and user_hits >= 2", 2), ("speakers >= 2", 2), ("code_blocks > 0", 1), ("cue_hits >= 3", 1)]))],
    [("spoken", "conversation_evidence >= 3 and (speakers >= 2 or speaker_nodes >= 4)")],
    [("thin", "not spoken and (words < 320 or (headings < 2 and not (words >= 420 and headings >= 1 and controls <= 32 and links < 42)) or controls > 34 or links > greatest(34, headings * 12))")],
    [("first_type", "case " + " ".join(f"when {rule} then '{kind}'" for kind, rule, _ in KINDS) + f" else {MIXED[0]} end")],
    [("first_confidence", "case " + " ".join(f"when first_type = '{kind}' and ({rule}) then {n}" for kind, rule, n in KINDS) + f" else {MIXED[1]} end"),
     ("article_evidence", points([("articles > 0", 2), ("words >= 520", 1), ("words >= 1200", 1), ("headings >= 3", 1), ("strong_sections >= 1", 1), ("paragraphs >= 7", 1), ("link_density < 24e-2", 1), ("controls <= 18", 1)])),
     ("quiet_signals", points([("link_density > 34e-2", 2), ("link_density > 52e-2", 2), ("controls > 28", 2), ("controls > 48", 2), ("cards > 28 and paragraphs < 10", 2), ("result_items > 18 and link_density > 22e-2", 2), ("commerce_nodes >= 3", 2), ("commerce_hits >= 2", 2), ("app_nodes >= 2", 2), ("app_hits >= 5 and controls > 14", 2), ("search_nodes >= 2 and (result_hits >= 1 or result_items > 10)", 2), ("links > greatest(42, headings * 14) and paragraphs < 12", 1)]))],
    [("quiet_evidence", "case when conversation_evidence >= 3 then greatest(0, quiet_signals - 4) else quiet_signals end")],
]
PROFILE_LAYERS = [
    [("is_chat", "first_type = 'chat'"), ("is_paged", "first_type = 'pdf'"), ("chat_like", "conversation_evidence >= 4 or (speaker_nodes >= 4 and assistant_hits >= 1 and user_hits >= 1) or (conversation_evidence >= 3 and (code_blocks > 0 or speakers >= 2))"),
     ("clean_longform", "first_type <> 'chat' and words >= 900 and paragraphs >= 5 and link_density < 22e-2 and controls <= 18 and quiet_evidence <= 2"), ("very_long", "first_type <> 'chat' and words >= 1400 and paragraphs >= 4 and link_density < 24e-2 and controls <= 18 and quiet_evidence <= 3"), ("fallback_only", "headings < 2 and blocks < 3 and first_type not in ('chat', 'pdf')")],
    [("chat_usable", "(is_chat or chat_like) and sections >= 1 and words >= 80 and strong_sections >= 1"), ("paged_readable", "is_paged and sections >= 1 and words >= 24"), ("search_usable", "first_type = 'search_results' and result_items >= 1"), ("article_like", "not is_chat and ((article_evidence >= 4 and quiet_evidence <= 5) or clean_longform or very_long or (words >= 700 and paragraphs >= 4 and article_evidence >= 3 and quiet_evidence <= 5))")],
    [("summed", "first_confidence + " + points([
        ("(is_chat or chat_like) and sections >= 3", 10), ("chat_usable", 10), ("paged_readable", 24), ("search_usable", 34), ("clean_longform or very_long", 12), ("words >= 520", 10), ("words >= 1200", 8), ("sections >= 4", 10), ("sections >= 8", 5), ("strong_sections >= 1", 8), ("strong_sections >= 3", 7), ("chat_like", 12),
        ("link_density > 34e-2", -18), ("link_density > 52e-2", -22), ("controls > 28 and words < 1000", -22), ("fallback_only", -16), ("cards > 34 and blocks < 8", -14), ("quiet_evidence >= 6 and article_evidence <= 3", -18), ("quiet_evidence >= 9", -14), ("article_evidence >= 6 and quiet_evidence <= 4", 10), ("article_like", 16),
        (f"words < {LEAST_WORDS} and not is_chat and not is_paged", -24), ("sections < 2 and not chat_usable and not paged_readable", -22)]))],
    [("reading", "greatest(0, least(96, summed))"), ("longform", "not is_chat and words >= 780 and paragraphs >= 5 and link_density < 3e-1 and controls <= 24 and quiet_evidence <= 5 and sections >= 1 and (article_evidence >= 5 or clean_longform or very_long or strong_sections >= 1)")],
    [("article_shield", "not is_chat and (article_evidence >= 6 or longform) and words >= 360 and (sections >= 2 or paragraphs >= 5)"), ("to_chat", "not is_chat and chat_like and words >= 24 and sections >= 1 and quiet_evidence <= 6"),
     ("to_article", f"not is_chat and first_type in {QUIET_TYPES} and (article_evidence >= 4 or longform or very_long) and quiet_evidence <= case first_type when 'low_structure' then 7 when 'shopping_product' then 5 else 4 end and (strong_sections >= 1 or longform or article_like) and reading >= case first_type when 'low_structure' then 50 when 'shopping_product' then 46 else 52 end")],
    [("second_type", "case when paged_readable then 'pdf' when to_chat then 'chat' when to_article then 'article' else first_type end"), ("confidence", "case when paged_readable then greatest(reading, 66) when to_chat then greatest(reading, 66) when to_article then greatest(reading, 64) when search_usable then greatest(reading, 68) else reading end"), ("quiet_by_evidence", "not (is_chat or to_chat) and quiet_evidence >= 8 and article_evidence <= 4 and not article_shield")],
    [("sheltered", "second_type = 'chat' or chat_like or chat_usable"), ("structured", "article_shield or to_article or to_chat or chat_usable or paged_readable or article_like or search_usable"), ("unclear", "not article_shield and not chat_usable and not paged_readable and conversation_evidence < 3")],
    [("quiet", f"not structured and (second_type in {QUIET_TYPES} or (not sheltered and words < {LEAST_WORDS} and not article_shield) or (sections < 2 and unclear) or (confidence < 44 and unclear) or quiet_by_evidence)")],
    [("page_type", f"case when quiet and not is_chat and not is_paged and second_type not in {QUIET_TYPES} and confidence < 38 then 'low_structure' else second_type end"), ("quiet_reason", f"case when not quiet then '' when quiet_by_evidence then 'evidence' when second_type in {QUIET_TYPES} then 'kind' when is_paged and words < 20 then 'no text' when is_chat and not chat_usable then 'no answer' when words < {LEAST_WORDS} then 'short' when sections < 2 then 'few sections' else 'unclear' end")],
]
EVIDENCE_COLUMNS = ["words", "paragraphs", "controls", "links", "headings", "code_blocks", "cards", "result_items", "commerce_nodes", "app_nodes", "search_nodes", "speaker_nodes"]


def page_units(nodes: DataFrame) -> DataFrame:
    """The sections of pages as units of the analysis: page_id, section, title, body, class_trail and numbers of blocks. An
    element belongs to the last heading before it; texts are those of the outermost blocks, in page order."""
    page = Window.partitionBy("page_id").orderBy("pre")
    heads = F.col("tag").isin(*P.HEADINGS) & (F.length("text") >= 3)
    reach = F.max(F.when(F.col("tag").isin(*P.BLOCKS), F.col("post"))).over(page.rowsBetween(Window.unboundedPreceding, -1))
    placed = nodes.withColumn("section", F.sum(heads.cast("long")).over(page)).withColumn("outer", F.col("tag").isin(*P.BLOCKS) & (reach.isNull() | (F.col("pre") > reach))).filter("section > 0")
    n = lambda rule: F.sum(F.expr(f"cast({rule} as bigint)"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("outer") & (F.col("text") != ""), F.struct("pre", "text")))), lambda x: x["text"]), " ")
    counts = {"paragraphs": "tag = 'p'", "list_items": "tag = 'li'", "code_blocks": "tag = 'pre'", "tables": "tag = 'table'", "bold_count": "tag in ('b', 'strong')", "links": "tag = 'a'"}
    made = placed.groupBy("page_id", "section").agg(
        F.max(F.when(heads, F.col("text"))).alias("title"), text.alias("body"), F.coalesce(F.max(F.when(heads, F.col("classes"))), F.lit("")).alias("class_trail"),
        *(n(rule).alias(name) for name, rule in counts.items()), F.coalesce(F.sum(F.when(F.col("outer"), F.col("link_words"))), F.lit(0)).cast("long").alias("link_words"),
    )
    return made.withColumn("section", F.col("section") - 1)


def evidence(nodes: DataFrame, pages: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """A row for each page with nodes: the counts, hits and features of its address that the rules need. units: scored
    sections, which say how many are strong; without them, none is."""
    counts = nodes.groupBy("page_id").agg(
        F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("words").cast("long"))), F.lit(0)).alias("words"), F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("link_words").cast("long"))), F.lit(0)).alias("link_words"),
        F.lower(F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("text"))), F.lit(""))).alias("low"), *(F.sum(F.expr(f"cast({rule} as bigint)")).alias(n) for n, rule in NODE_COUNTS.items()),
    )
    hit = lambda p: F.regexp_count("low", F.lit(C.bounded(p))).cast("long")
    read = counts.select("*", *(hit(p).alias(n) for n, p in HITS.items()), F.regexp_count("low", F.lit(SPEAKERS)).cast("long").alias("speakers")).drop("low")
    of_url = P.url_features(F.col("url"))
    address = pages.select("page_id", of_url["host"].alias("host"), of_url["is_pdf"].alias("is_pdf"), of_url["is_search"].alias("is_search"), *(T.has(F.regexp_replace(F.col("url"), "^[a-z]+://|[?#].*$", ""), p).alias(n) for n, p in PATHS.items()))
    blocks = P.blocks(nodes).groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"))
    strong = units.groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.expr("cast(score >= 58 and fluff < 58 and useful >= 24 as bigint)")).alias("strong_sections")) if units is not None else P.headings(nodes).groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.lit(0).cast("long").alias("strong_sections"))
    joined = read.join(address, "page_id", "left").join(blocks, "page_id", "left").join(strong, "page_id", "left")
    return joined.fillna(0, ["blocks", "sections", "strong_sections"]).fillna("", ["host"]).fillna(False, ["is_pdf", "is_search", *PATHS])


def page_profiles(found: DataFrame) -> DataFrame:
    """The rows of evidence() with the rules' columns: page_type, confidence, quiet, quiet_reason and the evidence."""
    return through(through(found, EVIDENCE_LAYERS), PROFILE_LAYERS)
