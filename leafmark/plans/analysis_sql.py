"""DuckDB SQL of the section analysis, from the same rules and layers."""

from __future__ import annotations

from leafmark import config as C
from leafmark import lexicon as L
from leafmark.operators import analysis as A
from leafmark.plans.oracle import SECTIONS, TURNS, _lit, clean, tokens, words


def _found(where: str, pattern: str) -> str:
    return f"regexp_matches({where}, {_lit(pattern)})"


def _bounded(pattern: str) -> str:
    return rf"\b(?:{pattern})\b"


def _free(pattern: str) -> str:
    return pattern.replace("{B}", r"\b")


def _layers(name: str, layers) -> str:
    """CTEs name_0, name_1 ... upon name."""
    out, before = [], name
    for k, layer in enumerate(layers):
        out.append(f"{name}_{k} as (select *, {', '.join(f'{rule} as {column}' for column, rule in layer)} from {before})")
        before = f"{name}_{k}"
    return ", ".join(out)


def analysis(units: str, columns: dict[str, str]) -> str:
    """CTEs up to scored_2 for a relation of units, whose columns are given by SQL."""
    have = columns.keys()
    chosen = ", ".join(f"coalesce(cast({columns[n] if n in have else 'null'} as {kind.replace('string', 'varchar')}), {value}) as {n}" for n, (kind, value) in L.UNIT_COLUMNS.items())
    parts = rf"list_filter(list_transform(string_split_regex(text, '[.!?][ \n\t\r]+|\n+'), lambda p: left(lower({clean('p')}), 181)), lambda p: length(p) >= 18 and length(p) <= 180)"
    found = [f"{_found(w, _bounded(p))} as {n}" for n, w, p in L.PATTERNS] + [f"{_found('joint', _bounded(p))} as f_{n}" for n, p, _ in C.FLUFF] + [f"{_found('lower(ocr_quality)', _bounded(L.LOW_OCR))} as low_ocr"]
    found += [f"{_found(w, _free(p))} as {n}" for n, w, p in L.FREE_PATTERNS] + [f"len(regexp_extract_all({w}, {_lit(_free(p))})) as {n}" for n, w, p in L.COUNTED]
    return f"""defaulted as (select page_id, section, {clean(columns['title'])} as title, {clean(columns['body'])} as body, {chosen} from {units}),
      read as (select * replace (lower(page_label) as page_label, lower(class_trail) as class_trail), trim(concat_ws(' ', title, body)) as text, lower(title) as head from defaulted),
      lows as (select *, {words('text')} as words, {words('body')} as body_words, lower(text) as low, concat_ws(' ', head, lower(text)) as joint, left(lower(text), 180) as start_180, left(lower(text), 800) as start_800, left(lower(text), 900) as start_900, list_transform({parts}, lambda p: left(p, 90)) as keys from read),
      matched as (select *, case when len(keys) >= 4 then len(keys) - len(list_distinct(keys)) else 0 end as repeats, {', '.join(found)} from lows),
      flagged as (select * from matched), {_layers('flagged', A.FLAG_LAYERS)}, scored as (select * from flagged_{len(A.FLAG_LAYERS) - 1}), {_layers('scored', A.SCORE_LAYERS)}"""


RANKED = f"""k1 as (select *, {A.RANK_RULES['open']} as open from scored_2 where words >= {L.LEAST_WORDS}),
  k2 as (select *, row_number() over (partition by page_id order by open desc, score desc, section) as rank, count(*) over (partition by page_id) as n, sum(open::int) over (partition by page_id) as n_open from k1),
  k3 as (select *, least(9, greatest(3, ceil(n * 28e-2)), n_open) as last from k2),
  k4 as (select *, greatest({L.CUTOFF_FLOOR}, coalesce(max(case when rank = last then score end) over (partition by page_id), 0)) as cutoff, {A.RANK_RULES['able']} as able from k3),
  k5 as (select *, coalesce(rank = min(case when able then rank end) over (partition by page_id), false) as is_best from k4),
  placed as (select *, {A.RANK_RULES['important']} as is_important from k5)"""
BEST = f"""c1 as (select *, row_number() over (partition by page_id order by is_best desc, score desc, section) as nr from placed where fluff < 82 or is_best or score >= 92 or has_final_code),
  c2 as (select *, max(case when nr > 1 then score end) over (partition by page_id) as second from c1),
  top as (select *, second is not null as has_second, coalesce(score - second, 28) as margin from c2 where nr = 1 and not quiet), {_layers('top', A.CONFIDENCE_LAYERS)}"""

PAGE_TYPES = ("article", "docs", "tutorial", "recipe", "research", "pdf", "low_structure", "")
# Units of the tables: sections with numbers of blocks made from their own, and turns with the flags of conversations.
SECTION_UNITS = {
    "title": "regexp_extract(body, '^[^ ]+(?: [^ ]+){0,3}', 0)", "body": "body", "page_type": "case page_id % 8 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(PAGE_TYPES)) + " end", "page_confidence": "40 + page_id % 50",
    "paragraphs": "1 + words % 3", "list_items": "words % 7", "numbered_items": "words % 4", "code_blocks": "case when words % 5 = 0 then 1 else 0 end", "tables": "case when words % 11 = 0 then 1 else 0 end", "bold_count": "words % 6", "links": "words % 25", "link_words": "words % 90", "class_trail": "case when words % 13 = 0 then 'post share-bar' else 'post body' end",
}
TURN_UNITS = {
    "title": "''", "body": "text", "page_type": "'chat'", "page_confidence": "60", "role": "role", "is_latest": "turn = last_mine", "answers_latest": "turn > last_user", "has_revision": "has_revision", "has_final": "has_final_answer", "has_key": "has_key_explanation", "has_recommendation": "has_recommendation", "is_complete": "is_complete", "code_blocks": "case when has_code then 1 else 0 end", "paragraphs": "1",
}
DOC_ANALYSIS = f"{SECTIONS}, {analysis('kept', SECTION_UNITS)}"
CHAT_ANALYSIS = f"{TURNS}, numbered as (select *, turn as section, max(case when role = 'assistant' then turn end) over (partition by page_id) as last_mine, coalesce(max(case when role = 'user' then turn end) over (partition by page_id), -1) as last_user from turns), {analysis('numbered', TURN_UNITS)}"
FLAG_COLUMNS = ", ".join(L.FLAGS)
SCORE_COLUMNS = "page_id, section, kind, signals, useful, importance, fluff, score"
BEST_COLUMNS = "page_id, section, kind, margin, families, confidence, tier, strong"

ANALYSIS_SQL = {
    "unit_flags": f"with {DOC_ANALYSIS} select page_id, section, content_type, {FLAG_COLUMNS} from scored_2",
    "unit_scores": f"with {DOC_ANALYSIS} select {SCORE_COLUMNS} from scored_2",
    "unit_ranking": f"with {DOC_ANALYSIS}, {RANKED} select page_id, section, score, is_best, is_important from placed",
    "page_recommendation": f"with {DOC_ANALYSIS}, {RANKED}, {BEST} select {BEST_COLUMNS}, {', '.join(f'{n}::bigint as {n}' for n in ('structural', 'role_family', 'intent_kept', 'adapter_family', 'negative'))} from top_{len(A.CONFIDENCE_LAYERS) - 1} where strong or tier <> 'none'",
    "chat_unit_flags": f"with {CHAT_ANALYSIS} select page_id, section, {FLAG_COLUMNS} from scored_2",
    "chat_unit_scores": f"with {CHAT_ANALYSIS} select {SCORE_COLUMNS} from scored_2",
    "chat_recommendation": f"with {CHAT_ANALYSIS}, {RANKED}, {BEST} select {BEST_COLUMNS} from top_{len(A.CONFIDENCE_LAYERS) - 1} where strong or tier <> 'none'",
}

EXPLAINED = _layers("placed", A.EXPLAIN_LAYERS)
IMPORTANT = "i1 as (select *, row_number() over (partition by page_id order by is_best desc, score desc, section) as k from placed where (is_important or is_best) and not quiet), important as (select page_id, section, row_number() over (partition by page_id order by section) as place from i1 where k <= case when page_type = 'chat' then 12 else 9 end)"
_LAST = f"placed_{len(A.EXPLAIN_LAYERS) - 1}"
_TERMS_OF = f"sets as (select page_id, section, list_distinct(list_transform({tokens('body')}, lambda t: t.term)) as terms from kept), likeness as (select page_id, section, case when len(list_distinct(list_concat(terms, f))) > 0 then len(list_intersect(terms, f)) / len(list_distinct(list_concat(terms, f))) else 0.0 end as similarity from (select *, first_value(terms) over (partition by page_id order by section) as f from sets))"
ANALYSIS_SQL |= {
    "unit_labels": f"with {DOC_ANALYSIS}, {RANKED}, {EXPLAINED} select page_id, section, kind_label, label, reason, role_confidence, progress, next_able, askable from {_LAST}",
    "chat_unit_labels": f"with {CHAT_ANALYSIS}, {RANKED}, {EXPLAINED} select page_id, section, kind_label, label, role_confidence, progress, next_able, askable from {_LAST}",
    "important_units": f"with {DOC_ANALYSIS}, {RANKED}, {IMPORTANT} select * from important",
    "skip_targets": f"with {DOC_ANALYSIS}, {RANKED}, {IMPORTANT}, l as (select p.page_id, p.section, row_number() over (partition by p.page_id order by p.section) as nr, min(p.section) over (partition by p.page_id) as top, i.place is not null as imp from placed p left join important i using (page_id, section)) select page_id, coalesce(min(case when imp and (section - top) * 800 > 420 then section end), min(case when imp and section > 0 then section end), min(case when imp then section end), min(case when nr = 2 then section end), min(section)) as target from l group by page_id",
    "next_units": f"with {DOC_ANALYSIS}, {RANKED}, {EXPLAINED}, {_TERMS_OF}, n as (select *, row_number() over o as nr, first_value(progress_at) over o as now_at, first_value(progress) over o as now_role, row_number() over o - 1 as gap from {_LAST} window o as (partition by page_id order by section)), u as (select page_id, section, floor(({L.NEXT_USEFUL} + {L.PROGRESS_BONUS} + {L.NEXT_DISTANCE} - least(32e0, 26e0 * coalesce(similarity, 0e0))) * 1e3 + 5e-1) / 1e3 as utility from n left join likeness using (page_id, section) where nr > 1 and next_able and not quiet) select page_id, section, utility from u where utility >= 8 qualify row_number() over (partition by page_id order by utility desc, section) = 1",
    "status_records": f"with {DOC_ANALYSIS}, {RANKED}, {BEST}, p as (select page_id, max(page_type) as page_type, count(*) as units, sum(is_important::bigint)::bigint as important, sum(words)::bigint as words from placed group by page_id), b as (select page_id, section as best_section, kind, confidence, tier, strong from top_{len(A.CONFIDENCE_LAYERS) - 1} where strong or tier <> 'none') select page_id, page_type, units, important, words, greatest(1, ceil(words / {C.READING_WORDS_PER_MINUTE}))::bigint as minutes, case when strong then best_section end as best_section, coalesce(kind, '') as kind, coalesce(confidence, 0) as confidence, coalesce(tier, 'none') as tier from p left join b using (page_id)",
}
