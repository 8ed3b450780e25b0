"""DuckDB SQL of theme terms, their lifts and document salience: written apart from the operators, on the scored units."""

from __future__ import annotations

from leafmark import config as C
from leafmark import lexicon as L
from leafmark.operators import analysis as A
from leafmark.plans.analysis_sql import BEST, BEST_COLUMNS, CHAT_ANALYSIS, DOC_ANALYSIS, RANKED
from leafmark.plans.oracle import _lit, _quoted, clean, tokens

FIRST_WORDS = "^[^ ]+(?: [^ ]+){0,7}"
_STOP = _quoted(C.THEME_STOP_WORDS)


def _term(t: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(lower({t}), '[_-]+', ' ', 'g'), ' '), lambda p: p <> '' and not list_contains({_STOP}, p))"
    return f"(case when len({parts}) = 1 and length({parts}[1]) < 3 then '' when len({parts}) > 1 and length(array_to_string({parts}, ' ')) < 7 then '' else array_to_string({parts}, ' ') end)"


def _ordered_distinct(column: str) -> str:
    """A list's distinct elements in order of their first place."""
    return f"list_transform(list_filter(list_zip({column}, range(1, len({column}) + 1)), lambda z: list_position({column}, z[1]) = z[2]), lambda z: z[1])"


def _tokens(name: str, source: str, keys: str, text: str) -> str:
    """CTEs up to name: keys, toks (distinct theme tokens) and singles (those of one word)."""
    return f"""{name}_a as (select {keys}, list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), {_lit(C.THEME_TOKEN)}), lambda w: {_term('w')}), lambda w: w <> '') as l from {source}),
      {name}_b as (select {keys}, {_ordered_distinct('l')} as toks from {name}_a),
      {name} as (select *, list_filter(toks, lambda w: not contains(w, ' ')) as singles from {name}_b)"""


def _pairs(size: int) -> str:
    joined = " || ' ' || ".join(f"singles[i + {k}]" for k in range(size))
    return f"list_transform(range(1, len(singles) - {size - 2}), lambda i: {joined})"


def _added(source: str, name: str, stage: int, at: str, weight: int) -> str:
    """Rows of a source's tokens, then of its first phrases of two."""
    numbered = lambda made, w, kind: f"select page_id, t[1] as term, {w} as weight, {stage} as s1, {at} as s2, {kind} as s3, t[2] as s4, '{name}' as source from (select page_id, {at}, unnest(list_zip({made}, range(1, len({made}) + 1))) as t from {source})"
    return numbered("toks", weight, 0) + " union all " + numbered(f"list_slice(two, 1, {C.MOST_PHRASES})", weight + 1, 1)


def _themes(units: str, sources: str, chat: bool) -> str:
    """CTEs up to themes for units (page_id, section, title, body, role) and sources (page_id, title, url)."""
    w = C.THEME_WEIGHTS
    asked = "(select page_id, section, 0 - section as place, case when body <> '' then body else title end as text from units_u where role = 'user' qualify row_number() over (partition by page_id order by section desc) <= 2)"
    two = lambda n: f"{n}2 as (select *, {_ordered_distinct(_pairs(2))} as two from {n})"
    tech = f"list_filter(list_transform(regexp_extract_all(text, {_lit(C.THEME_TECHNICAL.replace('{B}', chr(92) + 'b'))}), lambda w: {_term('w')}), lambda w: w <> '')"
    return f"""units_u as materialized (select page_id, section, title, body, concat_ws(' ', title, body) as text, {'role' if chat else "''"} as role from {units}),
      {_tokens('tt', sources, 'page_id', 'title')}, {two('tt')}, {_tokens('hh', "(select * from units_u where title <> '')", 'page_id, section', 'title')}, {two('hh')},
      {_tokens('bb', 'units_u', 'page_id, section', 'text')}, bb2 as (select page_id, section, {_ordered_distinct(_pairs(2))} as two, {_ordered_distinct(_pairs(3))} as three from bb),
      {_tokens('qq', asked, 'page_id, place', 'text')}, {two('qq')},
      met as (select page_id, section, t[1] as term, t[2] as i from (select page_id, section, unnest(list_zip(list_concat(two, three), range(1, len(two) + len(three) + 1))) as t from bb2)),
      often as (select page_id, term, count(*) as n, min(section * 1000000 + i) as place from met group by page_id, term having count(*) >= 2 qualify row_number() over (partition by page_id order by count(*) desc, length(term) desc, min(section * 1000000 + i)) <= {C.MOST_REPEATED}),
      tech_l as (select page_id, section, {tech} as l from units_u), tech_m as (select page_id, t[1] as term, min(section * 1000000 + t[2]) as place from (select page_id, section, unnest(list_zip(l, range(1, len(l) + 1))) as t from tech_l) group by page_id, t[1] qualify row_number() over (partition by page_id order by min(section * 1000000 + t[2])) <= {C.MOST_TECHNICAL}),
      all_terms as ({_added('tt2', 'title', 0, '0', w['title']).replace('page_id, 0, unnest', 'page_id, unnest')} union all {_added('hh2', 'heading', 2, 'section', w['heading'])}
        union all select page_id, term, least(5, 2 + n), 3, row_number() over (partition by page_id order by n desc, length(term) desc, place), 0, 0, 'repeated_phrase' from often
        union all select page_id, term, {w['technical']}, 4, place, 0, 0, 'technical' from tech_m union all {_added('qq2', 'latest_question', 5, 'place', w['latest_question'])}),
      merged as (select page_id, term, max(weight)::bigint as weight, min(struct_pack(a := s1, b := s2, c := s3, d := s4)) as place, array_to_string(list_sort(list(distinct source)), ',') as sources from all_terms group by all),
      themes as materialized (select page_id, term, weight, sources, row_number() over (partition by page_id order by weight desc, length(term) desc, place) as rank from merged qualify rank <= {C.MOST_THEMES})"""


_DOC_SOURCES = f"(select doc_id as page_id, regexp_extract({clean('text')}, '{FIRST_WORDS}', 0) as title from documents)"
_CHAT_SOURCES = f"(select conv_id as page_id, regexp_extract({clean('text')}, '{FIRST_WORDS}', 0) as title from conversations where turn = 0)"
_HAY = f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', title, body)), 'https?://[^ ]+', ' ', 'g'), '[_-]+', ' ', 'g'), '[^a-z0-9./+#]+', ' ', 'g'), ' '), lambda p: p <> '' and not list_contains({_STOP}, p)), ' ')"
_IN = r"case when contains(term, ' ') then contains(hay, ' ' || term || ' ') else regexp_matches(hay, '\b' || regexp_replace(term, '([.+])', '\\\1', 'g') || '\b') end"
_LIFT = f"""sc as materialized (select * from scored_2), hays as (select page_id, section, ' ' || {_HAY} || ' ' as hay from sc where not ({L.UNLIFTED})),
  hits as (select page_id, section, term, weight, rank from hays join themes using (page_id) where contains(hay, term) and {_IN} qualify row_number() over (partition by page_id, section order by rank) <= {C.MOST_MATCHED}),
  gains as (select page_id, section, least(8.0, sum(greatest(1, weight)) * 0.7::double) as gain, string_agg(term, ',' order by rank) as matched from hits group by all),
  intents as (select *, case when {L.UNLIFTED} then 0 else {L.INTENT_WEIGHT.replace("search_block <> '' and search_block = wanted_block", 'false')} end as iw from sc),
  boosted as (select i.*, coalesce(matched, '') as matched, iw > 0 as is_intent, case when score >= 30 or useful >= 24 or importance >= 20 or signals > 0 then least(18, floor(coalesce(gain, 0) + iw + 0.5)) else least(4, floor(coalesce(gain, 0) + iw + 0.5)) end as boost from intents i left join gains using (page_id, section)),
  lifted as materialized (select * exclude (score, useful, importance, theme_boost, intent_match), {L.KIND_LABEL} as kind_label, boost::bigint as theme_boost, is_intent as intent_match, (score + boost)::bigint as score, (useful + least(10, ceil(boost * 0.56::double)))::bigint as useful, (importance + least(8, ceil(boost * 0.44::double)))::bigint as importance from boosted)"""


def _weigh(c: str, weight: float, title: bool) -> str:
    return f"select page_id, section, t.term as term, case when t.technical then 1.25 else 1.0 end * {weight} as w, {str(title).lower()} as in_title from (select page_id, section, unnest({tokens(c)}) as t from able)"


_IDF = "greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5)))"
_SALIENCE = f"""able as materialized (select * from lifted where not ({L.UNSALIENT})),
  spread_terms as ({_weigh('title', C.TITLE_WEIGHT, True)} union all {_weigh('body', 1.0, False)} union all {_weigh('kind_label', C.LABEL_WEIGHT, False)}),
  st as materialized (select page_id, section, term, sum(w)::double as w, bool_or(in_title) as in_title from spread_terms group by all),
  lens as materialized (select page_id, section, greatest(1.0, coalesce(sum(w), 0)) as length from able left join st using (page_id, section) group by all),
  pg as materialized (select page_id, count(*) as n, avg(length) as average from lens group by all having count(*) >= 2),
  cnt as (select page_id, term, count(*) as df, sum(w) as total, any_value(n) as n, any_value(average) as average from st join pg using (page_id) group by all),
  val as materialized (select *, {_IDF} as idf, {_IDF} * sqrt(total) as weight from cnt),
  dis as materialized (select page_id, term, row_number() over (partition by page_id order by weight desc, idf desc, term) as rank from val where df < n and weight > 0.18 qualify rank <= 40),
  labels as (select page_id, kind_label as text, min(section) as s from lifted where kind_label <> '' and not regexp_matches(lower(kind_label), {_lit(L.PLAIN_LABELS)}) group by page_id, kind_label qualify row_number() over (partition by page_id order by min(section), kind_label) <= 12),
  told as (select page_id, title as text from SOURCES union all select page_id, text from labels),
  topic as materialized (select page_id, t.term as term, sum(case when t.technical then 1.25 else 1.0 end) * {C.TOPIC_WEIGHT} as topic from (select page_id, unnest({tokens('text')}) as t from told) group by all),
  led as materialized (select page_id, term, topic from topic union all select page_id, term, {C.FALLBACK_WEIGHT} from dis where rank <= {C.FALLBACK_TOPICS} and page_id not in (select page_id from topic)),
  ev as (select s.page_id, s.section, s.term, dis.rank is not null as distinctive, coalesce(topic, 0)::double as topic, s.page_id in (select page_id from led) as has_led,
    (w * 2.2::double / (w + 1.2::double * (1 - 0.72::double + 0.72::double * greatest(0.25::double, length / greatest(1.0, v.average))))) * idf * case when in_title then 1.45::double else 1.0 end * (0.62::double + least(1.8::double, coalesce(topic, 0)::double * 0.38::double) + least(0.6::double, case when dis.rank is not null then greatest(0.45::double, v.weight) else 0 end * 0.12::double)) as base
    from st s join val v using (page_id, term) join lens using (page_id, section) left join dis using (page_id, term) left join led using (page_id, term)),
  vals as (select *, case when topic > 0 then base * 1.75::double when has_led and not regexp_matches(term, '[0-9]|[-_./+#]') then base * 0.18::double else base end as value from ev),
  sums as (select page_id, section, sum(value) as total, coalesce(sum(case when topic > 0 then least(1.8::double, value * 0.38::double + topic * 0.18::double) end), 0) as overlap, count(*) filter (distinctive or topic > 0) as n_terms, count(*) filter (topic > 0) as n_title from vals where value > 0.04 group by all),
  sal as (select a.page_id, a.section, coalesce(total, 0) * case when coalesce(n_terms, 0) < 2 and coalesce(n_title, 0) < 2 then 0.35::double else 1.0 end * case when n_terms >= 4 then 1.12::double else 1.0 end as raw, coalesce(overlap, 0) as overlap, coalesce(n_terms, 0)::bigint as n_terms, coalesce(n_title, 0)::bigint as n_title, a.theme_boost, a.score >= 30 or a.useful >= 24 or a.signals > 0 or a.role = 'assistant' as evident from able a join pg using (page_id) left join sums using (page_id, section)),
  contributed as (select *, greatest(0, least(floor(least(14.0, raw * 1.9::double + least(4, n_terms) + least(3, n_title)) + 0.5), greatest(0, 18 - theme_boost), case when evident then 99 else 4 end))::bigint as contribution from sal)"""
_DOCS = f"with {DOC_ANALYSIS}, {_themes('scored_2', _DOC_SOURCES, False)}, {_LIFT}"
_SALIENT = f"{_DOCS}, {_SALIENCE.replace('SOURCES', _DOC_SOURCES)}"
_TOPICAL = f"""topical as (select l.* exclude (score, useful, importance, salience, salience_terms, title_terms), score + coalesce(contribution, 0) as score, (useful + least(8, ceil(coalesce(contribution, 0) * 0.54::double)))::bigint as useful, (importance + least(6, ceil(coalesce(contribution, 0) * 0.42::double)))::bigint as importance,
  coalesce(contribution, 0) as salience, least(8, coalesce(n_terms, 0)) as salience_terms, least(6, coalesce(n_title, 0)) as title_terms from lifted l left join (select page_id, section, contribution, n_terms, n_title from contributed) using (page_id, section))"""

TOPICS_SQL = {
    "theme_terms": f"with {DOC_ANALYSIS}, {_themes('defaulted', _DOC_SOURCES, False)} select page_id, term, weight, sources, rank from themes",
    "chat_theme_terms": f"with {CHAT_ANALYSIS}, {_themes('defaulted', _CHAT_SOURCES, True)} select page_id, term, weight, sources, rank from themes",
    "theme_boosts": f"{_DOCS} select page_id, section, theme_boost, intent_match, matched, score, useful, importance from lifted",
    "document_salience": f"{_SALIENT} select page_id, section, floor(raw * 1000 + 0.5) / 1000.0 as raw, floor(overlap * 1000 + 0.5) / 1000.0 as title_overlap, n_terms, n_title, contribution from contributed",
    "topical_recommendation": f"{_SALIENT}, {_TOPICAL}, {RANKED.replace('from scored_2', 'from topical')}, {BEST} select {BEST_COLUMNS}, document_family::bigint as document_family, intent_family::bigint as intent_family from top_{len(A.CONFIDENCE_LAYERS) - 1} where strong or tier <> 'none'",
}
