"""DuckDB SQL of the library's queries."""

from __future__ import annotations

from leafmark import config as C


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEARCHES = [("q1", "apache license version"), ("q2", "general public license"), ("q3", "worthless pathetic loser"), ("q4", "copyright"), ("q5", "thanedble attion")]


def clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), {_lit(C.SPACES)}, ' ', 'g'), {_lit(C.ZERO_WIDTH)}, '', 'g'))"


def words(c: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), {_lit(C.WORD)}))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({c}, '')), {_lit(chr(92) + 'b(?:' + pattern + ')' + chr(92) + 'b')})"


def half_up(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000.0)"


def tokens(c: str) -> str:
    made = f"list_transform(regexp_extract_all(coalesce({c}, ''), {_lit(C.TOKEN_RE2)}), lambda t: {{'term': lower(regexp_replace(t, {_lit(C.EDGES)}, '', 'g')), 'technical': regexp_matches(t, {_lit(C.TECHNICAL)})}})"
    return f"list_filter({made}, lambda t: t.term <> '' and not list_contains({_quoted(C.STOP_WORDS)}, t.term) and (t.technical or length(t.term) >= 3) and not regexp_full_match(t.term, '[0-9]+'))"


def stem(v: str) -> str:
    def undouble(x: str) -> str:
        return f"case when length({x}) >= 4 and right({x}, 1) = substr({x}, length({x}) - 1, 1) and not regexp_matches(right({x}, 1), '[aeiou]') then left({x}, length({x}) - 1) else {x} end"

    irregular = " ".join(f"when {v} = '{a}' then '{b}'" for a, b in C.IRREGULAR_STEMS.items())
    return f"""case when length({v}) < 4 or regexp_matches({v}, '[0-9_./+#-]') then {v} {irregular}
      when length({v}) > 5 and ends_with({v}, 'ies') then left({v}, length({v}) - 3) || 'y' when length({v}) > 6 and ends_with({v}, 'ing') then {undouble(f"left({v}, length({v}) - 3)")}
      when length({v}) > 5 and ends_with({v}, 'ed') then {undouble(f"left({v}, length({v}) - 2)")} when length({v}) > 5 and ends_with({v}, 'es') then left({v}, length({v}) - 2) when length({v}) > 4 and ends_with({v}, 's') then left({v}, length({v}) - 1) else {v} end"""


SYNONYMOUS = " or ".join(f"term in ({', '.join(_lit(w) for w in g)}) and before in ({', '.join(_lit(w) for w in g)})" for g in C.SYNONYMS)
VOCABULARY = f"vocabulary as (select distinct unnest(list_transform({tokens('text')}, lambda t: t.term)) as term from documents)"
PAIRS = VOCABULARY + ", pairs as (select * from (select term, lag(term) over (partition by left(term, 1) order by term) as before from vocabulary) where before is not null)"
SECTIONS = f"""parts as (select doc_id as page_id, list_filter(string_split(regexp_replace({clean('text')}, '([.!?]) ([A-Z0-9])', '\\1␞\\2', 'g'), '␞'), lambda p: p <> '') as parts from documents),
sized as (select page_id, parts, list_transform(parts, lambda p: {{'g': 0, 's': {words('p')}, 'o': [0]}}) as sizes from parts where len(parts) > 0),
folded as (select page_id, parts, list_reduce(sizes, lambda a, x: {{'g': case when a.s >= {C.CHUNK_WORDS} then a.g + 1 else a.g end, 's': case when a.s >= {C.CHUNK_WORDS} then x.s else a.s + x.s end, 'o': list_append(a.o, case when a.s >= {C.CHUNK_WORDS} then a.g + 1 else a.g end)}}).o as groups from sized),
laid as (select page_id, unnest(parts) as part, unnest(groups) as section, unnest(range(len(parts))) as nr from folded),
sections as (select page_id, section::bigint as section, string_agg(part, ' ' order by nr) as body from laid group by all),
kept as (select *, {words('body')} as words from sections where {words('body')} >= {C.CHUNK_LEAST_WORDS})"""
TERMS = SECTIONS + f""", exploded as (select page_id, section, unnest({tokens('body')}) as t from kept),
terms as (select page_id, section, t.term as term, sum(case when t.technical then 1.25 else 1.0 end)::double as weight from exploded group by all)"""
IDF = "greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5)))"
FLAGS = SECTIONS + ", flagged as (select page_id, section, words, " + ", ".join(f"{has('body', p)} as s_{n}" for n, p, _, _ in C.SIGNALS) + ", " + ", ".join(f"{has('body', p)} as f_{n}" for n, p, _ in C.FLUFF) + " from kept)"


def _sum(pairs) -> str:
    return " + ".join(f"case when {c} then {w} else 0 end" for c, w in pairs)


USEFUL = _sum((f"s_{n}", u) for n, _, u, _ in C.SIGNALS if u)
IMPORTANCE = _sum((f"s_{n}", i) for n, _, _, i in C.SIGNALS if i)
FLUFF = _sum([(f"f_{n}", w) for n, _, w in C.FLUFF] + [(f"s_{n}", w) for n, w in C.FLUFF_OF_SIGNALS.items()])
SCORES = FLAGS + f""", made as (select page_id, section, words, {USEFUL} as u, {IMPORTANCE} as i, {FLUFF} as fl from flagged),
scores as (select page_id, section, words, greatest(u, 0)::bigint as useful, greatest(i, 0)::bigint as importance, fl::bigint as fluff, floor(0.86::double * u + 0.48::double * i - fl + 0.5)::bigint as score from made)"""
RANKED = SCORES + """, o as (select *, (fluff < 82 or score >= 96) as open from scores where words >= 18),
r as (select *, row_number() over (partition by page_id order by open desc, score desc, section) as rk, count(*) over (partition by page_id) as n, sum(open::int) over (partition by page_id) as n_open from o),
c as (select *, least(least(9, greatest(3, ceil(n * 0.28::double))), n_open) as cut_rank from r),
k as (select *, greatest(34, coalesce(max(case when rk = cut_rank then score end) over (partition by page_id), 34)) as cutoff, min(case when open and score >= 42 and useful >= 26 then rk end) over (partition by page_id) as best_rank from c),
b as (select *, coalesce(rk = best_rank, false) as is_best from k),
ranked as (select page_id, section, score, is_best, ((score >= cutoff or is_best) and (words >= 28 or is_best) and useful >= 20 and (fluff < 82 or is_best)) as is_important from b)"""
SETS = f"sets as (select page_id, section, list_distinct(list_transform({tokens('body')}, lambda t: t.term)) as terms from kept)"
SIMILAR = SETS + f""", near as (select page_id, section, terms, lag(terms) over (partition by page_id order by section) as before from sets),
similar_ as (select page_id, section, {half_up("case when len(list_distinct(list_concat(terms, before))) > 0 then len(list_intersect(terms, before)) / len(list_distinct(list_concat(terms, before))) else 0.0 end")} as similarity from near where before is not null)"""
TURNS = f"""base as (select conv_id as page_id, turn, role, text, {words('text')} as words, coalesce(contains(text, '{C.CODE_BLOCK}'), false) as has_code, {', '.join(f'{has("text", p)} as {n}' for n, p in C.TURN_FLAGS)} from conversations),
short as (select *, coalesce(role = 'assistant' and words <= 18 and regexp_matches(lower(coalesce(text, '')), {_lit(C.SHORT_CONFIRMATION)}), false) as is_short from base),
turns as (select *, coalesce(role = 'assistant' and not has_failed_answer and not is_short and words >= 24 and (has_final_answer or has_revision or has_summary or has_recommendation or has_key_explanation or has_code or words >= 45), false) as is_complete from short)"""
WEIGHTS = _sum([
    ("latest", 28), ("answers", 30), ("answers and corrected", 26), ("not answers and last_user > turn and not latest", -18), ("has_revision or (answers and corrected)", 34), ("has_final_answer", 32), ("latest and is_complete", 24), ("is_complete and failed > -1 and turn > failed", 24), ("has_summary", 18),
    ("has_recommendation and (has_final_answer or latest)", 22), ("has_key_explanation", 12), ("has_code", 14), ("has_hedged_draft", -24), ("has_failed_answer", -56), ("is_short", -44), ("superseded", -42),
])
_TYPE = "case " + " ".join(f"when {has('body', p)} then '{n}'" for n, p in C.PAGED_TYPES) + " else '' end"
_ASKED = f"""asked as (select query_id, lower({clean('query')}) as phrase, list_distinct(list_transform({tokens('query')}, lambda t: t.term)) as w, list_transform({tokens('query')}, lambda t: t.term) as wanted from (values {', '.join(f"('{a}', '{b}')" for a, b in SEARCHES)}) as v(query_id, query)),
wanted as (select query_id, phrase, len(w) as n_wanted, wanted, unnest(w) as term from asked)"""
_CLEANED = clean("body")

ORACLE_SQL = {
    "word_count": f"select doc_id, {words('text')} as words, greatest(1, ceil({words('text')} / {C.READING_WORDS_PER_MINUTE}))::bigint as minutes from documents",
    "clean_text": f"select doc_id, length({clean('text')}) as n, md5({clean('text')}) as digest from documents",
    "hash_text": f"""with h as (select doc_id, list_reduce(list_transform(list_prepend('', string_split({clean('text')}, '')), lambda x: case when x = '' then 0 else unicode(x) end::hugeint), lambda a, x: (case when x < 65536 then a * 31 + x else (a * 31 + 55232 + (x >> 10)) * 31 + 56320 + x % 1024 end) % 4294967296) as v from documents),
      a as (select doc_id, abs(case when v >= 2147483648 then v - 4294967296 else v end)::bigint as v from h)
      select doc_id, case when v = 0 then '0' else ltrim(list_aggregate(list_transform(range(7), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** (6 - i))::bigint) % 36)::int + 1, 1)), 'string_agg', ''), '0') end as hash from a""",
    "tokenize": f"with t as (select doc_id, {tokens('text')} as t from documents) select doc_id, len(t) as tokens, md5(array_to_string(list_transform(t, lambda x: x.term), ' ')) as digest, coalesce(list_sum(list_transform(t, lambda x: case when x.technical then 1.25 else 1.0 end::double)), 0.0) as weight from t",
    "stem": f"with {VOCABULARY} select term, {stem('term')} as stem from vocabulary",
    "trigram_similarity": f"""with {PAIRS}, g as (select term, before, list_distinct(list_transform(range(1, length(term) + 3), lambda i: substr('  ' || term || '  ', i, 3))) as x, list_distinct(list_transform(range(1, length(before) + 3), lambda i: substr('  ' || before || '  ', i, 3))) as y from pairs)
      select term, before, {half_up('len(list_intersect(x, y)) / greatest(len(x), len(y))')} as similarity from g""",
    "edit_distance": f"with {PAIRS} select term, before, levenshtein(term, before) as distance from pairs",
    "minor_typo": f"""with {PAIRS}, s as (select term, before, {stem('term')} as s1, {stem('before')} as s2, list_filter(range(1, least(length(term), length(before)) + 1), lambda i: substr(before, i, 1) <> substr(term, i, 1)) as diffs from pairs)
      select term, before, (length(term) >= 7 and length(before) >= 7 and abs(length(term) - length(before)) <= 1 and s1 <> s2 and not ({SYNONYMOUS}) and (levenshtein(term, before) <= 1 or (length(term) = length(before) and len(diffs) = 2 and diffs[2] = diffs[1] + 1 and substr(before, diffs[1], 1) = substr(term, diffs[2], 1) and substr(before, diffs[2], 1) = substr(term, diffs[1], 1)))) as typo from s""",
    "ocr_normalize": r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '-[ \t\n\r\f]+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) as comparable, md5(regexp_replace(replace(translate(lower(coalesce(text, '')), '0i1', 'oll'), 'rn', 'm'), '[^a-z0-9]+', '', 'g')) as term from documents",
    "page_titles": f"""with t as (select page_id, regexp_replace({clean("regexp_extract(coalesce(html, ''), '<h1>([^<]*)</h1>', 1)")}, '^#+ *', '') as v from pages) select page_id, case when length(v) <= 40 then v else rtrim(left(v, 37)) || '...' end as title from t""",
    "url_features": r"""with u as (select page_id, coalesce(url, '') as u, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
      select page_id, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) as host, regexp_matches(lower(path), '\.pdf$') as is_pdf, regexp_matches(u, '[?&](q|query|search)=') as is_search, array_to_string(list_filter(string_split(lower(regexp_replace(path, '[^A-Za-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)[1:16], ' ') as terms from u""",
    "page_statistics": r"""with b as (select page_id, regexp_replace(coalesce(html, ''), '<script>.*?</script>', '', 'gs') as h from pages)
      select page_id, len(regexp_extract_all(h, '<p[ >]')) as paragraphs, len(regexp_extract_all(h, '<li[ >]')) as list_items, len(regexp_extract_all(h, '<a[ >]')) as links, len(regexp_extract_all(h, '<h[1-4][ >]')) as headings from b""",
    "page_density": rf"""with h as (select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '</?(p|li|ul|div|h1|h2|h3|h4|nav|article|footer|br|body|html)( [^>]*)?>', ' ', 'g') as h, coalesce(html, '') as raw from pages),
      t as (select page_id, raw, regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&[a-z]+;', ' ', 'g') as body, array_to_string(list_transform(regexp_extract_all(h, '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: regexp_replace(x, '&[a-z]+;', ' ', 'g')), ' ') as linked, regexp_replace(raw, '(?s)<script>.*?</script>', '', 'g') as b from h),
      c as (select page_id, len(regexp_extract_all(b, '<p[ >]')) as paragraphs, len(regexp_extract_all(b, '<li[ >]')) as list_items, len(regexp_extract_all(b, '<a[ >]')) as links, len(regexp_extract_all(b, '<h[1-4][ >]')) as headings, {words('body')} as words, {words('linked')} as link_words from t)
      select *, {half_up('case when words > 0 then link_words / words else 0.0 end')} as link_density from c where links + paragraphs > 0""",
    "turn_groups": f"""with recursive t as (select conv_id, turn, role, {words('text')} as words, row_number() over (partition by conv_id order by turn) as nr from conversations),
      g as (select conv_id, nr, turn as first, role, words, 1::bigint as merged, turn as last, 1::bigint as k from t where nr = 1
        union all select t.conv_id, t.nr, case when j then g.first else t.turn end, t.role, case when j then g.words + t.words else t.words end, case when j then g.merged + 1 else 1 end, t.turn, case when j then g.k else g.k + 1 end
        from g join (select * from t) t on t.conv_id = g.conv_id and t.nr = g.nr + 1, lateral (select g.role = t.role and (t.turn - g.last) * 800 between 0 and 900 and not (g.words > 260 and t.words > 220) and ((t.turn - g.last) * 800 <= 360 or g.words < 80 or t.words < 80) as j))
      select conv_id as page_id, first as turn, role, max(words) as words, max(merged) as merged from g group by conv_id, k, first, role""",
    "query_expansion": f"""with {VOCABULARY}, asked as (select distinct query_id, unnest(list_transform({tokens('query')}, lambda t: t.term)) as term from (values ('q1', 'license fees'), ('q2', 'applying erations'), ('q3', 'stupids')) as v(query_id, query)),
      pairs as (select query_id, asked.term, vocabulary.term as before from asked, vocabulary where asked.term <> vocabulary.term),
      stems as (select *, {stem('term')} as s1, {stem('before')} as s2, list_filter(range(1, least(length(term), length(before)) + 1), lambda i: substr(before, i, 1) <> substr(term, i, 1)) as diffs, ({SYNONYMOUS}) as same from pairs),
      typos as (select *, length(term) >= 7 and length(before) >= 7 and left(term, 1) = left(before, 1) and abs(length(term) - length(before)) <= 1 and s1 <> s2 and not same and (levenshtein(term, before) <= 1 or (length(term) = length(before) and len(diffs) = 2 and diffs[2] = diffs[1] + 1 and substr(before, diffs[1], 1) = substr(term, diffs[2], 1) and substr(before, diffs[2], 1) = substr(term, diffs[1], 1))) as typo from stems)
      select query_id, term, before as other, 'word_form' as kind from typos where s1 = s2 union select query_id, term, before, 'synonym' from typos where same and not list_contains({_quoted(C.STOP_WORDS)}, term) union select query_id, term, before, 'typo' from typos where typo""",
    "text_sections": f"with {SECTIONS} select page_id, section, words, md5(body) as digest from kept",
    "section_terms": f"with {TERMS} select page_id, section, count(*) as terms, sum(weight) as length from terms group by all",
    "doc_frequency": f"with t as (select distinct doc_id, unnest(list_transform({tokens('text')}, lambda t: t.term)) as term from documents), f as (select term, count(*) as df from t group by term), c as (select count(*) as n from documents) select term, df, {half_up(IDF)} as idf from f, c",
    "distinctive_terms": f"""with {TERMS}, n as (select page_id, count(distinct section) as n from terms group by page_id), totals as (select page_id, term, sum(weight) as total, count(*) as df from terms group by all),
      w as (select page_id, term, df, n, {half_up(f'{IDF} * sqrt(total)')} as weight from totals join n using (page_id)), r as (select *, row_number() over (partition by page_id order by weight desc, df, term) as k from w where df < n and weight > 0.18)
      select page_id, term, df, weight from r where k <= 40""",
    "bm25_search": f"""with {TERMS}, {_ASKED}, lengths as (select page_id, section, greatest(1.0, sum(weight)) as length from terms group by all), pages_ as (select page_id, count(*) as n, avg(length) as average from lengths group by all),
      hit as (select *, count(*) over (partition by page_id, term) as df from terms where term in (select term from wanted)),
      entry as (select query_id, phrase, n_wanted, wanted, page_id, section, sum(weight * {C.BM25_K1 + 1} / (weight + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * greatest({C.LENGTH_FLOOR}, length / greatest(1.0, average)))) * greatest({C.IDF_FLOOR}, {IDF})) as raw, count(*) as matches from hit join wanted using (term) join lengths using (page_id, section) join pages_ using (page_id) group by all),
      placed as (select *, length(phrase) >= 4 and contains(lower(body), phrase) as in_body from entry join kept using (page_id, section)),
      summed as (select *, raw * 18 + case when in_body then 12 else 0 end + least(18.0, 16 * matches / n_wanted + case when matches >= 3 then 4 else 0 end) as s from placed),
      scored as (select *, {half_up('case when n_wanted = 1 and not in_body then least(s, 32.0) else s end')} as score from summed),
      ordered as (select *, row_number() over w as k, lead(score) over w as next_score from scored window w as (partition by query_id, page_id order by score desc, matches desc, section)),
      best as (select *, case when score >= {C.STRONG} and matches >= 2 then 'strong' when score >= {C.POSSIBLE} and (matches >= 2 or in_body) then 'possible' when score >= {C.WEAK} then 'weak' else 'none' end as st, {_CLEANED} as v from ordered where k = 1),
      f as (select *, coalesce(list_filter(list_transform(wanted, lambda t: instr(lower(v), t)), lambda i: i > 0)[1], 1) as pos from best), g as (select *, greatest(0, pos - 1 - {C.SNIPPET_LEAD}) as a, least(length(v), greatest(0, pos - 1 - {C.SNIPPET_LEAD}) + {C.SNIPPET_CHARS}) as z from f)
      select query_id, page_id, section, score, {half_up('score - next_score')} as margin, case when st in ('strong', 'possible') and coalesce(next_score >= {C.WEAK} and score - next_score < {C.MARGIN}, false) then 'weak' else st end as status,
        case when a > 0 then '... ' else '' end || trim(substr(v, a + 1, z - a)) || case when z < length(v) then ' ...' else '' end as snippet from g""",
    "repeated_text": rf"""with p as (select doc_id as page_id, list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?][ \n\t\r]+|\n+'), lambda p: left(lower({clean('p')}), 181)), lambda p: length(p) >= 18 and length(p) <= 180), lambda p: left(p, 90)) as keys from documents)
      select page_id, case when len(keys) >= 4 then len(keys) - len(list_distinct(keys)) else 0 end as repeats from p""",
    "signal_flags": f"with {FLAGS} select page_id, section, {', '.join(f's_{n} as {n}' for n, *_ in C.SIGNALS)} from flagged",
    "section_scores": f"with {SCORES} select * from scores",
    "rank_sections": f"with {RANKED} select * from ranked",
    "saved_minutes": f"with {SECTIONS} select page_id, section, floor(coalesce(sum(words) over (partition by page_id order by section rows between unbounded preceding and 1 preceding), 0) / {C.READING_WORDS_PER_MINUTE})::bigint as saved_minutes from kept",
    "jaccard_similarity": f"with {SECTIONS}, {SIMILAR} select * from similar_",
    "paged_section_type": f"with {SECTIONS} select page_id, section, {_TYPE} as type from kept",
    "asof_current": f"with {SECTIONS}, m as (select doc_id as page_id, (doc_id % 5) * 700.0::double as marker from documents) select page_id, marker, max_by(section, section) as section from kept join m using (page_id) where section * 800 <= marker + 24 group by all",
    "next_section": f"""with {RANKED}, {SIMILAR}, f as (select page_id, min(section) as current from ranked group by all),
      u as (select page_id, section, {half_up("least(30.0, greatest(0, score) * 0.3::double) + case when is_important then 6 else 0 end + case when section - current <= 1 then 12 when section - current = 2 then 10 when section - current = 3 then 8 when section - current <= 5 then 6 when section - current <= 8 then 4 else 2 end - least(32.0, 26 * coalesce(similarity, 0.0))")} as utility from ranked join f using (page_id) left join similar_ using (page_id, section) where section > current)
      select page_id, section, utility from u where utility >= 8 qualify row_number() over (partition by page_id order by utility desc, section) = 1""",
    "chat_flags": f"with {TURNS} select * exclude (text) from turns",
    "chat_priority": f"""with {TURNS}, w as (select *, max(case when role = 'assistant' then turn end) over p as last_mine, coalesce(max(case when role = 'user' then turn end) over p, -1) as last_user, coalesce(max(case when role = 'assistant' and has_failed_answer then turn end) over p, -1) as failed, coalesce(max(case when role = 'assistant' and (has_revision or has_final_answer or is_complete) then turn end) over p, -1) as authority from turns window p as (partition by page_id)),
      x as (select *, coalesce(max(case when role = 'user' and turn = last_user then {has('text', C.CORRECTION)}::int end) over (partition by page_id), 0) = 1 as corrected from w),
      y as (select *, turn = last_mine as latest, last_user > -1 and turn > last_user as answers, authority > -1 and turn < authority as superseded from x where role = 'assistant')
      select page_id, turn, superseded, least(88, greatest(0, 18 + {WEIGHTS}))::bigint as priority from y""",
    "role_alternation": "with b as (select *, (role <> lag(role) over (partition by conv_id order by turn))::int as change from conversations) select conv_id as page_id, count(*) as turns, coalesce(sum(change), 0)::bigint as changes from b group by conv_id",
    "latest_of_role": "select conv_id as page_id, role, max(turn) as turn, 1::bigint as rank from conversations group by all",
    "head_tail_sample": f"""with p as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as up, row_number() over (partition by conv_id order by turn desc) as down from conversations),
      e as (select *, n <= 4 or up <= 1 or down <= 2 as ends from p), s as (select *, not ends and role = 'assistant' and ({has('text', C.STRONG_MIDDLE)} or coalesce(contains(text, '```'), false)) as strong from e),
      r as (select *, sum(strong::int) over (partition by conv_id order by turn desc) as k from s) select conv_id as page_id, turn, role from r where ends or (strong and k <= 1)""",
    "debounce_sessions": """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
      select user_id, min(epoch_us(ts)) as started_us, max(epoch_us(ts)) + 1800000000 as fires_us, count(*) as n from s group by user_id, k""",
    "signature_changes": "select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is null or before <> event_type",
    "recent_k": "with l as (select user_id, event_type, max({'ts': ts, 'event_id': event_id}) as seen from events group by all), r as (select *, row_number() over (partition by user_id order by seen desc) as rank from l) select user_id, event_type, rank from r where rank <= 3",
    "ttl_filter": "select user_id, event_type, epoch_us(max(ts)) as ts_us from events group by all having max(ts) >= (select max(ts) from events) - interval 1440 minutes",
    "request_order": "select event_id, user_id from (select *, max(event_id) over (partition by user_id order by ts, event_id desc rows between unbounded preceding and 1 preceding) as so_far from events) where so_far is null or event_id > so_far",
    "route_changes": "with b as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) select user_id, count(*) as visits, sum((before is not null and before <> event_type)::int)::bigint as changes from b group by user_id",
    "excluded_sections": f"with {SECTIONS} select page_id, section from kept where page_id in (select doc_id from labels) and section > (select min(k.section) from kept k where k.page_id = kept.page_id)",
    "line_geometry": "with l as (select p_partkey % 50 as chunk_id, p_partkey % 2 as variant, ((p_partkey * 7) % 97)::double as x0, ((p_partkey * 11) % 89)::double as y0, ((p_partkey * 13) % 211)::double as x1, ((p_partkey * 17) % 193)::double as y1 from part) select chunk_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(distinct variant) = 1 as exact from l group by chunk_id",
}
