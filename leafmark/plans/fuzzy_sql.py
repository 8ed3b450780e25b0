"""DuckDB SQL of the fuzzy join: all terms against all words, the definition itself."""

from __future__ import annotations

from leafmark.operators.fuzzy import LIKENESS, LONG, SHORT
from leafmark.plans.oracle import tokens

_FORM = "regexp_replace(regexp_replace(translate(lower(term), '0i1', 'oll'), 'rn', 'm', 'g'), '[^a-z0-9]+', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || form || '  ') - 1), lambda i: substr('  ' || form || '  ', i, 3)))"


def _words(name: str, table: str) -> str:
    return f"""{name}_t as (select distinct unnest(list_transform({tokens('text')}, lambda t: t.term)) as term from {table}),
      {name}_f as (select term, {_FORM} as form from {name}_t where length(term) >= {SHORT}), {name} as materialized (select term, form, {_GRAMS} as grams from {name}_f where form <> '')"""


_LIMIT = f"case when length(a.form) >= {LONG} or length(b.form) >= {LONG} then 2 else 1 end"
_BOTH = f"""pairs as (select a.term, b.term as other, a.form = b.form as same, levenshtein(a.form, b.form) as d, {_LIMIT} as k, length(a.form) as n, length(b.form) as m, len(list_intersect(a.grams, b.grams)) / greatest(len(a.grams), len(b.grams)) as likeness
    from asked a join known b on a.term <> b.term and abs(length(a.form) - length(b.form)) <= 2),
  judged as (select *, case when same then 'ocr-glyph-normalized' when d <= k then case when (n = {SHORT} or m = {SHORT} or least(n, m) < {SHORT}) and d <> 1 then null else 'edit-distance' end when least(n, m) > {SHORT} and likeness >= {LIKENESS} then 'trigram' end as method from pairs),
  matches as (select term, other, method, case when method = 'edit-distance' then d else 0 end::bigint as distance, floor(case when same then 0.66 when method = 'edit-distance' then greatest(0.42, 0.74::double - d * 0.14::double) else greatest(0.36::double, likeness * 0.58::double) end * 1000 + 0.5) / 1000.0 as strength from judged where method is not null)"""
_MATCHES = f"with {_words('asked', 'benchmark')}, {_words('known', 'documents')}, {_BOTH}"

FUZZY_SQL = {
    "fuzzy_terms": f"{_MATCHES} select * from matches",
    "fuzzy_best": f"{_MATCHES} select term, other, method, distance, strength, count(*) over (partition by term) as candidates from matches qualify row_number() over (partition by term order by strength desc, other) = 1",
}
