"""DuckDB SQL of the operators that SQL can express: the definitions themselves, over whole tables."""

from __future__ import annotations


def near_groups_sql(percent: int, last_columns: str) -> str:
    """Components of documents whose sets of five-word shingles have a Jaccard index of percent hundredths or more: shingles
    meet by equality, and the least reachable document is found by passing it on along links."""
    return rf"""with recursive
      words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
      shingles as materialized (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) end)) as s from words),
      sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
      sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) as h from shingles group by doc_id),
      reps as materialized (select doc_id, min(doc_id) over (partition by h) as rep from sets),
      own as materialized (select s.doc_id, hash(s.s) as s from shingles s join reps r on r.doc_id = s.doc_id and r.rep = r.doc_id),
      shared as materialized (select s from own group by s having count(*) > 1),
      few as materialized (select doc_id, s from own semi join shared using (s)),
      met as (select a.doc_id as a, b.doc_id as b, count(*) as i from few a join few b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
      links as materialized (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= {percent} * (x.n + y.n - i)),
      both_ways as materialized (select a, b from links union all select b, a from links),
      reach(d, c) as (select doc_id, doc_id from sizes union select e.b, r.c from reach r join both_ways e on e.a = r.d where r.c < e.b),
      least as (select d, min(c) as c from reach group by d),
      named as (select doc_id, c from reps join least on d = rep)
      select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, d.doc_id) as component_id{last_columns} from documents d left join sizes using (doc_id) left join named using (doc_id)"""


_CRC = "(with recursive t(i, c, k) as (select i, i::uinteger, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end, k + 1 from t where k < 8) select list(c order by i) from t where k = 8)"
_GUMBEL = "floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint"
IMPORTANCE_SQL = rf"""with steps as materialized (select {_CRC} as t),
  texts as (select 0 as corpus, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
  words as (select corpus, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
  runs as (select corpus, id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f from words),
  features as materialized (select corpus, id, f, count(*) as n from (select corpus, id, unnest(f) as f from runs) group by all),
  bytes as (select f, hex(encode(f)) as h from (select distinct f from features)),
  buckets as materialized (select f, (xor(list_reduce(list_prepend(4294967295::uinteger, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::uinteger)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::uinteger) % 10000)::bigint as bucket from bytes, steps),
  counts as (select bucket, coalesce(sum(n) filter (corpus = 0), 0) as s, coalesce(sum(n) filter (corpus = 1), 0) as t from features join buckets using (f) group by bucket),
  whole as (select sum(s)::double as s, sum(t)::double as t from counts),
  gains as (select bucket, floor(1000 * ln((c.t + 1)::double * (w.s + 10000) / ((c.s + 1)::double * (w.t + 10000))))::bigint as gain from counts c, whole w),
  weights as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from features join buckets using (f) join gains using (bucket) where corpus = 0 group by id),
  scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint + {_GUMBEL} as score, len(w) >= 20 as fit from documents d left join weights on id = doc_id join words x on x.corpus = 0 and x.id = doc_id),
  placed as (select *, case when fit then row_number() over (partition by fit order by score desc, doc_id) end as place, count(*) filter (fit) over () as fits from scored)
  select doc_id, n_features, weight, score, case when place <= 5 * fits // 100 then place end as rank from placed"""

ORACLE_SQL = {
    "op5_jaccard_join": near_groups_sql(75, ", count(*) over (partition by coalesce(c, d.doc_id)) as n_members"),
    "op11_importance": IMPORTANCE_SQL,
    "op13_near_dedup": near_groups_sql(85, ", coalesce(c, d.doc_id) = d.doc_id as kept"),
}
