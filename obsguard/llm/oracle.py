"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def registered() -> dict:
    return dict(ORACLE)


ORACLE["op10_decontaminate"] = r"""
with dw as (
  select doc_id, text, w, i from (
    select doc_id, text, unnest(words) as w, generate_subscripts(words, 1) as i from (
      select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
      from documents))),
bw as (
  select item_id, w, i, n from (
    select item_id, len(words) as n, unnest(words) as w, generate_subscripts(words, 1) as i from (
      select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
      from benchmark))),
bwin as (
  select item_id, least(n, 10) as k, win from (
    select item_id, n, i, string_agg(w, ' ') over (partition by item_id order by i
      rows between current row and 9 following) as win from bw)
  where i <= greatest(n - 9, 1)),
dwin as (
  select doc_id, i, k, win from (
    select doc_id, i, k, string_agg(w, ' ') over (partition by doc_id, k order by i
             rows between current row and 9 following) as win,
           count(*) over (partition by doc_id, k order by i rows between current row and 9 following) as c
    from dw cross join (select distinct k from bwin where k = 10))
  where c = 10),
short as (
  select d.doc_id, d.i, b.k, b.item_id from bwin b join (
    select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 8 following) as ws from dw) d
    on b.k < 10 and array_to_string(d.ws[1:b.k], ' ') = b.win and len(d.ws) >= b.k),
hits as (
  select doc_id, i, dwin.k as k, item_id from dwin join bwin using (win) where bwin.k = 10
  union all select doc_id, i, k, item_id from short),
covered as (
  select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (
    select distinct doc_id, item_id::varchar as item from hits) group by doc_id),
sizes as (select doc_id, count(*) as n_words from dw group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents d left join sizes using (doc_id) left join covered using (doc_id) left join items using (doc_id)
"""


ORACLE["op2_mixing"] = r"""
with d as (
  select doc_id, source as src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('29|' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))), 1, 13))::bigint as bits
  from documents),
t as (select src, sum(size)::bigint as source_size from d group by src),
w as (select src, source_size, [3.0, 1.0, 2.0][((row_number() over (order by src nulls last) - 1) % 3 + 1)::int]::double as w from t),
p as (
  select *, (2 * source_size) as cap,
         coalesce(sum(2 * source_size) over (order by 2 * source_size / w, w, source_size, src
                  rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by 2 * source_size / w, w, source_size, src rows between current row and unbounded following) as wleft,
         sum(source_size) over () as total
  from w),
lev as (select arg_min(level, ratio) as level from (
  select (1.5 * total - before)::double / wleft as level, cap / w as ratio from p) where level < ratio),
tt as (select src, source_size, least(w * coalesce(level, 0), cap::double) as target from p cross join lev),
m as (
  select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from tt),
k as (
  select d.doc_id, d.size, d.src, source_size, target, floor(ratio)::bigint as whole, ratio - floor(ratio) as chance,
         target - floor(ratio)::bigint * source_size as need, (bits::double + 0.5) / 4503599627370496.0 as u
  from d join m on d.src is not distinct from m.src),
r as (
  select *, case when chance > 0 then floor(((u / (1 - u)) / (chance / (1 - chance)))
              / (1 + ((u / (1 - u)) / (chance / (1 - chance)))) * 4503599627370496.0)::bigint end as rk from k),
g as (select src, rk, sum(size) as words from r where rk is not null and need > 0 and size > 0 group by src, rk),
c as (select src, rk, words, sum(words) over (partition by src order by rk rows unbounded preceding) as after from g),
f as (
  select c.src, max(case when after - words + words / 2.0 < n.need then c.rk else -1 end) as cut
  from c join (select distinct src, need from r) n on c.src is not distinct from n.src
  where after - words < n.need group by c.src)
select doc_id, size, source_size, target, whole + (coalesce(rk <= coalesce(cut, -1), false))::bigint as copies,
       (whole + (coalesce(rk <= coalesce(cut, -1), false))::bigint) * size as taken
from r left join f on r.src is not distinct from f.src
"""


ORACLE["op8_neighbours"] = r"""
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.r, q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score
  from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score, (row_number() over (partition by r order by score desc, vec_id))::int as rank from p)
where rank <= 20
"""

ORACLE["op7_chat"] = r"""
with t as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as place
  from conversations),
people as (select distinct conv_id, role as perspective from t where role <> 'system'),
r as (
  select t.conv_id, perspective, place, place // 64 as segment, role = perspective as own,
         case when role = perspective then '<|assistant|>' when role = 'system' then '<|system|>'
              else '<|user|>' || role end || chr(10) as head, text || '<|end|>' || chr(10) as body
  from t join people on t.conv_id is not distinct from people.conv_id),
s as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, perspective, segment order by place)
             - length(body) as start,
         sum(length(head) + length(body)) over (partition by conv_id, perspective, segment order by place) as stop
  from r),
g as (
  select conv_id, perspective, segment, string_agg(head || body, '' order by place) as text,
         coalesce(string_agg(case when own then start::varchar || '-' || stop::varchar end, ' ' order by place), '') as mask,
         count(*) as n_turns, count(*) filter (own) as own_turns, max(stop)::bigint as n_chars
  from s group by conv_id, perspective, segment)
select *, coalesce(sum(n_chars) over (partition by conv_id, perspective order by segment
                   rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
from g
"""


ORACLE["op11_lexical_search"] = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
l as (select r, doc_id, len(words)::bigint as n, words from d where len(words) > 0),
facts as (select count(*) as big_n, sum(n)::bigint as big_l from l),
tf as (select r, w, count(*)::bigint as tf from (select r, unnest(words) as w from l) group by r, w),
q as (
  select distinct i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from (select row_number() over () as i, item_id, text from benchmark)),
df as (select w, count(*) as df from tf where w in (select w from q) group by w),
wt as (select w, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as weight from df, facts),
s as (
  select i, item_id, tf.r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::bigint as score
  from q join wt using (w) join tf using (w) join l on tf.r = l.r, facts group by i, item_id, tf.r),
k as (
  select item_id, (row_number() over (partition by i order by score desc, doc_id nulls last))::int as rank, doc_id, score
  from s join l using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""


ORACLE["op12_jaccard_join"] = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select r, doc_id, case when words is null or len(words) = 0 then []
    when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as sh from d),
n as (select r, doc_id, len(sh)::bigint as n from s),
t as materialized (select r, md5_number(w) as w from (select r, unnest(sh) as w from s)),
many as materialized (select r, w from t where w in (select w from t group by w having count(*) > 1)),
links as materialized (
  select a, b from (select x.r as a, y.r as b, count(*) as i from many x join many y using (w) where x.r < y.r group by a, b)
  join n na on na.r = a join n nb on nb.r = b where 100 * i >= 80 * (na.n + nb.n - i)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select r, r from n union select reach.a, edges.b from reach join edges on edges.a = reach.b),
c as (select a as r, min(doc_id) as component_id from reach join n on n.r = reach.b group by a)
select doc_id, n as n_shingles, component_id from n join c using (r)
"""


ORACLE["op13_merkle_manifest"] = r"""
with recursive f as (
  select row_number() over () as r, doc_id, lang, n_chars,
         coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
         || coalesce(strlen(lang)::varchar || ':' || lang, '-') as head,
         coalesce(strlen(text)::varchar || ':' || text, '-') as body,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) as crc
  from documents),
leaves as materialized (
  select r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || body) as leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar, '-') || body) as other,
         coalesce(crc % 7 = 0, false) as hit from f),
coded as materialized (
  select *, dense_rank() over (order by lang nulls first) - 1 as t, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place,
         count(*) over (partition by lang) as n from leaves),
nodes(t, lvl, place, n, h) as (
  select t, 0, place, n, leaf from coded
  union all
  select t, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' order by place)) from nodes where n > 1 group by t, lvl, place // 2, n),
subroots as materialized (select t, h, count(*) over () as m from nodes where n = 1),
tops(lvl, place, n, h) as (
  select 0, t, m, h from subroots
  union all
  select lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' order by place)) from tops where n > 1 group by lvl, place // 2, n),
lower_siblings as materialized (
  select c.r, x.lvl, x.h from coded c join nodes x on x.t = c.t and x.place = xor(c.place >> x.lvl, 1)),
upper_siblings as materialized (select s.t, x.lvl, x.h from subroots s join tops x on x.place = xor(s.t >> x.lvl, 1)),
proofs as (
  select c.r, sha256(coalesce((select string_agg(h, '' order by lvl) from lower_siblings l where l.r = c.r), '')
                     || coalesce((select string_agg(h, '' order by lvl) from upper_siblings u where u.t = c.t), '')) as proof_sha256 from coded c),
fold(r, t, lvl, place, n, v) as (
  select r, t, 0, place, n, case when hit then other else leaf end from coded
  union all
  select f.r, f.t, f.lvl + 1, f.place // 2, (f.n + 1) // 2, sha256(case when f.place % 2 = 0 then f.v || coalesce(s.h, '') else s.h || f.v end)
  from fold f left join lower_siblings s on s.r = f.r and s.lvl = f.lvl where f.n > 1),
fold_up(r, t, lvl, place, n, v) as (
  select r, f.t, 0, f.t, m, v from fold f join subroots s on s.t = f.t where f.n = 1
  union all
  select f.r, f.t, f.lvl + 1, f.place // 2, (f.n + 1) // 2, sha256(case when f.place % 2 = 0 then f.v || coalesce(s.h, '') else s.h || f.v end)
  from fold_up f left join upper_siblings s on s.t = f.t and s.lvl = f.lvl where f.n > 1)
select c.doc_id, c.leaf, s.h as subroot, (select h from tops where n = 1) as root, p.proof_sha256, f.v as folded_root,
       f.v = (select h from tops where n = 1) as verified
from coded c join subroots s on s.t = c.t join proofs p on p.r = c.r join fold_up f on f.r = c.r and f.n = 1
"""
