"""SQL counterparts of the registered queries."""

WORD = r"[^\x20\x09-\x0D]+"

#: Exact sets and all linked pairs by brute force, then components by walking the links.
OP1 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, case when len(words) < 4 then words else words[i:i+3] end as g
  from w, unnest(generate_series(1, greatest(1, len(words) - 3))) as t(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select a as doc_id, min(b) as component_id from reach group by 1) left join n using (doc_id)
"""

#: Shingles of the items found anywhere, counted in passages of two stretches as long as the longest item.
OP2 = r"""
with low as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from benchmark),
i as (select item_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from low),
cut as (
  select item_id, w, coalesce(nullif(nullif(list_position(list_transform(w, lambda x: x like '%?'), true), 0), len(w)), (len(w) + 1) // 2) as cut_at from i),
half as (select item_id, 'q' as part, w[1:cut_at] as w from cut union all select item_id, 'a', w[cut_at + 1:len(w)] from cut),
g as (
  select distinct item_id, part, case when len(w) < 5 then w else w[k:k+4] end as g
  from half, unnest(generate_series(1, greatest(1, len(w) - 4))) as t(k) where len(w) > 0),
n as (select item_id, count(*) filter (part = 'q') as n_question, count(*) filter (part = 'a') as n_answer from g group by 1),
longest as (select max(len(w)) as m from i),
d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select doc_id, k - 1 as pos, w[k:k+4] as g from d, unnest(generate_series(1, greatest(1, len(w) - 4))) as t(k) where len(w) > 0),
hit as (
  select distinct doc_id, item_id, part, g, p from sh join g using (g), longest, unnest([pos // m - 1, pos // m]) as t(p)
  where p >= 0 and pos + len(g) <= (p + 2) * m),
best as (
  select doc_id, item_id, p, count(*) filter (part = 'q') as q, count(*) filter (part = 'a') as a from hit group by 1, 2, 3)
select doc_id, item_id, n_question, n_answer, q as question_found, a as answer_found
from best join n using (item_id)
where 100 * (q + a) >= 80 * (n_question + n_answer) and 2 * q >= n_question and 2 * a >= n_answer
qualify row_number() over (partition by doc_id, item_id order by q + a desc, p) = 1
"""

#: All candidates of all queries, products added in the order of the dimensions.
OP4 = r"""
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)
    / (sqrt(list_inner_product(c.e, c.e)) * sqrt(list_inner_product(q.e, q.e))) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""

OP5 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5('mix/' || coalesce(cast(doc_id as varchar), 'null'))[1:16] as turn from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, 2.0e0 * sum(size) as cap,
    [3e0, 1e0, 2e0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from d group by 1),
b as (select 1.5e0 * sum(source_size) as budget from s),
levels as (
  select (budget - capped) / free as level, ratio, next_ratio from (
    select ratio, coalesce(lead(ratio) over (order by ratio), 1e300) as next_ratio,
      sum(cap) over (order by ratio) as capped, (select sum(weight) from s) - sum(weight) over (order by ratio) as free
    from (
      select 0e0 as ratio, 0e0 as cap, 0e0 as weight union all
      select cap / weight, sum(cap), sum(weight) from s group by 1)), b where free > 0),
l as (select min(level) as level from levels where level >= ratio and level <= next_ratio),
q as (
  select doc_id, size, source_size, least(level * weight, cap) as target,
    sum(size) over (partition by d.source order by turn, doc_id, size rows unbounded preceding) - size as start
  from d join s on d.source is not distinct from s.source, l)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) as bigint) as taken
from q
"""

#: Cuts after hashed numbers of lines; the text that is rebuilt is the text itself.
OP11 = r"""
with h as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
u as (
  select doc_id, text, case when text = '' then []::varchar[] else regexp_extract_all(text, '[^\n]*\n|[^\n]+') end as units,
    cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[25:32] as bigint) as h4 from h),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (
  select doc_id, text, n, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
    array_to_string(units[b + 1:], '') as suffix,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""

_ROUND = """
n{k} as (
  select vec_id, part, e from (
    select v.vec_id, v.part, b.e, row_number() over (partition by v.vec_id, v.part order by sum((v.x - b.x) * (v.x - b.x)), b.e) as o
    from v join b{k} b using (part, place) group by v.vec_id, v.part, b.e) where o = 1)"""
_MOVE = """
s{k} as (
  select part, e, place, cast(sum(x) as bigint) as s, count(*) as n from n{k} join v using (vec_id, part) group by 1, 2, 3),
b{next} as (
  select part, e, place, case when n is null then x else (s - ((s % n) + n) % n) // n end as x from b{k} left join s{k} using (part, e, place))"""

#: The rounds one after the other, every part against every entry.
OP12 = """
with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (
  select vec_id, (i - 1) // (len(embedding) // 8) as part, (i - 1) % (len(embedding) // 8) as place,
    cast(floor(4096 * cast(embedding[i] as double)) as bigint) as x
  from kept, unnest(generate_series(1, len(embedding))) as t(i)),
b0 as (
  select part, o - 1 as e, place, x from v join (select vec_id, row_number() over (order by vec_id) as o from kept) using (vec_id) where o <= 16),
""" + ",".join(_ROUND.format(k=k) + "," + _MOVE.format(k=k, next=k + 1) for k in range(6)) + "," + _ROUND.format(k=6) + """,
f as (
  select vec_id, cast(sum((v.x - b.x) * (v.x - b.x)) as bigint) as error
  from v join n6 using (vec_id, part) join b6 b on b.part = v.part and b.e = n6.e and b.place = v.place group by 1),
c as (select vec_id, string_agg(printf('%02x', e), '' order by part) as code from n6 group by 1),
l as (select kept.label, cast(sum(error) as bigint) as label_error from kept join f using (vec_id) group by 1)
select kept.vec_id, code, error, label_error, (select sha256(string_agg(cast(x as varchar), ',' order by part, e, place)) from b6) as codebooks_sha256
from kept join f using (vec_id) join c using (vec_id) join l on l.label is not distinct from kept.label
"""

SQL = {"op1_near_duplicates": OP1, "op2_decontamination": OP2, "op4_neighbours": OP4, "op5_mixing": OP5, "op11_fill_middle": OP11, "op12_vector_codes": OP12}
