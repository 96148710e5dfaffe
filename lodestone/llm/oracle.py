"""SQL for the training-data queries that SQL can express, for comparison on small tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = r"[ \t\n\x0B\f\r]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_BLANKS}'), lambda w: w <> '')"


SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_split("coalesce(text, '')")} as w from documents),
s as (select doc_id, len(w) as n_words, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
g as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h from s),
f as (select h, min(doc_id) as first from g group by 1),
r as (select doc_id, i from g join f using (h) where first < doc_id),
p as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
c as (select doc_id, i, word, max(case when r.i is not null then 1 else 0 end) over (partition by p.doc_id order by p.i rows between 49 preceding and current row) as gone from p left join r using (doc_id, i)),
k as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, sha256(coalesce(string_agg(case when gone = 0 then word end, ' ' order by i), '')) as kept_sha256 from c group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join k using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive d as (select doc_id, {_split(_LOWER.format("coalesce(text, '')"))} as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
x as (select doc_id, len(g) as n, unnest(g) as h from s),
m as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by all),
l as (select a, b from m where 100 * k >= 75 * (na + nb - k)),
e as (select a, b from l union all select b, a from l),
reach(node, low) as (select doc_id, doc_id from s union select e.b, reach.low from reach join e on e.a = reach.node where reach.low < e.b),
c as (select node, min(low) as component_id from reach group by 1)
select doc_id, len(g) as n_shingles, component_id, doc_id = component_id as kept from s join c on node = doc_id
"""

DECONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w from benchmark),
q as (select item_id, least(13, len(w)) as size, w from b where len(w) > 0),
p as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as h from (select *, unnest(range(1, len(w) - size + 2)) as i from q)),
sizes as (select distinct size from p),
g as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as h from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
o as (select doc_id, i, size, item_id from g join p using (size, h)),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + size)) as j from o) group by 1),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item from o) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join hits using (doc_id) left join items using (doc_id)
"""


def _whole(scale: int, more: str = "") -> str:
    """Vectors that take part, as whole numbers held by doubles."""
    return f"""v as (select vec_id{more}, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as e from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""


EXACT_SEARCH = f"""
with {_whole(64)},
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

HARD_NEGATIVES = f"""
with {_whole(256, ", case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label")},
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
 from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id where a.label is not null and c.label is not null),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score from p join s using (anchor_id)
 where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score),
r as (select *, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int) as rank from n)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 10
"""


def _edit(state: str, cost: str, letter: str, turn: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {turn}}}"


_OWN, _USER, _ASSISTANT = r"chr(10) || role || ':' || text", r"chr(10) || 'user:' || text", r"chr(10) || 'assistant:' || text"
_NEW_USER, _NEW_ASSISTANT = r"chr(10) || 'user:'", r"chr(10) || 'assistant:'"
_NONE = "{'c': 1000000000, 'a': '', 'r': ''}"

CONVERSATION_REPAIR = f"""
with recursive t as materialized (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as v),
k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
m as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
 xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from k, t),
w as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
 unnest(range(case when kind = 3 then 2 else 1 end)) as copy from m where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(role || ':' || text), copy) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from w),
f as (select *, case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
 left(role, 1) as one, lag(left(role, 1)) over (partition by conv_id order by i) as before from o),
c as (select distinct conv_id from conversations),
d(conv_id, i, s0, s1, s2, s3) as (
 select conv_id, 0::bigint, {{'c': 0, 'a': '', 'r': ''}}, {_NONE}, {_NONE}, {_NONE} from c
 union all
 select conv_id, i, list_min([{_edit('s0', '2', 'D', "''")}]),
  list_min([{_edit('s1', '2', 'D', "''")}, case when ok and one = 's' then {_edit('s0', 'late', 'K', _OWN)} else {_NONE} end]),
  list_min([{_edit('g2', '2', 'D', "''")}, case when ok and one = 'u' then {_edit('g', 'late', 'K', _OWN)} else {_NONE} end, case when ok then {_edit('g', '1 + late', 'R', _USER)} else {_NONE} end]),
  list_min([{_edit('g3', '2', 'D', "''")}, case when ok and one = 'a' then {_edit('g2', 'late', 'K', _OWN)} else {_NONE} end, case when ok then {_edit('g2', '1 + late', 'R', _ASSISTANT)} else {_NONE} end])
 from (select *, list_min([s0, s1, g3]) as g from (select f.conv_id, f.i, one, role, text, fault not in (1, 2) as ok, case when fault = 3 then 5 else 0 end as late, s0, s1,
   list_min([s2, {_edit('s0', '5', 'I', _NEW_USER)}, {_edit('s1', '5', 'I', _NEW_USER)}, {_edit('s3', '5', 'I', _NEW_USER)}]) as g2,
   list_min([s3, {_edit('s2', '5', 'I', _NEW_ASSISTANT)}]) as g3 from d join f on f.conv_id is not distinct from d.conv_id and f.i = d.i + 1))),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
 count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || one not in ('su', 'ua', 'au')) as illegal from f group by 1),
e as (select d.conv_id, i, list_min([s0, s3, {_edit('s2', '5', 'I', _NEW_ASSISTANT)}]) as best from d left join n on n.conv_id is not distinct from d.conv_id where i = coalesce(n.n, 0))
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 best.c::bigint as cost, best.a as audit, sha256(substr(best.r, 2)) as repaired_sha256 from e left join n on n.conv_id is not distinct from e.conv_id
"""
