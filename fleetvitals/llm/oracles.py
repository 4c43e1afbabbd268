"""SQL (DuckDB) for the queries it can express, written apart from the operators."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {_AZ}), '{pattern}')"


_BLANK = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_words('text', _BLANK)} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') as g
 from w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n_both
 from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
 where 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach as (select doc_id, doc_id as other from documents
 union select r.doc_id, l.b from reach r join links l on l.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id,
 d.doc_id = component_id as kept
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x:
   cast(floor(1024 * cast(x as double)) as bigint)) as c
 from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(
   range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) as bigint) as score
 from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and len(v.c) = len(q.c))
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (
 partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""

CONTAMINATION = f"""
with w as (select doc_id, {_words('text', _PLAIN)} as ws from documents),
i as (select cast(item_id as varchar) as item, {_words('text', _PLAIN)} as ws
 from benchmark where item_id is not null),
win as (select distinct item, least(10, len(ws)) as n,
  array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') as g
 from i, unnest(range(1, greatest(1, len(ws) - 9) + 1)) t(k) where len(ws) > 0),
spots as (select doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') as g
 from w, (select distinct n from win) l, unnest(range(1, len(ws) - n + 2)) t(k)),
found as (select doc_id, k, s.n, item from spots s join win on win.n = s.n and win.g = s.g),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(k, k + n)) as p
 from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
 from (select distinct doc_id, item from found) group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit on hit.doc_id = w.doc_id left join named on named.doc_id = w.doc_id"""

CHAT = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
 from conversations
 union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
 union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) as role_chars,
  length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars from c),
g as (select conv_id, count(*) as n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as said,
  sum(length('<|im_start|>') + role_chars + 1 + text_chars + length('<|im_end|>') + 1) as chars
 from e group by 1)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(said) as loss_chars,
 sha256(said) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""

_CRC_STEP = "xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)"
SLOTS = f"""
with recursive crc as (select list(c order by b) as t from (select b, list_reduce(
   list_prepend(cast(b as bigint), cast(range(8) as bigint[])), lambda c, k: {_CRC_STEP}) as c
  from (select unnest(range(256)) as b))),
d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h
 from documents),
k as (select doc_id, strlen(text) + 8 as size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)),
    lambda i: cast(concat('0x', h[2 * i + 1:2 * i + 2]) as bigint))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) as text_crc32,
  coalesce(cast(doc_id as varchar), '') as id from d, crc),
n as (select *, count(*) over (partition by id) as n,
  row_number() over (partition by id, size, text_crc32) - 1 as copy from k),
r as (select doc_id, size, text_crc32, cast(concat('0x', md5(case when n = 1 then id
  else concat(id, ':', size, ':', text_crc32, ':', copy) end)[1:8]) as bigint) % 4096
    as virtual_slot from n),
s as (select virtual_slot, sum(size) as bytes, row_number() over (
  order by sum(size) desc, virtual_slot) as i from r group by 1),
m as (select cast(0 as bigint) as i, list_transform(range(24), lambda x: cast(0 as hugeint)) as loads,
  cast(null as bigint) as virtual_slot, cast(null as bigint) as shard
 union all
 select s.i, list_transform(loads, lambda x, j: case when j = least_at then x + s.bytes else x end),
  s.virtual_slot, least_at - 1
 from (select *, list_position(loads, list_min(loads)) as least_at from m) p
 join s on s.i = p.i + 1)
select doc_id, size, text_crc32, 'bytes' as law, cast(shard as int) as shard,
 row_number() over (partition by shard order by r.virtual_slot, doc_id nulls first, size, text_crc32)
   - 1 as slot,
 cast(null as int) as grown_shard, cast(r.virtual_slot as int) as virtual_slot
from r join m on m.virtual_slot = r.virtual_slot"""


_CRC_TABLE = f"""crc as (select list(c order by b) as t from (select b, list_reduce(
   list_prepend(cast(b as bigint), cast(range(8) as bigint[])), lambda c, k: {_CRC_STEP}) as c
  from (select unnest(range(256)) as b)))"""
# Decimal digits and the minus sign are one byte each.
_CRC_OF_ID = """xor(list_reduce(list_prepend(4294967295, list_transform(
   string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"""
RUNS = f"""
with {_CRC_TABLE},
d as (select row_number() over () as r, doc_id, {_CRC_OF_ID} as h,
  regexp_extract_all(coalesce(text, ''), '{_BLANK}') as ws from documents, crc),
e as (select r, doc_id, ws, len(ws) as n, h % 10 = 0 as looped, h // 10 as g,
  (h // 10) % greatest(len(ws), 1) as a from d),
w as (select r, doc_id, n, case when looped and n > 0 then list_transform(range(n), lambda i:
   ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end])
  else ws end as ws from e),
s as (select r, i, array_to_string(ws[i + 1:i + 6], ' ') as g from w, unnest(range(n - 5)) t(i)),
m as (select a.r, a.i - b.i as q, a.i from s a join s b on a.r = b.r and a.g = b.g and a.i > b.i),
x as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from m),
l as (select r, q, min(i) - q as start, count(*) + 5 + q as length from x group by r, q, k),
u as (select r, start, length, min(q) as period from l
 where length >= greatest(12, 2 * q) group by r, start, length),
gone as (select distinct r, unnest(range(start + period, start + length)) as p from u),
kept as (select w.r, string_agg(ws[i + 1], ' ' order by i) as text from w, unnest(range(n)) t(i)
 where not exists (select 1 from gone where gone.r = w.r and gone.p = i) group by w.r),
named as (select r, count(*) as n_runs,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines,
  arg_min(struct_pack(s := start, n := length, p := period), (-length, start, period)) as best
 from u group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.n as length, best.p as period,
 1000 * best.n // best.p as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
 sha256(coalesce(kept.text, '')) as collapsed_sha256
from w left join named on named.r = w.r left join kept on kept.r = w.r"""

REPEATS = f"""
with w as (select row_number() over () as r, doc_id,
  regexp_extract_all(coalesce(text, ''), '{_BLANK}') as ws from documents),
v as (select r, i, array_to_string(ws[i:i + 34], ' ') as g from w, unnest(range(1, len(ws) - 33)) t(i)),
twice as (select g from v group by g having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from v semi join twice on v.g = twice.g),
kept as (select w.r, string_agg(ws[i], ' ' order by i) as text
 from w, unnest(range(1, len(ws) + 1)) t(i)
 where not exists (select 1 from gone where gone.r = w.r and gone.p = i) group by w.r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, len(ws) as n_words, coalesce(lost.n, 0) as n_removed,
 sha256(coalesce(kept.text, '')) as kept_sha256
from w left join lost on lost.r = w.r left join kept on kept.r = w.r"""


def texts() -> dict[str, str]:
    return {
        "op1_minhash_forest": NEAR_DUPLICATES,
        "op2_impact_topk": TOP_K,
        "op3_aho_corasick": CONTAMINATION,
        "op5_reply_trees": CHAT,
        "op7_virtual_slots": SLOTS,
        "op11_periodic_runs": RUNS,
        "op13_suffix_automata": REPEATS,
    }
