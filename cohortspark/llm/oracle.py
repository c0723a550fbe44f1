"""DuckDB statements of the training-data queries that SQL can express on whole tables.

The others hang on learnt weights, a tokenizer's merges or a hash that DuckDB
does not have; the tests hold those against brute force.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EMBEDDING_DEDUP = """
with recursive s as (
  select vec_id, v, sqrt(list_inner_product(v, v)) as n from (select vec_id, embedding::double[] as v from embeddings)
  where vec_id is not null and len(v) > 0 and list_count(v) = len(v) and len(list_filter(v, lambda x: not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x != 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from s a join s b on a.vec_id != b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach(a, c) as (select vec_id, vec_id from embeddings union select link.b, reach.c from reach join link on link.a = reach.a),
degree as (select a, count(*) as n from link group by a),
least as (select a, min(c) as component_id from reach group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.a = e.vec_id left join degree d on d.a = e.vec_id
"""

DECONTAMINATE = rf"""
with words as (
  select 'doc' as kind, cast(doc_id as varchar) as id, text from documents union all
  select 'item', cast(item_id as varchar), text from benchmark),
split as (
  select kind, id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from words),
item as (select id, ws, least(10, len(ws)) as n from split where kind = 'item' and len(ws) > 0),
item_window as (select distinct id, n, array_to_string(ws[p:p + n - 1], ' ') as k from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from item)),
doc as (select id, ws from split where kind = 'doc'),
place as (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from doc, (select distinct n from item_window) where len(ws) >= n),
hit as (
  select place.id, place.p, place.n, item_window.id as item from place
  join item_window on item_window.n = place.n and item_window.k = array_to_string(place.ws[place.p:place.p + place.n - 1], ' ')),
marked as (select id, count(distinct q) as n_hit from (select id, unnest(range(p, p + n)) as q from hit) group by id),
named as (select id, list(item order by item) as items from (select distinct id, item from hit) group by id)
select d.doc_id, len(doc.ws) as n_words, coalesce(m.n_hit, 0) as n_hit, coalesce(len(named.items), 0) as n_items,
  sha256(coalesce(array_to_string(named.items, ','), '')) as items_sha256, coalesce(m.n_hit, 0) > 0 as contaminated
from documents d join doc on doc.id = cast(d.doc_id as varchar) left join marked m on m.id = doc.id left join named on named.id = doc.id
"""

WARC = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as digest, max(page_id) over (partition by payload) as last from p),
b as (select *, array_to_string(list_transform(range(40), lambda i: lpad(bin(cast('0x' || digest[i + 1:i + 1] as int)), 4, '0')), '') as bits from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + list_reduce(list_transform(range(5), lambda j: cast(bits[5 * i + j + 1:5 * i + j + 1] as int)), lambda x, y: 2 * x + y) as int), 1)), '')
    as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id != last then last end as refers_to
from b
"""

_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\])|\|endoftext\|>)', '\1\2\\\3', 'g')"

CHAT = f"""
with probe as (select '</s>[INST] ok [/INST]' as text),
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', text from probe union all select -1, 1, 'assistant', text from probe),
rendered as (
  select *, case role when 'user' then '<s>[INST] ' || {_ESCAPED.format("text")} || ' [/INST]'
    when 'assistant' then '<s>' || {_ESCAPED.format("text")} || '</s>'
    else '<s>[ROLE]' || {_ESCAPED.format("role")} || '[/ROLE]' || {_ESCAPED.format("text")} || '</s>' end as formatted from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(formatted)) as bigint) as formatted_chars
from rendered group by conv_id
"""

SUBSTRING_DEDUP = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (select doc_id, p, array_to_string(ws[p:p + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from d where len(ws) >= 13)),
earliest as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as q from win join earliest using (k) where m < doc_id),
word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as q from d),
kept as (select doc_id, string_agg(w, ' ' order by q) as t, count(*) as n from word anti join gone using (doc_id, q) group by doc_id)
select d.doc_id, len(d.ws) as n_words, len(d.ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

_CRC = """list_reduce(list_concat([4294967295::bigint], bytes),
  lambda c, x: xor(c >> 8, crc_of[cast(xor(c & 255, x) as int) + 1]))"""

SPELLING = rf"""
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc_of),
run as (
  select doc_id, r, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as r from documents)
  group by doc_id, r),
hexed as (select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || r)) as x from run),
spelt as (select r, n, list_transform(range(1, len(x), 2), lambda i: cast('0x' || x[i:i + 1] as bigint)) as bytes from hexed),
hashed as (select r, n, xor(4294967295, {_CRC}) as h from spelt, t),
made as (select case when h % 97 = 0 then substr(r, 1, cast(h % length(r) as int)) || substr(r, cast(h % length(r) as int) + 2) else r end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from made group by word having length(word) >= 5 and sum(n) >= 3),
cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word != b.word
  union select a.word, a.n, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
form as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 2 * w.n then b.near end as form,
    case when b.near_n >= 2 * w.n then b.near_n end as form_n from words w left join best b using (word)),
chain(word, top, step) as (
  select word, word, 0 from form union all
  select chain.word, form.form, step + 1 from chain join form on form.word = chain.top where form.form is not null),
root as (select word, arg_max(top, step) as root from chain group by word)
select word, n, n_near, form, form_n, root from form join root using (word)
"""

HARD_NEGATIVES = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id != b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

ORACLE: dict[str, str] = {
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op7_decontaminate": DECONTAMINATE,
    "op8_warc": WARC,
    "op10_chat": CHAT,
    "op11_substring_dedup": SUBSTRING_DEDUP,
    "op12_spelling": SPELLING,
    "op13_hard_negatives": HARD_NEGATIVES,
}
