"""DuckDB twins of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select coalesce(cast(item_id as varchar), '') as item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
places as (
  select r, m, i, array_to_string(w[i : i + m - 1], ' ') as k
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i
        from d, (select distinct m from windows) where len(w) >= m)),
hits as (select r, item_id, places.m, i from places join windows using (m, k)),
marked as (select r, count(distinct i + s) as n_hit from (select r, i, unnest(range(0, m)) as s from hits) group by r),
items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from hits) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join marked using (r) left join items using (r)
"""

CHAT = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
numbered as (
  select *, lag(role) over w as before from turns
  window w as (partition by conv_id order by turn nulls first, role, text)),
escaped as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
         length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as text_chars,
         length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) as role_chars
  from numbered)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
       sum(text_chars + case when before is null or before <> role
                             then {len("<|im_start|>")} + role_chars + 1 + {len("<|im_end|>") + 1}
                             else {len("<|turn|>")} end)::bigint as formatted_chars
from escaped group by conv_id
"""

NEAR_DUP = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as node, doc_id as seen from d
  union
  select node, b from reach join ways on seen = a)
select d.doc_id, coalesce(n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join sizes using (doc_id) join (select node, min(seen) as component_id from reach group by node) m on m.node = d.doc_id
"""

LEXICAL_SEARCH = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t
  from benchmark),
size as (select count(*) filter (len(w) > 0) as n, sum(len(w))::bigint as l from d),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by r, t),
weight as (
  select t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::bigint as w
  from tf, size where t in (select t from q) group by t),
scored as (
  select item_id, doc_id, r, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n) // l))))::bigint as score
  from q join tf using (t) join weight using (t) join d using (r), size group by item_id, doc_id, r),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""

SPELLING = rf"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
           case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
runs as (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
  where length(run) >= 7 group by all),
bytes as (select run, k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs),
sums as (
  select run, k, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
           lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1]))) as h
  from bytes, crc_table),
words as (
  select word, sum(k)::bigint as n from (
    select k, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from sums)
  where length(word) >= 7 group by word having sum(k) >= 2),
cuts as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select x.word, x.n, y.word as other, y.n as other_n from cuts x join cuts y using (rest, i) where x.word <> y.word
  union
  select w.word, w.n, c.word, c.n from words w join cuts c on c.rest = w.word
  union
  select c.word, c.n, w.word, w.n from words w join cuts c on c.rest = w.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n
  from words left join best using (word)),
walk as (
  select word, word as place, 0 as steps from forms
  union all
  select walk.word, form, steps + 1 from walk join forms on forms.word = walk.place where form is not null),
ends as (select word, arg_max(place, steps) as root from walk group by word)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""


def _permuted(source: str, x: str, n: str, key: str, inverse: bool = False) -> str:
    """A query over `source` with `place`, the permutation of x; the arithmetic of mixing.permuted."""
    from . import mixing

    out = f"(select *, ({x})::bigint as place from {source})"
    for a, b, c, d in mixing.KEYS[::-1] if inverse else mixing.KEYS:
        p = mixing.PRIME
        out = f"(select *, ((({key} + 1) * {a}) % {p} * {p} + (({key} + 1) * {b}) % {p}) % {n} as shift from {out})"
        out = f"(select *, (shift - place + {n}) % {n} as other from {out})"
        out = f"(select *, (greatest(place, other) % {p} * {c} + ({key} + 1) * {d}) % {p} as z from {out})"
        out = f"(select * exclude (place, shift, other, z), case when z * z % {p} >= {p} * 0.5 then other else place end as place from {out})"
    return out


def mixing_sql() -> str:
    from . import mixing as m

    return rf"""
with sizes as (
  select row_number() over () as r, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as rank,
         ([{", ".join(map(str, m.WEIGHTS))}])[(row_number() over (order by source is null, source) - 1) % {len(m.WEIGHTS)} + 1] as weight
  from sizes group by source),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * {m.REPEATS}) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as level
  from ranked),
targets as (
  select source, rank, source_size, least((source_size * {m.REPEATS})::double, (select max(level) from levels) * weight) as target,
         ceil(source_size / {m.BLOCK_WORDS})::bigint as blocks
  from levels),
counts as (
  select *, case when source_size > 0 then least(floor(target * blocks / source_size + 0.5)::bigint, blocks * {m.REPEATS}) else 0 end as draws
  from targets),
slots as (select rank, blocks, unnest(range(0, draws)) as j from counts),
drawn as (
  select rank, place as block, count(*) as draws
  from {_permuted("slots", "j % blocks", "blocks", "rank")} group by all),
placed as (
  select *, sum(size) over (partition by source order by coalesce(doc_id, 0) % chunks, doc_id nulls first, text
                            rows between unbounded preceding and current row)::bigint - size as start
  from sizes, (select greatest({m.CHUNKS}, count(*) // {m.CHUNK_ROWS}) as chunks from sizes)),
pieces as (
  select r, rank, size, start, unnest(range(start // {m.BLOCK_WORDS}, (start + size - 1) // {m.BLOCK_WORDS} + 1)) as block
  from placed join counts on placed.source is not distinct from counts.source where size > 0),
taken as (
  select r, sum((least(size, (block + 1) * {m.BLOCK_WORDS} - start) - greatest(0, block * {m.BLOCK_WORDS} - start)) * draws)::bigint as taken
  from pieces join drawn using (rank, block) group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from placed join counts on placed.source is not distinct from counts.source left join taken using (r)
"""
