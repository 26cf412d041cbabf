"""DuckDB's SQL for queries of this subpackage, by plain joins over words."""

#: The table of crc32 as a list: each byte's remainder, bit by bit.
_CRC = r"""with recursive crc as (select list(c order by b) as t from (select b, list_reduce([b::bigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(b))),"""

#: Periods by all pairs of equal words of a document.
OP11 = _CRC + r"""
hashed as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, xor(list_reduce(list_transform(range(length(doc_id::varchar)), lambda k: ascii(substr(doc_id::varchar, k + 1, 1))::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as h from documents, crc),
d as (select *, len(w) as n, if(h % 10 = 0 and len(w) > 0, (h // 10) % len(w), len(w)) as a, 3 + (h // 10) % 8 as parts from hashed),
e as (select *, 1 + (n - a) // parts as p from d),
words as (select doc_id, i, w[1 + if(i < a, i, a + (i - a) % p)] as word from (select *, unnest(range(n)) as i from e)),
same as (select x.doc_id, x.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.word = y.word and x.i < y.i),
islands as (select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as k from same) group by doc_id, q, k),
runs as (select doc_id, s, l, min(q) as q from islands where l >= greatest(12, 2 * q) group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by doc_id),
best as (select doc_id, count(*) as n_runs, min_by({'s': s, 'l': l, 'q': q}, {'less': -l, 's': s, 'q': q}) as b, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines from runs group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.q as period, 1000 * b.l // b.q as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from e left join kept using (doc_id) left join best using (doc_id)
"""

OP12 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
firsts as (select s, min(doc_id) as low from windows group by s),
gone as (select distinct doc_id, i + j as i from windows join firsts using (s) cross join (select unnest(range(13)) as j) where low < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)
"""

#: Words one edit apart by the places where a letter is left out.
OP13 = _CRC + r"""
found as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from documents),
each as (select doc_id, word, count(*) as n from found group by all),
bytes as (select doc_id, word, n, list_transform(range(0, octet_length(s) ), lambda k: ('0x' || substr(hex(s), 2 * k + 1, 2))::bigint) as b from (select *, encode(coalesce(doc_id::varchar, '') || ':' || word) as s from each)),
hashed as (select doc_id, word, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as h from bytes, crc),
planted as (select case when h % 97 = 0 then left(word, (h % length(word))::int) || substr(word, (h % length(word))::int + 2) else word end as word, n from hashed),
vocab as (select word, sum(n)::bigint as n from planted where length(word) >= 5 group by word having sum(n) >= 3),
holes as (select word, n, unnest(range(length(word))) as i from vocab),
cut as (select word, n, i, left(word, i) as a, substr(word, i + 2) as z from holes),
longer as (select c.word as u, c.n as un, v.word as v, v.n as vn from cut c join vocab v on v.word = a || z),
pairs as (select x.word as u, y.word as v, y.n as vn from cut x join cut y using (i, a, z) where x.word <> y.word union select u, v, vn from longer union select v, u, un from longer),
best as (select u, count(*) as n_near, min_by({'v': v, 'n': vn}, {'less': -vn, 'v': v}) as b from pairs group by u),
forms as (select word, n, coalesce(n_near, 0) as n_near, case when b.n >= 2 * n then b.v end as form, case when b.n >= 2 * n then b.n end as form_n from vocab left join best on u = word),
roots as (select word, word as up, 0 as steps from forms union all select r.word, f.form, steps + 1 from roots r join forms f on f.word = r.up where f.form is not null)
select word, form, root, n, n_near, form_n from forms join (select word, max_by(up, steps) as root from roots group by word) using (word)
"""
