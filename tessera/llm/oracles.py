"""SQL for operators whose statements are longer than a line or two."""

from __future__ import annotations

#: crc32 as SQL: its table of 256 numbers, made by the rule of its polynomial, and a fold over a list of bytes.
_CRC_TABLE = "crc as (select list(v order by k) as t from (select range as k, list_reduce([range::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: if(c & 1 = 1, xor(c >> 1, 3988292384::ubigint), c >> 1)) as v from range(256)))"


def _crc(byte_list: str) -> str:
    return f"xor(list_reduce([4294967295::ubigint] || {byte_list}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)"


PERIODIC_RUNS = f"""with {_CRC_TABLE},
split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, {_crc("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)")} as h from documents, crc),
sized as (select *, len(w)::bigint as n, h // 10 as g from split),
changed as (select doc_id, n, case when h % 10 > 0 or n = 0 then w else list_transform(range(n), lambda i: if(i < g % n, w[i + 1], w[(g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)))::bigint + 1])) end as w
  from (select doc_id, n, w, h::bigint as h, g::bigint as g from sized)),
words as (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from changed),
pairs as (select a.doc_id, a.i, b.i - a.i as q from words a join words b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as s, count(*) + q as l from islands group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select * from stretches x where not exists (select 1 from stretches y where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.l >= x.s + x.l)),
listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as text from runs group by doc_id),
longest as (select * from runs qualify row_number() over (partition by doc_id order by l desc, s, q) = 1),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from words x where not exists (select 1 from runs r where r.doc_id = x.doc_id and x.i >= r.s + r.q and x.i < r.s + r.l) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint as exponent_milli,
  sha256(coalesce(listed.text, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from documents d left join listed using (doc_id) left join longest using (doc_id) left join kept using (doc_id)"""


PASSAGES = """with texts as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
strings as (select doc_id, i, md5(array_slice(b, i, i + 399)) as h from (select doc_id, b, unnest(range(1, n - 398)) as i from texts where n >= 400)),
repeated as (select doc_id, i from strings where h in (select h from strings group by h having count(*) > 1)),
cut as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as starts from repeated),
counted as (select *, sum(starts) over (partition by doc_id order by i) as k from cut),
spans as (select doc_id, k, min(i) as s, max(i) + 399 as e from counted group by doc_id, k),
gaps as (select doc_id, k, coalesce(lag(e) over (partition by doc_id order by k), 0) + 1 as a, s - 1 as z from spans union all select doc_id, max(k) + 1, max(e) + 1, null from spans group by doc_id),
kept as (select doc_id, string_agg(hex(array_slice(b, a, coalesce(z, n))), '' order by k) as hex from gaps join texts using (doc_id) where coalesce(z, n) >= a group by doc_id),
removed as (select doc_id, sum(e - s + 1) as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(case when n_spans is null then b else unhex(coalesce(hex, '')) end) as kept_sha256
from texts left join removed using (doc_id) left join kept using (doc_id)"""


def _words(table: str) -> str:
    return f"select {'doc_id' if table == 'documents' else 'item_id'} as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"


RESAMPLING = f"""with {_CRC_TABLE}, mine as ({_words("documents")}), theirs as ({_words("benchmark")}),
features as (select id, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from (select id, 0 as k, w from mine union all select id, 1, w from theirs)),
hexes as (select f, hex(encode(f)) as x from (select distinct f from features)),
buckets as (select f, ({_crc("list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::ubigint)")} % 10000)::bigint as bucket from hexes, crc),
counts as (select bucket, count(*) filter (where k = 0) as s, count(*) filter (where k = 1) as t from features join buckets using (f) group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
weights as (select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from features join buckets using (f) join gains using (bucket) where k = 0 group by id),
scored as (select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::ubigint::double + 0.5) / 4294967296))))::bigint as score from mine left join weights using (id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 25 * n // 100 then r end as rank from scored left join ranked using (doc_id)"""
