"""SQL for DuckDB that gives the rows of the queries which SQL can express, from their definitions.

Hashes are unsigned 64-bit integers; products are formed in 128 bits and cut.
`_mixed` is the finalizer behind all of them. Words are hashed once each.
"""

from __future__ import annotations

_TWO_64 = "18446744073709551616::uhugeint"
_GOLDEN = 0x9E3779B97F4A7C15
_WORD_BASE, _SHINGLE_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def _wrapped(x: str) -> str:
    return f"(({x}) % {_TWO_64})::ubigint"


def _times(x: str, factor: int) -> str:
    return _wrapped(f"({x})::uhugeint * {factor}::uhugeint")


def _folded(x: str, bits: int) -> str:
    return f"xor({x}, ({x}) >> {bits})"


def _mixed(x: str) -> str:
    return _folded(_times(_folded(_times(_folded(x, 30), 0xBF58476D1CE4E5B9), 27), 0x94D049BB133111EB), 31)


def _hashed(source: str, pattern: str) -> str:
    """CTEs: spoken (id, place, word), the words of source (id, text) in order; hashed (word, h)."""
    return f"""
values_of as (select list({_mixed("x")} order by b) as v from (select b, {_times("b + 1", _GOLDEN)} as x from range(256) r(b))),
spoken as (
  select id, unnest(words) as word, unnest(range(len(words))) as place
  from (select id, regexp_extract_all(text, '{pattern}') as words from {source})),
sums as (
  select word, octet_length(encode(word)) as n,
    list_reduce(
      list_reverse(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda b: ('0x' || b)::ubigint)),
      lambda s, b: {_wrapped(f"s::uhugeint * {_WORD_BASE}::uhugeint + list_extract(v, b::bigint + 1)::uhugeint")}, 0::ubigint) as s
  from (select distinct word from spoken), values_of),
hashed as (select word, {_mixed("x")} as h from (select word, {_wrapped("s::uhugeint + n::uhugeint")} as x from sums))"""


WEIGHTED_MINHASH = f"""
with recursive texts as (select min(doc_id) as first_id, count(*) as copies, text, row_number() over () as id from documents where text is not null group by text),
{_hashed("(select id, lower(text) as text from texts)", "[0-9a-z\\x{80}-\\x{10FFFF}]+")},
runs as (
  select id, place, list(h) over w as hs, count(*) over (partition by id) as n
  from spoken join hashed using (word) window w as (partition by id order by place rows between current row and 4 following)),
shingles as (
  select id, {_mixed("x")} as shingle
  from (select id, list_reduce(list_reverse(hs), lambda s, h: {_wrapped(f"s::uhugeint * {_SHINGLE_BASE}::uhugeint + h::uhugeint")}) as x from runs where len(hs) = least(n, 5))),
counted as (select id, shingle, (shingle & 262143) as slot, count(*) as tf from shingles group by id, shingle),
frequencies as (
  select slot, ln((1 + (select sum(copies) from texts where id in (select id from counted))) / (1 + sum(copies))) + 1 as idf
  from (select distinct id, slot from counted) join texts using (id) group by slot),
weights as (select id, shingle, tf * idf as w from counted join frequencies using (slot)),
totals as (select id, sum(w) as whole from weights group by id),
common as (select a.id as a, b.id as b, sum(least(a.w, b.w)) as shared from weights a join weights b on a.shingle = b.shingle and a.id < b.id group by a.id, b.id),
links as (select a, b from common join totals x on x.id = a join totals y on y.id = b where shared / (x.whole + y.whole - shared) >= 0.8),
reached as (
  select id, id as other from texts
  union
  select id, case when a = other then b else a end from reached join links on other in (a, b)),
grouped as (select r.id, min(t.first_id) as class_id, sum(t.copies)::bigint as class_size from reached r join texts t on t.id = r.other group by r.id)
select doc_id, class_id, class_size from documents join texts using (text) join grouped using (id)
union all
select doc_id, doc_id, 1 from documents where text is null"""


IMPORTANCE_RESAMPLING = f"""
with rows as (select doc_id, coalesce(text, '') as text, row_number() over () as id from documents),
{_hashed("rows", "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]+")},
placed as (select id, h, lead(h) over (partition by id order by place) as next from spoken join hashed using (word)),
grams as (
  select id, h as gram from placed
  union all
  select id, case when h = next then 1::ubigint else {_mixed("x")} end
  from (select id, h, next, {_wrapped(f"h::uhugeint * {_GOLDEN}::uhugeint + next::uhugeint")} as x from placed where next is not null)),
marked as (select * from labels where doc_id is not null and quality is not null),
target as (select distinct doc_id from marked where quality = 1 and coalesce(toxic, 0) = 0),
held as (select id, (gram & 16383)::ubigint as bucket, count(*) as tf from grams group by 1, 2),
counts as (
  select bucket, sum(tf) as raw, coalesce(sum(tf) filter (where doc_id in (select doc_id from target)), 0) as good
  from held join rows using (id) group by bucket),
ratios as (select bucket, round(ln((good + 8) / (raw * ((select sum(good) from counts) / (select sum(raw) from counts)) + 8)), 6) as ratio, {_mixed("(bucket + 1)")} as code from counts),
summed as (
  select id, sum(tf * ratio) as weight, {_wrapped("sum(tf::hugeint * code::hugeint)::uhugeint")} as code
  from held join ratios using (bucket) group by id),
drawn as (
  select id, doc_id, round(coalesce(weight, 0), 6) as log_weight, {_wrapped("coalesce(code, 0)::uhugeint + 11::uhugeint")} as x
  from rows left join summed using (id)),
keyed as (
  select doc_id, log_weight, log_weight + round(-ln(-ln((({_mixed("x")} >> 11)::double + 0.5) * pow(2, -53))), 9) as sampling_key from drawn),
size as (select round((select count(*) from documents) * (select count(*) from marked where quality = 1) / (select count(*) from marked)) as k)
select doc_id, log_weight, sampling_key, rank() over (order by sampling_key desc) <= k as keep from keyed, size"""


FEISTEL_SHARDS = f"""
with recursive bits as (
  select b::ubigint as c, b, 0 as k from range(256) r(b)
  union all
  select case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, b, k + 1 from bits where k < 8),
checks as (select list(c order by b) as t from bits where k = 8),
sized as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size,
    xor(
      list_reduce(
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::ubigint),
        lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255)::bigint + 1)), 4294967295::ubigint),
      4294967295::ubigint)::bigint as text_crc32
  from documents, checks),
numbered as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as number from sized),
shape as (select n, bits // 2 as low, bits - bits // 2 as high from (select n, greatest(2, length(ltrim(bin(greatest(n, 1) - 1), '0'))) as bits from (select count(*) as n from documents))),
keys as (select list({_mixed("x")} order by i) as keys from (select i, {_wrapped(f"i::uhugeint * {_GOLDEN}::uhugeint + 20::uhugeint")} as x from range(1, 7) r(i))),
rounds as (
  select number, 0 as k, number::ubigint >> low as l, number::ubigint & ((1::ubigint << low) - 1)::ubigint as r, number::ubigint as out from numbered, shape
  union all
  select number, k + 1, l, r, (l << low) | r
  from (
    select number, k, low,
      case when k % 2 = 0 then xor(l, m & ((1::ubigint << high) - 1)::ubigint) else l end as l,
      case when k % 2 = 1 then xor(r, m & ((1::ubigint << low) - 1)::ubigint) else r end as r
    from (
      select *, {_mixed("x")} as m
      from (select *, xor(case when k % 2 = 0 then r else l end, list_extract(keys, k % 6 + 1)) as x from rounds, shape, keys where k = 0 or k % 6 > 0 or out >= n)))),
positions as (select number, out::bigint as position from rounds, shape where k > 0 and k % 6 = 0 and out < n)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (position % 40)::integer as shard, position // 40 as slot, null::integer as grown_shard
from numbered join positions using (number)"""


#: The graphs find all rows only in tables as small as that of sf0.01; recall elsewhere is tested in tests/llm.
SMALL_WORLD_NEIGHBOURS = """
with e as (
  select *, row_number() over () as rid
  from (
    select distinct vec_id, embedding as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)),
n as (
  select a.rid, a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.v::double[], b.v::double[]) as score
  from e a join e b on a.rid <> b.rid and len(a.v) = len(b.v) where a.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from n) where rank <= 20"""


def _crc32(name: str, source: str) -> str:
    """CTEs: name (text, crc), the unsigned crc32 of the UTF-8 bytes of each text of source (text)."""
    return f"""
{name}_bits as (
  select b::ubigint as c, b, 0 as k from range(256) r(b)
  union all
  select case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, b, k + 1 from {name}_bits where k < 8),
{name}_table as (select list(c order by b) as t from {name}_bits where k = 8),
{name} as (
  select text,
    xor(
      list_reduce(
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::ubigint),
        lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255)::bigint + 1)), 4294967295::ubigint),
      4294967295::ubigint) as crc
  from {source}, {name}_table)"""


TARGET_RESAMPLING = f"""
with recursive texts as (
  select 0 as target, row_number() over () as id, doc_id, text from documents
  union all
  select 1, row_number() over (), null, text from benchmark),
worded as (
  select target, id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from texts),
featured as (
  select target, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as text from worded),
{_crc32("checked", "(select distinct text from featured)")},
placed as (select target, id, (crc % 10000)::bigint as bucket from featured join checked using (text)),
counted as (select bucket, count(*) filter (where target = 0) as s, count(*) filter (where target = 1) as t from placed group by bucket),
gained as (
  select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain
  from counted, (select sum(s) as s_all, sum(t) as t_all from counted)),
weighed as (
  select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from placed join gained using (bucket) where target = 0 group by id),
drawn as (select id, doc_id, len(words) as n_words, ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from worded where target = 0),
scored as (
  select id, doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score
  from drawn left join weighed using (id)),
ranked as (
  select id, row_number() over (order by score desc, doc_id nulls last, n_features) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank
from scored left join ranked using (id)"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _assigned(book: str) -> str:
    return f"""
  select rid, d, p, x, min(struct_pack(far := coalesce(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0), entry := entry)) as found
  from parts join {book} using (d, p) group by rid, d, p, x"""


def _improved(book: str, nearest: str) -> str:
    return f"""
  select d, p, entry, coalesce(list_transform(sums, lambda s: floor(s::double / n)::bigint), c) as c
  from {book} left join (
    select d, p, entry, list(total order by place) as sums, any_value(n) as n
    from (
      select d, p, found.entry as entry, place, sum(x[place]) as total, count(*) as n
      from {nearest}, range(1, 4096) r(place) where place <= len(x) group by all)
    group by d, p, entry) using (d, p, entry)"""


FILTERING_LLOYD_CODES = f"""
with kept as (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v, len(embedding) as d
  from embeddings where {_FINITE}),
parts as (select rid, vec_id, v, d, p, v[p * d // 16 + 1 : (p + 1) * d // 16] as x from kept, range(16) r(p)),
book_0 as (
  select d, p, x as c, entry from parts join (select rid, row_number() over (partition by d order by vec_id nulls last, v) - 1 as entry from kept) using (rid) where entry < 64),
near_0 as ({_assigned("book_0")}),
book_1 as ({_improved("book_0", "near_0")}),
near_1 as ({_assigned("book_1")}),
book_2 as ({_improved("book_1", "near_1")}),
near_2 as ({_assigned("book_2")}),
digests as (select d, sha256(coalesce(string_agg(array_to_string(c, ','), ',' order by p, entry) filter (where len(c) > 0), '')) as codebooks_sha256 from book_2 group by d),
coded as (
  select rid, string_agg(printf('%02x', found.entry), '' order by p) as code, sum(found.far)::bigint as error from near_2 group by rid)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from kept join coded using (rid) join digests using (d)"""

HISTOGRAM_TOP_K = f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where {_FINITE}),
scored as (
  select a.rid, a.vec_id as query_id, b.vec_id, coalesce(list_inner_product(a.v, b.v), 0)::bigint as score
  from kept a join kept b on a.rid <> b.rid and len(a.v) = len(b.v) where a.vec_id % 100 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as rank from scored) where rank <= 10"""
