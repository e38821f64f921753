"""SQL twins of the corpus queries, for those that SQL can express."""
from __future__ import annotations

_WORDS = "[^\\x20\\x09-\\x0D]+"

_MIX = f"""
with d as (
  select cast(doc_id as bigint) doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as bigint) size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) lot
  from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end w from s),
o as (
  select *, coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) c,
    coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) v, sum(w) over () all_w, sum(source_size) over () all_size
  from w window o as (order by source_size * (10 // w), source nulls last)),
f as (select *, (3 * all_size - 4 * c) * w >= 4 * source_size * (all_w - v) as filled from o),
t as (
  select source, source_size, case when filled then cast(2 * source_size as double) else
    cast((3 * all_size - 4 * coalesce(sum(source_size) filter (where filled) over (), 0)) * w as double)
      / (2.0::double * cast(all_w - coalesce(sum(w) filter (where filled) over (), 0) as double)) end target
  from f),
b as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end times from t),
r as (
  select d.doc_id, d.size, b.source_size, b.target, b.times, b.target - b.times * b.source_size budget,
    cast(sum(d.size) over (partition by d.source order by d.lot range between unbounded preceding and current row) as double) run,
    cast(sum(d.size) over (partition by d.source, d.lot) as double) here
  from d join b on d.source is not distinct from b.source),
x as (select *, run <= budget or (run - here <= budget and run - budget < budget - (run - here)) extra from r)
select doc_id, size, source_size, target, cast(size * (times + case when extra then 1 else 0 end) as bigint) taken from x
"""

_TOP = """
with v as (
  select vec_id, list_transform(min(e), lambda x: cast(floor(256 * x) as bigint)) q
  from (select cast(vec_id as bigint) vec_id, cast(embedding as double[]) e from embeddings) where vec_id is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
s as (
  select a.vec_id query_id, b.vec_id, cast(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) as bigint) score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLE: dict[str, str] = {"op6_hash_threshold_mix": _MIX, "op8_branch_and_bound": _TOP}

_WARC = """
with p as (select cast(page_id as bigint) page_id, coalesce(html, '') h from pages),
d as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) x from p),
b as (
  select *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', x[i]) - 1), 4)), '') bits from d),
c as (
  select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast(list_sum(list_transform(range(1, 6), lambda j: cast(substr(bits, i * 5 + j, 1) as integer) * cast(2 ** (5 - j) as integer))) as integer), 1)), '') payload_digest
  from b),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) last from c)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end record_type,
  case when page_id <> last then last end refers_to, cast(case when page_id = last then greatest(1, ceil(payload_bytes / 65536.0)) else 0 end as bigint) chunks from m
"""
ORACLE["op2_chunked_warc"] = _WARC

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH = f"""
with d as (
  select cast(doc_id as bigint) doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') t,
    row_number() over () r from documents),
q as (
  select distinct cast(item_id as bigint) item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) term
  from benchmark where item_id is not null),
g as (select cast(count(*) as bigint) nd, cast(sum(len(t)) as bigint) l from d where len(t) > 0),
p as (
  select r, doc_id, cast(len(t) as bigint) n, unnest(t) term from d),
f as (select r, doc_id, n, term, cast(count(*) as bigint) tf from p where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from f, g group by term),
s as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) as bigint) score
  from q join f using (term) join w using (term), g group by item_id, r, doc_id),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) rank, doc_id, score from s where score > 0)
select * from k where rank <= 50
"""
ORACLE["op13_shared_term_search"] = _SEARCH
