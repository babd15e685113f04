"""DuckDB SQL of the queries that SQL can express."""

OP6 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as h
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight,
         source_size::double * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as total
  from sources),
levels as (
  select *, cap / weight as ratio,
         (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
water as (select arg_min(level, ratio) filter (where level <= ratio) as level from levels),
targets as (
  select source, source_size, least(cap, weight * coalesce(water.level, 'infinity'::double)) as target from levels, water),
needs as (
  select *, floor(target + 0.5)::bigint as need,
         case when source_size > 0 then floor(floor(target + 0.5) / source_size)::bigint else 0 end as whole
  from targets),
cuts as (
  select doc_id, size, source_size, target, whole, need - whole * source_size as rest,
         sum(size) over (partition by s.source order by h, doc_id, size rows between unbounded preceding and current row) - size as pos0
  from sized s join needs n on s.source is not distinct from n.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - pos0)))::bigint as taken
from cuts
"""

_KINDS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
_GROUP = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KEEP = {"assign": f"length(regexp_extract(p, '{_GROUP}', 1)) >= 12", "access": "length(p) >= 18", "hex": "length(p) >= 16"}


def _kind(k: int, name: str, pattern: str) -> str:
    """Pieces between and inside matches in turn; a piece's start is the sum of the lengths before it."""
    return f"""
  select doc_id, {k} as kind, '{name}' as name, pos as start, pos + length(p) as stop from (
    select doc_id, i, p, coalesce(sum(length(p)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos
    from (select doc_id, unnest(parts) as p, generate_subscripts(parts, 1) as i from (
      select doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(57344), chr(57345)), '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) as parts
      from documents)))
  where i % 2 = 0 and {_KEEP[name]}"""


OP5 = (
    "with found as ("
    + " union all ".join(_kind(k, n, p) for k, (n, p) in enumerate(_KINDS)).replace(r"'\\1'", r"'\1'")
    + """),
joined as (
  select doc_id, string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans,
         count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex
  from found group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join joined j on d.doc_id = j.doc_id
"""
)


OP4 = r"""
with keyed as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
last as (select *, max(page_id) over (partition by hex, payload_bytes) as biggest from keyed)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::int >> (15 - i % 4 * 5)::int) & 31) + 1, 1)), '') as payload_digest,
       case when page_id = biggest then 'response' else 'revisit' end as record_type,
       case when page_id = biggest then null else biggest end as refers_to
from last
"""


OP10 = r"""
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y, k = a.n and k = b.n as same from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 5 * k >= 4 * (a.n + b.n - k)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on l.x = r.y),
classes as (select x, min(y) as class_id from reach group by 1),
counts as (select x, count(*) as n_links, min(case when same then y end) as copy from links group by 1)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, least(doc_id, coalesce(copy, doc_id)) as copy_id
from documents join classes c on c.x = doc_id left join counts n on n.x = doc_id
"""


OP11 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
hot as (select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
judged as (select doc_id, i, line, coalesce(doc_id <> last, false) as gone from keyed left join hot using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


OP12 = r"""
with keyed as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, 'null')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w from documents),
drawn as (
  select doc_id, t, w, len(w) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from keyed),
formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
cut as (
  select doc_id, n, form, t, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s from formed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from cut
"""


OP13 = r"""
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank, other as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 10
"""


def oracle_sql():
    return {"op11_line_runs": OP11, "op12_fill_middle": OP12, "op13_hard_negatives": OP13, "op10_jaccard_join": OP10, "op4_warc_chains": OP4, "op5_secret_scan": OP5, "op6_mix_sources": OP6}
