"""DuckDB SQL for the queries that SQL can express, built from the same tables of rules as the operators."""

from __future__ import annotations

import math

from marquetry.llm import licenses, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def quality_sql() -> str:
    stop = _list(quality._stop_list())
    passes = [f"(n_words < {r.min_words} or coalesce({r.numerator}::double / nullif({r.denominator}, 0) between {r.low} and {r.high}, true))" for r in quality.RULES]
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
starts as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) as i from w),
windows as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + 4], ' ')) as times from starts),
repeated as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as covers from windows where times > 1),
sums as (select doc_id, sum(covers)::bigint as n_repeat_words from repeated group by doc_id),
m as (
  select w.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '!')) as n_marks,
    len(list_filter(words, lambda x: list_contains({stop}, x))) as n_stop_words, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) as n_bullet_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join sums on w.doc_id = sums.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(passes)} as kept from b"""


def topk_sql() -> str:
    return """
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.r as other, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.v) = len(c.v))
select query_id, row_number() over (partition by r order by score desc, vec_id, other)::int as rank, vec_id, score from s
qualify row_number() over (partition by r order by score desc, vec_id, other) <= 5"""


def jaccard_sql() -> str:
    return r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
grams as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as gram from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 9 * shared.n >= 4 * (x.n + y.n)),
paired as (select a, b from links union all select b, a from links),
reach(doc, other) as (select a, b from paired union select reach.doc, paired.b from reach join paired on reach.other = paired.a),
least as (select doc, min(other) as other from reach group by doc),
counts as (select a, count(*) as n from paired group by a)
select w.doc_id, least(w.doc_id, coalesce(least.other, w.doc_id)) as class_id, coalesce(counts.n, 0) as n_links
from w left join least on least.doc = w.doc_id left join counts on counts.a = w.doc_id"""


def url_sql() -> str:
    """Host rules by the order that the longest wins in; patterns written out anew, longest first, as the rules' meaning says."""
    edge = "([^0-9A-Za-z_.%-]|$)"
    patterns = [f"regexp_matches(address, '[^0-9A-Za-z_.%-]malware{edge}')", "contains(address, 'cheap-pills.')", "contains(address, 'spam-farm.')", "regexp_matches(address, '(?s)/ads/.*[.]html')", f"regexp_matches(address, 'casino{edge}')"]
    hosts = [("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("block", "com", "/en/"), ("block", "org", "/es/"), ("allow", "net", "/de/")]
    fits = [(v, h + p, f"((host = {_text(h)} or ends_with(host, {_text('.' + h)})) and starts_with(path, {_text(p)}))") for v, h, p in hosts]
    rule = " ".join(f"when {cond} then {_text(text)}" for _, text, cond in fits)
    verdict = " ".join(f"when {cond} then {_text(v)}" for v, _, cond in fits)
    return f"""
with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
a as (select page_id, regexp_extract(rest, '^[^?#]*') as whole from u),
h as (select page_id, translate(regexp_extract(whole, '^[^/]*'), '{_UPPER}', '{_LOWER}') as host, substr(whole, length(regexp_extract(whole, '^[^/]*')) + 1) as path from a),
j as (select *, host || path as address from h)
select page_id, host, path, case {rule} else null end as rule, case {verdict} when {" or ".join(patterns)} then 'block' else 'allow' end as verdict from j"""


def license_sql() -> str:
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    spots = []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        here = " and ".join(f"words[i + {k}] = {_text(p)}" for k, p in enumerate(parts))
        spots.append(f"select doc_id, i - 1 as place, {_text(label)} as label from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w where list_contains(words, {_text(parts[0])})) where {here}")
    templates = []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        t = sorted(set(text.split()))
        need = max(1, math.ceil(licenses.THRESHOLD * len(t) - 1e-9))
        span = math.ceil(len(text.split()) / licenses.THRESHOLD - 1e-9)
        templates.append(f"({k}, {_text(label)}, {_list(t)}, {len(t)}, {need}, {span})")
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '{gap}') as words from d),
spots as ({" union all ".join(spots)}),
base as (select doc_id, count(*) as n_base, min(place)::bigint as first_word, max(place)::bigint as last_word from spots group by doc_id),
blocks as (select doc_id, list_distinct(regexp_extract_all(line, '{gap}')) as b from (select doc_id, unnest(string_split(t, chr(10))) as line from d)),
templates(k, label, words, size, need, span) as (values {", ".join(templates)}),
able as (select w.doc_id, w.words, k from w join d using (doc_id) cross join templates where contains(t, chr(10)) and len(list_intersect(w.words, templates.words)) >= need),
places as (select doc_id, words, k, unnest(range(1, len(words) + 1)) as i from able),
stretches as (select doc_id, label, size, need, len(list_intersect(list_distinct(p.words[i:i + span - 1]), templates.words)) as n from places p join templates using (k)),
met as (
  select doc_id, label, len(list_intersect(b, templates.words)) / size::double as share from blocks cross join templates where len(b) >= need and len(list_intersect(b, templates.words)) >= need
  union all select doc_id, label, n / size::double from stretches where n >= need),
labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from spots union select doc_id, label from met) group by doc_id),
base_labels as (select doc_id, string_agg(distinct label, ',' order by label) as base_labels from spots group by doc_id),
shares as (select doc_id, max(share) as share from met group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  greatest(case when n_base > 0 then 1.0::double else 0.0::double end, coalesce(share, 0.0::double)) as score
from w left join base using (doc_id) left join labels using (doc_id) left join base_labels using (doc_id) left join shares using (doc_id)"""


def repeats_sql() -> str:
    return """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (select doc_id, i, substr(h, (2 * i + 1)::bigint, 100) as s from (select doc_id, h, unnest(range(greatest(n - 49, 0))) as i from d)),
hits as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from windows) where doc_id > least),
marked as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hits),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as run from marked),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from runs group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cut as (select d.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' order by a) as head, max(b) as tail from d join gaps using (doc_id) group by d.doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when tail is null then h else head || substr(h, (2 * tail + 1)::bigint) end)) as kept_sha256
from d left join cut using (doc_id)"""


_CRC = """
with recursive bits(v, k, c) as (select range, 0, range from range(256) union all select v, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8),
crc_table as (select list(c order by v) as t from bits where k = 8)"""


def sharding_sql() -> str:
    # The order is by key, then checksum; keys of documents are unique.
    return (
        _CRC
        + """,
d as (select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
bytes as (select doc_id, list_transform(range(1, (size)::bigint), lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::bigint) as b, size from d),
summed as (select doc_id, size, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) as text_crc32 from bytes cross join crc_table),
placed as (select *, coalesce(sum(size) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from summed),
dealt as (select *, least(15, (16 * (2 * before + size)) // (2 * total))::int as shard from placed)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard from dealt"""
    )


def spelling_sql() -> str:
    # Near words share what is left when one character of each, or of the longer one, is left out.
    return (
        _CRC
        + f""",
runs as (select doc_id, translate(run, '{_UPPER}', '{_LOWER}') as run from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents) where length(run) >= 5),
counted as (select doc_id, run, count(*) as times, doc_id || ':' || run as mark from runs group by doc_id, run),
bytes as (select *, list_transform(range(1, octet_length(encode(mark)) + 1), lambda i: ('0x' || substr(hex(encode(mark)), 2 * i - 1, 2))::bigint) as b from counted),
hashed as (select run, times, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) as h from bytes cross join crc_table),
words as (
  select word, sum(times)::bigint as n
  from (select times, case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) else run end as word from hashed)
  where length(word) >= 5 group by word having sum(times) >= 3),
left_out as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word as a, b.word as b from left_out a join left_out b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, w.word from left_out a join words w on a.rest = w.word
  union select w.word, a.word from left_out a join words w on a.rest = w.word),
near as (select a, b, n as near_n, count(*) over (partition by a) as n_near, row_number() over (partition by a order by n desc, b) as turn from pairs join words on word = b),
forms as (select word, n, case when near_n >= 2 * n then b end as form, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near_n end as form_n from words left join near on a = word and turn = 1),
chain(word, here, step) as (select word, word, 0 from forms union all select chain.word, form, step + 1 from chain join forms on forms.word = here where form is not null),
roots as (select word, arg_max(here, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""
    )


def infill_sql() -> str:
    part = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
c as (
  select doc_id, t, n, least({part(0)} % (n + 1), {part(1)} % (n + 1)) as a, greatest({part(0)} % (n + 1), {part(1)} % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {part(2)} % 100 >= 90 then 'plain' when {part(3)} % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) as output_sha256,
  sha256(t) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_sql(),
        "op3_exact_topk": topk_sql(),
        "op4_jaccard_join": jaccard_sql(),
        "op7_url_filters": url_sql(),
        "op8_license_scans": license_sql(),
        "op9_suffix_dedup": repeats_sql(),
        "op10_sharding": sharding_sql(),
        "op12_spelling_groups": spelling_sql(),
        "op13_fill_in_middle": infill_sql(),
    }
