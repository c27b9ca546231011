"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import BOILERPLATE, SEPARATORS, SYMBOLS, Rules

_W = r"[^\x20\x09-\x0D]+"


def _op10(r: Rules = Rules()) -> str:
    bars = ", ".join(f"'{c}'" for c in SEPARATORS)
    symbols = f"length(line) - length(translate(line, '{SYMBOLS}', ''))"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
words as (select rid, doc_id, t, regexp_extract_all(t, '{_W}') as ws from docs),
lines as (
  select rid, u.line, row_number() over (partition by rid, u.line) as nth,
    regexp_extract_all(u.line, '{_W}') as lw
  from (select rid, unnest(string_split(t, chr(10))) as line from docs) u
  where regexp_matches(u.line, '{_W}')),
judged as (
  select rid, line, nth,
    (len(list_filter(lw, lambda w: w in ({bars}))) >= 2 and 100 * len(list_filter(lw, lambda w: w in ({bars}))) >= {r.separators} * len(lw))
    or 100 * ({symbols}) >= {r.symbols} * length(line)
    or (len(regexp_extract_all(line, '[!?][!?]+')) >= 2 and 100 * len(regexp_extract_all(line, '[!?][!?]+')) >= {r.shouts} * len(lw))
    or (len(lw) >= {r.sentence_words} and not regexp_matches(line, '[.!?…:;。！？]'))
    or (len(lw) <= {r.boilerplate_words} and regexp_matches(line, '{BOILERPLATE}')) as fails
  from lines),
by_line as (
  select rid, sum(length(line)) as had, sum(case when fails then 0 else length(line) end) as remains,
    sum(case when nth > 1 then 1 else 0 end) as dups
  from judged group by rid),
places as (select rid, ws, unnest(range(0, len(ws) - 4)) as i from words where len(ws) > 5),
windows as (select rid, i, array_to_string(ws[i + 1 : i + 5], ' ') as w from places),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as n from windows) where n > 1),
repeats as (select rid, count(distinct i + k) as n from twice, range(0, 5) as r(k) group by rid),
base as (
  select d.rid, d.doc_id, len(d.ws)::bigint as n_words,
    coalesce(list_sum(list_transform(d.ws, lambda w: length(w))), 0)::bigint as word_chars,
    (length(d.t) - length(translate(d.t, '{SYMBOLS}', '')))::bigint as n_symbols,
    coalesce(b.dups, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    coalesce(b.had, 0) as had, coalesce(b.remains, 0) as remains
  from words d left join by_line b using (rid) left join repeats r using (rid)),
verdict as (select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (had - remains) <= {r.max_lost} * had as kept
from verdict"""


#: Four base-32 digits of each five hexadecimal ones.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)
_OP8 = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
k as (select h, max(page_id) as keeper from p group by h)
select p.page_id, p.n::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when p.page_id = k.keeper then 'response' else 'revisit' end as record_type,
  case when p.page_id <> k.keeper then k.keeper end as refers_to
from p join k using (h)"""


#: Every link of whole sets by a join on shingles, then labels passed along links until none gets smaller.
_OP5 = f"""
with recursive words as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') as w from documents),
shingles as (select distinct rid, unnest(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s, least(len(w), 5) as k from words),
sizes as (select rid, count(*) as n from shingles group by rid),
shared as (select a.rid as a, b.rid as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.k = b.k and a.rid < b.rid group by 1, 2),
links as (select a, b from shared join sizes x on x.rid = a join sizes y on y.rid = b where 100 * common >= 75 * (x.n + y.n - common)),
both_ways as (select a, b from links union all select b, a from links),
reached(rid, other) as (select rid, rid from words union select r.rid, l.b from reached r join both_ways l on l.a = r.other)
select w.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
from reached r join words w on w.rid = r.rid join words o on o.rid = r.other left join sizes z on z.rid = w.rid group by w.rid, w.doc_id"""


ORACLE = {"op5_jaccard": _OP5, "op8_warc": _OP8, "op10_quality_rules": _op10()}
