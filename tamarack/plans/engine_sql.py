"""DuckDB SQL for the queries over whole texts: offsets, phrases with context, the greedy pass, scores and masks."""

from __future__ import annotations

import re

from ..functions import tables as T
from ..lexicon import Lexicon
from ..operators.moderation import SPAM, SPAM_FACTOR, WEIGHTS
from . import sql
from .queries import CONTEXTS, DISGUISES, SYMBOLS


def decoded(x: str, literal: bool = False) -> str:
    """Every sequence and every single character decoded in one pass, by cutting a text into them: the longest that fits goes first."""
    sequences = [s for s in T.SEQUENCES if not (literal and any(c.isdigit() for c in s))]
    table = {s: T.SEQUENCES[s] for s in sequences} | {c: to for c, to in T.SINGLES.items() if not (literal and c.isdigit())}
    pattern = "|".join([*(re.escape(s) for s in sorted(sequences, key=len, reverse=True)), "."])
    values = ", ".join(f"{sql.quote(a)}: {sql.quote(b)}" for a, b in table.items())
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({x}, {sql.quote('(?s)' + pattern)}), lambda c: coalesce((map {{{values}}})[c], c)), ''), '')"


def source(text: str = "text", table: str = "documents", key: str = "doc_id") -> str:
    """Words with their offsets: a text is cut into words and what is between them, which leaves nothing out."""
    return f"""cut as (select {key} as doc_id, regexp_extract_all({text}, '{sql.WORDS}|[^{T.WORD}]+') as p from {table}),
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as k from cut),
placed as (select doc_id, k, piece, regexp_full_match(piece, '{sql.WORDS}') as word, (sum(length(piece)) over (partition by doc_id order by k))::bigint as stop from pieces),
toks as (select doc_id, k, piece as value, stop - length(piece) as start, stop, row_number() over (partition by doc_id order by k) - 1 as pos from placed where word)"""


#: Of spans (doc_id, start, stop, confidence, matched, ...) those that a greedy pass from the left keeps.
KEPT = """ordered as (select *, row_number() over (partition by doc_id order by start, confidence desc, start - stop, matched) as nth from spans),
walk as (select doc_id, nth, stop as free, true as keep from ordered where nth = 1 union all
  select o.doc_id, o.nth, case when o.start >= w.free then o.stop else w.free end, o.start >= w.free from walk w join ordered o on o.doc_id = w.doc_id and o.nth = w.nth + 1),
kept as (select o.* from ordered o join walk w using (doc_id, nth) where w.keep)"""


def windows(lexicon: Lexicon) -> str:
    """Windows of words as wide as phrases, with their normal form."""
    one = lambda n: " || ' ' || ".join(["lower(value)", *(f"lower(lead(value, {k}) over w)" for k in range(1, n))])
    every = " union all ".join(
        f"select doc_id, k, pos, start, lead(stop, {n - 1}) over w as stop, {one(n)} as phrase, {n} as width from toks window w as (partition by doc_id order by pos)" for n in sorted({len(p.phrase.split()) for p in lexicon.phrases})
    )
    return f"grams as ({every}),\nwindows as (select *, {sql.windowed('phrase')} as key from grams where phrase is not null)"


def engine(lexicon: Lexicon, tokens: str) -> str:
    """Detections of whole texts: words by the tiers in their order, phrases, and the greedy pass. Of the engine's passes
    it leaves out those for code, spelled-out words, other scripts and disguises across a segment, which the tables don't hold."""
    spans = f"""spans as (select t.doc_id, t.start, t.stop, {sql.ENTRY}, match_type, confidence from toks t join verdicts v on lower(t.value) = v.value
  union all select doc_id, start, stop, {sql.ENTRY}, 'phrase', 1.0::double from windows join phrases using (key) where passes)"""
    return "with recursive " + ",\n".join((sql.lexicon_tables(lexicon), tokens, *sql.verdicts(), windows(lexicon), spans, KEPT)) + "\n"


def contexts() -> str:
    """CONTEXTS spelled out: of each word the words around it, and whether only blanks and apostrophes are between them."""
    quotes = T.APOSTROPHES.replace("'", "''")
    around = f"""gaps as (select t.*, g.piece as gap, coalesce(regexp_full_match(g.piece, '[{T.BLANK}{quotes}]*'), true) as joined from toks t left join placed g on g.doc_id = t.doc_id and g.k = t.k + 1 and not g.word),
around as (select *, lower(value) as v0, lower(lead(value) over w) as v1, lower(lead(value, 2) over w) as v2, lower(lead(value, 3) over w) as v3, lower(lag(value) over w) as u1, lower(lag(value, 2) over w) as u2,
  lead(stop) over w as stop1, lead(gap) over w as gap1, lead(joined) over w as j1, lead(joined, 2) over w as j2, lag(joined) over w as h1, lag(joined, 2) over w as h2 from gaps window w as (partition by doc_id order by pos))"""
    cancelled = """case p.matched
    when 'of the' then (v2 = 'and' and j1) or (v2 = 'of' and j1 and v3 = 'to' and j2) or (u1 = 'the' and h1)
    when 'the and' then (u1 = 'to' and h1) or (u1 = 'of' and h1 and u2 = 'the' and h2)
    else v2 is not null and ltrim(coalesce(gap1, ''), ' ' || chr(9)) = '' end"""
    spans = f"""spans as (select doc_id, start, stop1 as stop, p.matched, p.severity, 'phrase' as match_type, 1.0::double as confidence
  from around join phrases p on p.phrase = v0 || ' ' || v1 where not coalesce({cancelled}, false))"""
    told = sql.values("phrases", "phrase, matched, severity", [(p.phrase, p.phrase, p.severity) for p in CONTEXTS])
    return "with recursive " + ",\n".join((told, source(), around, spans, KEPT)) + '\nselect doc_id, start, stop as "end", matched, severity, match_type, confidence from kept'


def oracle(lexicon: Lexicon) -> dict[str, str]:
    out: dict[str, str] = {}
    turned = "value"
    for letter, sequence in SYMBOLS:
        turned = f"replace({turned}, {sql.quote(letter)}, {sql.quote(sequence)})"
    out["decoded_tokens"] = f"with {sql.TOKENS}, f as (select distinct lower(value) as value from toks), t as (select value, {turned} as turned from f) select value, turned, {decoded('turned')} as decoded, {decoded('turned', True)} as literal from t"

    out["dedupe_spans"] = "with recursive " + ",\n".join((
        sql.lexicon_tables(lexicon), source("replace(text, 'idiot', 'go to hell idiot')"), sql.FORMS, sql.EXACT, windows(lexicon),
        """spans as (select t.doc_id, t.pos as start, t.pos + 1 as stop, matched, confidence from toks t join exact_hits v on lower(t.value) = v.value
  union all select doc_id, pos, pos + width, matched, 1.0::double from windows join phrases using (key, width) where passes)""", KEPT,
    )) + '\nselect doc_id, start::bigint as start, stop::bigint as "end", matched from kept'
    out["phrase_context_hits"] = contexts()

    plain = engine(lexicon, source())
    hidden = "text"
    for term, other in DISGUISES:
        hidden = f"replace({hidden}, '{term}', '{other}')"
    texts = f"(select doc_id, {hidden} as text from documents)"
    disguised = engine(lexicon, source(table=texts))
    surface = "substring(text, start::int + 1, (stop - start)::int)"
    columns = f'doc_id, start, stop as "end", {surface} as original, {sql.ENTRY}, match_type, round(confidence, 6) as confidence'
    out["detections"] = plain + f"select {columns} from kept join documents using (doc_id)"
    out["disguised_detections"] = disguised + f"select {columns} from kept join {texts} using (doc_id)"
    out["audit"] = disguised + f""", shown as (select match_type, language, matched, lower({surface}) as form from kept join {texts} using (doc_id)),
odd as (select match_type, language, matched, form, count(*) as n from shown where not contains(form, lower(matched)) and not contains(lower(matched), form) group by 1, 2, 3, 4)
select match_type, language, matched, sum(n)::bigint as hits, count(*) as forms, array_to_string(list_sort(list(form))[1:12], ', ') as samples from odd group by 1, 2, 3"""

    of = lambda s: f"count(*) filter (severity = '{s}') as {s}"
    weight = "case severity " + " ".join(f"when '{s}' then {w}" for s, w in WEIGHTS.items()) + " end"
    zero = lambda c: f"coalesce({c}, 0)::bigint as {c}"
    out["scores"] = plain + f""", terms as (select doc_id, matched, count(*) as n from kept group by 1, 2),
repeats as (select doc_id, max(n) >= {SPAM} as spam, count(*) as unique_matches from terms group by 1),
kinds as (select doc_id, string_agg(category || ':' || n, ',' order by category) as categories from (select doc_id, category, count(*) as n from kept group by 1, 2) group by 1),
totals as (select doc_id, count(*) as total_matches, sum({weight}) as weight, {of("low")}, {of("medium")}, {of("high")} from kept group by 1)
select d.doc_id, case when text is not null then round(least(1.0, coalesce(weight, 0)::double / greatest(len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')), 1) * case when spam then {SPAM_FACTOR} else 1.0 end)::double, 6) end as toxicity,
  coalesce(categories, '') as categories, {zero("low")}, {zero("medium")}, {zero("high")}, coalesce(spam, false) as repetition_spam, {zero("unique_matches")}, {zero("total_matches")}, coalesce(length(text) > 100000, false) as text_over_limit
from documents d left join totals using (doc_id) left join repeats using (doc_id) left join kinds using (doc_id)"""
    out["censored"] = plain + """select d.doc_id, case when text is not null then coalesce(t.censored, '') end as censored from documents d left join (
  select p.doc_id, string_agg(case when h.start is null then piece else repeat('*', length(piece)) end, '' order by p.k) as censored
  from placed p left join kept h on h.doc_id = p.doc_id and p.stop - length(piece) >= h.start and p.stop <= h.stop group by 1) t using (doc_id)"""
    out["clean_flags"] = plain + "select doc_id, doc_id not in (select doc_id from kept) as is_clean from documents"
    html = r"regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    out["page_detections"] = engine(lexicon, source(html, "pages", "page_id")) + "select matched, match_type, count(*) as hits, count(distinct doc_id) as pages from kept group by 1, 2"
    return out
