"""DuckDB SQL for the registered queries, with the lexicon inlined."""

from __future__ import annotations

from ..functions import forms
from ..functions import tables as T
from ..lexicon import SEVERITIES, Lexicon, load
from ..operators.moderation import SPAM, SPAM_FACTOR, WEIGHTS


def quote(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    if not rows:
        return f"{name}({columns}) as (select {', '.join('null' for _ in columns.split(','))} where false)"
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)})"


WORDS = f"[{T.WORD}]+(?:[{T.APOSTROPHES}][{T.LATIN}]{{1,20}})?".replace("'", "''")
_RUN2 = "list_reduce(string_split({x}, ''), lambda a, c: case when right(a, 2) = c || c then a else a || c end)"
_RUN1 = "list_reduce(string_split({x}, ''), lambda a, c: case when right(a, 1) = c then a else a || c end)"


def _decoded(x: str) -> str:
    """Of a lower-cased word, or words with blanks between them: the sequences that consist of letters and digits, then single characters."""
    for sequence, letter in (("13", "b"), ("ph", "f"), ("vv", "w")):
        x = f"replace({x}, '{sequence}', '{letter}')"
    one = {c: to for c, to in T.SINGLES.items() if len(to) == 1 and c.isalnum()}
    x = f"translate({x}, '{''.join(one)}', '{''.join(one.values())}')"
    for c, to in T.SINGLES.items():
        if len(to) > 1:
            x = f"replace({x}, '{c}', '{to}')"
    return x


def _normal(x: str) -> str:
    return f"case when regexp_full_match({x}, '[0-9]+') then {x} else replace({_RUN2.format(x=_decoded(x))}, '''', '') end"


def lexicon_tables(lexicon: Lexicon, languages: tuple[str, ...] | None = None, least: str = "low") -> str:
    words, phrases = lexicon.scan(languages)
    keys: dict[str, int] = {}
    for k, w in enumerate(words):
        for other in (*w.normalized, *w.aliases):
            keys.setdefault(other.lower(), k)
    keys |= {w.word.lower(): k for k, w in enumerate(words)}
    passes = lambda w: SEVERITIES.index(w.severity) >= SEVERITIES.index(least)
    entry = lambda w: (w.word, w.language, w.severity, w.category, passes(w))
    patterns: dict[str, int] = {}
    for k, w in enumerate(words):
        if w.partial:
            patterns.setdefault(forms.normalize(w.word.lower()), k)
    columns = "matched, language, severity, category, passes"
    return ",\n".join((
        values("keys", f"key, {columns}", [(key, *entry(words[k])) for key, k in keys.items()]),
        values("patterns", f"pattern, {columns}", [(p, *entry(words[k])) for p, k in patterns.items()]),
        values("canonical", "word, ord", [(w.word.lower(), k) for k, w in enumerate(words)]),
        values("safe", "safe", [(x,) for x in sorted(lexicon.safe_words({w.language for w in words}))]),
        values("phrases", f"key, {columns}, width", [(forms.normalize(p.phrase), p.phrase, p.language, p.severity, p.category, passes(p), len(p.phrase.split())) for p in phrases]),
    ))


TOKENS = f"""toks as (select doc_id, lang, unnest(regexp_extract_all(text, '{WORDS}')) as value, generate_subscripts(regexp_extract_all(text, '{WORDS}'), 1) - 1 as pos from documents)"""
FORMS = """forms as (select lower(value) as value, count(*) as n from toks group by 1),
unsafe as (select * from forms where value not in (select safe from safe))"""
_SPELLED = f"""based as (select value, n, {_normal('value')} as base from unsafe),
spelled as (
  select value, n, v, min(k) as k from (
    select value, n, unnest([base, {_RUN1.format(x='base')}, case when regexp_full_match(value, '[0-9]+') then value else replace({_decoded('value')}, '''', '') end, regexp_replace(value, '[^a-z0-9]', '', 'g')]) as v,
      generate_subscripts([1, 2, 3, 4], 1) as k
    from based where base <> '') group by 1, 2, 3)"""
EXACT = """exact_hits as (select value, n, matched, language, severity, category, 'exact' as match_type, 1.0::double as confidence from unsafe join keys on value = key where passes)"""
ENTRY = "matched, language, severity, category"
_PICK = "e.matched as matched, e.language as language, e.severity as severity, e.category as category"
_STRUCT = "{'matched': matched, 'language': language, 'severity': severity, 'category': category}"


def _left(done: list[str]) -> str:
    return " and ".join(f"value not in (select value from {x})" for x in done)


def _norm_hits(source: str = "spelled", where: str = "true") -> str:
    return f"""norm_hits as (select value, n, {_PICK}, 'normalized' as match_type, 0.95::double as confidence from (
  select value, n, arg_min({_STRUCT}, k) as e from {source} join keys on v = key where passes and v <> '' and (length(v) >= 3 or v = value) and {where} group by 1, 2))"""


def _part_hits(where: str = "true") -> str:
    return f"""part_hits as (select value, n, {_PICK}, 'normalized' as match_type, 0.85::double as confidence from (
  select value, n, arg_min({_STRUCT}, [k, instr(v, pattern) + length(pattern), -length(pattern)]) as e
  from spelled join patterns on contains(v, pattern) and v <> pattern where passes and length(v) >= 4 and {where} group by 1, 2))"""


def _fuzz_hits(where: str = "true") -> str:
    return f"""near as (
  select b.value, b.n, b.base, c.word, c.ord, d.turn, d.slack, greatest(length(b.base), length(c.word)) as longest
  from (select * from based where base <> '' and length(value) >= 3 and {where}) b, (values (0, 0, 2), (-1, 1, 1), (1, 2, 1)) d(off, turn, slack), canonical c
  where unicode(c.word) = unicode(b.base) + d.off and abs(length(c.word) - length(b.value)) <= d.slack),
scored as (
  select *, 1 - levenshtein(base, word)::double / longest as score from near
  where abs(length(word) - length(base)) <= floor(longest * (1 - 0.85::double)) and (turn = 0 or floor(longest * (1 - 0.85::double)) >= 2)),
fuzz_hits as (select value, n, {ENTRY}, 'fuzzy' as match_type, score as confidence from (
  select value, n, arg_max(word, [score, -turn, -ord]) as word, max(score) as score from scored where score >= 0.85::double group by 1, 2) join keys on word = key where passes)"""


def windowed(x: str) -> str:
    """The normal form of a window of words with blanks between them."""
    return f"replace(replace({_RUN2.format(x=_decoded(x))}, ' ', ''), '''', '')"


def verdicts() -> tuple[str, ...]:
    """Tables from forms to `verdicts`: the tiers in their order, the first that has a form decides."""
    tiers = ["exact_hits", "norm_hits", "part_hits"]
    union = " union all ".join(f"select * from {x}" for x in (*tiers, "fuzz_hits"))
    return FORMS, _SPELLED, EXACT, _norm_hits(where=_left(tiers[:1])), _part_hits(_left(tiers[:2])), _fuzz_hits(_left(tiers)), f"verdicts as ({union})"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def oracle(lexicon: Lexicon | None = None) -> dict[str, str]:
    lexicon = lexicon or load()
    every = lexicon_tables(lexicon)
    words, _ = lexicon.scan(None)
    out: dict[str, str] = {}
    out["lexicon_profile"] = _with(values("w", "language, severity, category, partial", [(x.language, x.severity, x.category, x.partial) for x in words])) + (
        "select language, severity, category, count(*) as words, count(*) filter (partial) as partial_words from w group by 1, 2, 3"
    )
    out["token_stats"] = _with(TOKENS) + "select lang, count(*) as tokens, count(distinct lower(value)) as forms, max(length(value)) as longest from toks group by 1"
    out["token_ngrams"] = _with(TOKENS, "grams as (select lower(value) || ' ' || lower(lead(value) over (partition by doc_id order by pos)) as gram from toks)") + (
        "select gram, count(*) as n from grams where gram is not null group by 1 order by n desc, gram limit 100"
    )
    hit = "select value, n, matched, language, severity, category, match_type, confidence from "
    out["exact_hits"] = _with(every, TOKENS, FORMS, EXACT) + hit + "exact_hits"
    out["normalized_hits"] = _with(every, TOKENS, FORMS, _SPELLED, _norm_hits()) + hit + "norm_hits"
    padded = TOKENS.replace("unnest(", "'zq' || unnest(", 1).replace(" as value", " || 'zq' as value", 1)
    out["partial_hits"] = _with(every, padded, FORMS, _SPELLED, _part_hits()) + hit + "part_hits"
    out["fuzzy_hits"] = _with(every, TOKENS, FORMS, _SPELLED, _fuzz_hits()) + "select value, n, matched, language, severity, category, match_type, round(confidence, 6) as confidence from fuzz_hits"
    out["form_verdicts"] = _with(every, TOKENS, *verdicts()) + "select value, n, matched, language, severity, category, match_type, round(confidence, 6) as confidence from verdicts"
    for name, languages, least in (("min_severity_hits", None, "medium"), ("language_scoped_hits", ("en", "fr"), "low")):
        out[name] = _with(lexicon_tables(lexicon, languages, least), TOKENS, FORMS, EXACT) + "select matched, language, severity, sum(n)::bigint as hits from exact_hits group by 1, 2, 3"

    obfuscated = f"""toks as (select doc_id, lang, translate(unnest(regexp_extract_all(text, '{WORDS}')), 'oieO', '013o') as value from documents)"""
    out["leet_hits"] = _with(every, obfuscated, FORMS, _SPELLED, _norm_hits()) + "select matched, language, count(*) as forms, sum(n)::bigint as hits from norm_hits group by 1, 2"
    out["collapse_runs_tokens"] = _with(TOKENS, "f as (select distinct lower(value) as value from toks)") + f"select value, {_RUN2.format(x='value')} as twice, {_RUN1.format(x='value')} as once from f where {_RUN1.format(x='value')} <> value"
    out["normalized_tokens"] = _with(TOKENS, "f as (select distinct lower(value) as value from toks)") + f"select value, {_normal('value')} as normal from f"
    folds = "value"
    for a, b in T.PHONETIC:
        folds = f"replace({folds}, '{a}', '{b}')"
    out["phonetic_tokens"] = _with(TOKENS, "f as (select distinct lower(value) as value from toks)") + f"select value, {folds} as folded from f where {folds} <> value"

    symbols = "".join("\\" + c if c.isascii() else c for c in T.SINGLES if not c.isalnum())
    core = f"regexp_replace(s, '[^\\p{{L}}0-9{symbols}]', '', 'g')"
    few = "(n <= 3 or (n = 4 and d = 3)) or (b = 2 and (d >= 3 or (d = 2 and n <= 4))) or (hexadecimal and n >= 6)"
    formats = " or ".join(f"regexp_matches(lower(core), '{p}')" for p in T.CODE_FORMATS)
    edges = T.EDGES.replace("'", "''")
    out["code_segments"] = f"""
with s as (select distinct trim(unnest(regexp_split_to_array(text, '[{T.BLANK}]+')), '{edges}') as s from documents),
c as (select s, {core} as core from s where regexp_matches(s, '[0-9]')),
m as (select s, core, length(core) as n, len(regexp_extract_all(core, '[0-9]')) as d, len(regexp_extract_all(core, '[0-9]+')) + len(regexp_extract_all(core, '[^0-9]+')) as b,
  not regexp_matches(core, '[^0-9a-fA-F]') as hexadecimal from c)
select s as segment, d > 0 and d < n and ({few} or {formats}) as is_code, hexadecimal and n >= 6 and d > 0 and d < n as is_hex, b = 2 as edge_digits from m"""

    profile, grams = (" union all ".join(
        f"select doc_id, pos, phrase, {n} as width from (select doc_id, pos, lower(value) || {' || '.join(repr(' ') + f' || lower(lead(value, {k}) over w)' for k in range(1, n))} as phrase from toks window w as (partition by doc_id order by pos)) where phrase is not null"
        for n in sizes
    ) for sizes in (range(2, max(len(p.phrase.split()) for p in lexicon.phrases) + 1), sorted({len(p.phrase.split()) for p in lexicon.phrases})))
    planted = TOKENS.replace("(text,", "(replace(text, 'idiot', 'go to hell'),")
    out["phrase_hits"] = _with(every, planted, f"grams as ({grams})", f"keyed as (select doc_id, pos, {windowed('phrase')} as key from grams)") + (
        f"select doc_id, pos::int as pos, {ENTRY}, 'phrase' as match_type, 1.0::double as confidence from keyed join phrases using (key) where passes"
    )

    by_doc = f"""hits as (select t.doc_id, t.pos, e.matched, e.language, e.severity, e.category from toks t join exact_hits e on lower(t.value) = e.value)"""
    weight = "case severity " + " ".join(f"when '{s}' then {w}" for s, w in WEIGHTS.items()) + " end"
    base = (every, TOKENS, FORMS, EXACT, by_doc)
    out["exact_score"] = _with(
        *base,
        "sizes as (select doc_id, count(*) as tokens from toks group by 1)",
        f"""totals as (select doc_id, sum(n)::bigint as total_matches, count(*) as unique_matches, max(n) >= {SPAM} as repetition_spam, sum(w) as weight,
  coalesce(sum(n) filter (severity = 'low'), 0)::bigint as low, coalesce(sum(n) filter (severity = 'medium'), 0)::bigint as medium, coalesce(sum(n) filter (severity = 'high'), 0)::bigint as high
  from (select doc_id, matched, severity, count(*) as n, sum({weight}) as w from hits group by 1, 2, 3) group by 1)""",
    ) + (
        f"select d.doc_id, coalesce(total_matches, 0)::bigint as total_matches, coalesce(unique_matches, 0)::bigint as unique_matches, coalesce(repetition_spam, false) as repetition_spam, coalesce(low, 0)::bigint as low, "
        f"coalesce(medium, 0)::bigint as medium, coalesce(high, 0)::bigint as high, round(least(1.0, coalesce(weight, 0)::double / greatest(coalesce(tokens, 0), 1) * case when repetition_spam then {SPAM_FACTOR} else 1.0 end)::double, 6) as toxicity "
        "from documents d left join totals using (doc_id) left join sizes using (doc_id)"
    )
    out["exact_is_clean"] = _with(*base) + "select doc_id, doc_id not in (select doc_id from hits) as is_clean from documents"
    out["category_report"] = _with(*base) + "select language, category, severity, count(*) as hits from hits group by cube (language, category, severity)"
    out["language_rollup"] = _with(*base) + "select language, category, count(*) as hits, count(distinct matched) as terms, count(distinct doc_id) as docs from hits group by rollup (language, category)"
    out["top_terms"] = _with(*base) + "select matched, language, count(*) as hits from hits group by 1, 2 order by hits desc, matched, language limit 20"
    out["source_ranking"] = _with(*base) + (
        "select source, hits, rank() over (order by hits desc)::int as place from (select source, count(*) as hits from hits join documents using (doc_id) group by 1)"
    )
    out["eval_vs_labels"] = _with(
        *base, "f as (select l.toxic as y, l.doc_id in (select doc_id from hits) as f from labels l join documents d using (doc_id) where l.toxic in (0, 1))",
        "c as (select count(*) filter (y = 1 and f) as tp, count(*) filter (y = 0 and f) as fp, count(*) filter (y = 1 and not f) as fn, count(*) filter (y = 0 and not f) as tn from f)",
    ) + (
        "select tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, "
        "round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 6) as accuracy from c"
    )
    talk = f"""toks as (select conv_id, turn, role, unnest(regexp_extract_all(replace(text, ' the ', ' idiot '), '{WORDS}')) as value from conversations)"""
    out["conversation_abuse_by_role"] = _with(every, talk, FORMS, EXACT) + (
        "select role, count(*) as hits, count(distinct conv_id) as conversations, min(turn) as first_turn from toks join exact_hits e on lower(toks.value) = e.value group by 1"
    )
    out["vocabulary_candidates"] = _with(every, TOKENS, FORMS) + (
        "select value, n from forms where n >= 20 and regexp_full_match(value, '[a-z]{4,}') and not exists (select 1 from keys where key = value) and not exists (select 1 from safe where safe = value)"
    )
    out["benchmark_overlap"] = (
        f"with a as (select distinct lower(unnest(regexp_extract_all(text, '{WORDS}'))) as value from documents), b as (select distinct lower(unnest(regexp_extract_all(text, '{WORDS}'))) as value from benchmark) "
        "select length(value)::int as size, count(*) as shared from (select value from a intersect select value from b) group by 1"
    )
    out["ngram_profile"] = _with(TOKENS, f"grams as ({profile})", "counted as (select width, phrase, count(*) as n from grams group by 1, 2)") + (
        "select width::int as size, sum(n)::bigint as windows, count(*) as phrases, max(n) as most from counted group by 1"
    )
    out["stream_hits_by_window"] = (
        "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as rows, count(*) filter (contains(event_type, 'click')) as flagged, count(*) filter (contains(event_type, 'click')) as hits from events group by 1, 2"
    )
    return out
