"""Column expressions for words and spellings: the same functions as forms and script, inside the JVM.

Folding of characters beyond ASCII needs NFKC, which Spark lacks: these expressions take folded text (fold() is an
Arrow UDF over distinct forms, or not needed at all where text is ASCII).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import tables as T

_OPEN, _SHUT = "\ue000", "\ue001"  # private-use marks around a decoded sequence
_WORDLIKE = f"[{T.WORD}_]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in text)


def _set(text: str) -> str:
    return "".join(f"\\{c}" for c in text)


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def has_devanagari(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{097F}]")


def fold(text: Column) -> Column:
    """Marks dropped, look-alikes and compatibility forms replaced; an Arrow UDF, so give it distinct forms that aren't ASCII."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tamarack.functions import forms

        for column in columns:
            yield pa.array([None if x is None else forms.fold(x) for x in column.to_pylist()], pa.string())

    ship(SparkSession.active())  # workers import the package by name
    return F.arrow_udf(run, "string")(text)


def folded(text: Column) -> Column:
    """fold() of what isn't ASCII, the rest as it is."""
    return F.coalesce(fold(F.when(~is_ascii(text), text)), text)


def _readings(text: Column, of: str) -> Column:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tamarack.functions import script

        for column in columns:
            yield pa.array([None if x is None else getattr(script, of)(x) for x in column.to_pylist()], pa.list_(pa.string()))

    ship(SparkSession.active())
    return F.arrow_udf(run, "array<string>")(F.when(has_devanagari(text), text))


def romanisations(text: Column) -> Column:
    """All readings of a word with Devanagari in it; null without."""
    return _readings(text, "romanisations")


def transliterations(text: Column) -> Column:
    """What a word may stand for in romanised Hindi, in order."""
    return F.coalesce(_readings(text, "transliterations"), phonetic_variants(text))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{T.INVISIBLE}]", "")


def collapse(text: Column, least: int, keep: int) -> Column:
    """Runs of at least so many equal characters become `keep` of them; possessive, so linear in a run's length."""
    return F.regexp_replace(text, r"([\x{0}-\x{FFFF}&&[^\n\r\x{2028}\x{2029}]])\1{" + str(least - 1) + ",}+", "$1" * keep)


#: Words that decoding and collapsing leave as they are; most words are, and skip the work.
_SETTLED, _UNSETTLED = "^[a-z]++$", r"ph|vv|([a-z])\1\1"


def settled(low: Column) -> Column:
    return low.rlike(_SETTLED) & ~low.rlike(_UNSETTLED)


def decode(text: Column, literal: bool = False) -> Column:
    """Sequences in one pass (marked first, so that no output is decoded again), then single characters."""
    chosen = {s: to for s, to in T.SEQUENCES.items() if not (literal and any(c.isdigit() for c in s))}
    every = "|".join(_quoted(s) for s in sorted(chosen, key=len, reverse=True))
    out = F.regexp_replace(text, f"({every})", f"{_OPEN}$1{_SHUT}")
    for sequence, letter in chosen.items():
        out = F.replace(out, F.lit(f"{_OPEN}{sequence}{_SHUT}"), F.lit(letter))
    out = F.when(text.rlike(every), out).otherwise(text)
    singles = {c: to for c, to in T.SINGLES.items() if not (literal and c.isdigit())}
    one = {c: to for c, to in singles.items() if len(to) == 1}
    gone = [c for c, to in singles.items() if not to]
    out = F.translate(out, "".join([*one, *gone]), "".join(one.values()))
    for c, to in singles.items():
        if len(to) > 1:
            out = F.replace(out, F.lit(c), F.lit(to))
    return out


def strip_separators(text: Column) -> Column:
    """A separator between two word characters goes; neighbours are those of the text as it comes in."""
    return F.regexp_replace(text, f"(?<={_WORDLIKE})(?:[{_set(T.SEPARATORS)}]|[{T.BLANK}])(?={_WORDLIKE})", "")


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{T.BLANK}]+", ""), f"[{T.BLANK}]++$", "")


def normalize(text: Column, literal: bool = False) -> Column:
    """Of folded text: lower case, without invisible characters, decoded, runs collapsed to two, separators gone; digits alone stay."""

    def told(low: Column) -> Column:
        return F.when(settled(low) | low.rlike("^[0-9]+$"), low).otherwise(_trim(strip_separators(collapse(decode(low, literal), 3, 2))))

    return let(strip_invisible(F.lower(text)), told)


def variants(text: Column, literal: bool = False) -> Column:
    """Distinct non-empty spellings, the surest first."""
    low = F.lower(text)

    def told(base: Column) -> Column:
        low = strip_invisible(F.lower(text))
        whole = let(low, lambda x: F.when(x.rlike("^[0-9]+$"), x).otherwise(decode(x, literal)))
        every = F.array(base, collapse(base, 2, 1), _trim(strip_separators(whole)), F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))
        return F.filter(F.array_distinct(every), lambda v: v != "")

    return F.when(settled(low), F.array_distinct(F.array(low, collapse(low, 2, 1)))).otherwise(let(normalize(text, literal), told))


def code_shape(text: Column) -> Column:
    """Struct: core (lower-cased letters, digits and symbols that stand for letters), size, digits, blocks, hexadecimal."""
    core = F.regexp_replace(text, rf"[^\p{{L}}0-9{_set(''.join(c for c in T.SINGLES if not c.isalnum()))}]", "")

    def told(c: Column) -> Column:
        blocks = F.regexp_count(c, F.lit("[0-9]+")) + F.regexp_count(c, F.lit("[^0-9]+"))
        return F.struct(F.lower(c).alias("core"), F.length(c).alias("size"), F.regexp_count(c, F.lit("[0-9]")).alias("digits"), blocks.alias("blocks"), (~c.rlike("[^0-9a-fA-F]")).alias("hexadecimal"))

    return let(core, told)


def looks_like_code(text: Column) -> Column:
    def told(s: Column) -> Column:
        n, d = s["size"], s["digits"]
        few = (n <= 3) | ((n == 4) & (d == 3))
        label = (s["blocks"] == 2) & ((d >= 3) | ((d == 2) & (n <= 4)))
        formats = F.lit(False)
        for pattern in T.CODE_FORMATS:
            formats = formats | s["core"].rlike(pattern)
        return (d > 0) & (d < n) & (few | label | (s["hexadecimal"] & (n >= 6)) | formats)

    return let(code_shape(text), told)


def is_hex_blob(text: Column) -> Column:
    return let(code_shape(text), lambda s: s["hexadecimal"] & (s["size"] >= 6) & (s["digits"] > 0) & (s["digits"] < s["size"]))


def has_edge_digits(text: Column) -> Column:
    return text.rlike("[0-9]") & (code_shape(text)["blocks"] == 2)


def strip_edges(text: Column) -> Column:
    """A segment without punctuation at its edges."""
    return F.btrim(text, F.lit(T.EDGES))


def phonetic(word: Column) -> Column:
    out = F.lower(word)
    for a, b in T.PHONETIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def phonetic_variants(word: Column) -> Column:
    low = F.lower(word)
    vowels = F.replace(F.replace(F.replace(low, F.lit("aa"), F.lit("a")), F.lit("ee"), F.lit("i")), F.lit("oo"), F.lit("u"))
    return F.filter(F.array_distinct(F.array(low, phonetic(word), vowels)), lambda v: v != "")


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def words(text: Column) -> Column:
    """The main word pattern, before elisions and contractions are split off."""
    return F.regexp_extract_all(text, F.lit(f"[{T.WORD}]+(?:[{T.APOSTROPHES}][{T.LATIN}]{{1,20}})?"), F.lit(0))


def segments(text: Column) -> Column:
    return F.filter(F.split(text, f"[{T.BLANK}]+"), lambda s: s != "")
