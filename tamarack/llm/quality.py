"""Quality rules, line first [native]: DataFrame functions only.

Every line is judged by itself (punctuation, navigation, symbols, boilerplate); lines that fail are removed;
a document that loses too much of its text, or fails the document rules, is rejected. Everything is a
row-local expression in one projection: no shuffle, no Python, so it scales with the scan.

Defined results: null or empty text has no words and fails; lines without a word count neither as text nor
as lost text; ties don't occur; repeated rows are judged row by row; extra columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, let, named, text_of

BOILERPLATE = (
    r"(?i)cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|"
    r"skip to (?:main )?content|accept (?:all )?cookies|click here|back to top|subscribe to our|lorem ipsum"
)
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»>•·"


@dataclass(frozen=True)
class Rules:
    """Shares are in percent, of words or of characters as said."""

    min_words: int = 10
    max_repeat: int = 20  # of the words, in repeated windows of five
    separators: int = 20  # of a line's words: a navigation bar
    symbols: int = 12  # of a line's characters
    shouts: int = 30  # of a line's words, runs of two or more ! or ?
    sentence_words: int = 12  # a line of so many words has a sentence mark
    boilerplate_words: int = 20  # a boilerplate phrase fails lines of at most so many words
    max_lost: int = 50  # of the characters of lines with words


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Whether a line that has a word is removed."""

    def judged(n: Column) -> Column:
        edge = r"[^\x20\x09-\x0D]"
        bars = F.regexp_count(line, F.lit(f"(?<!{edge})[{SEPARATORS}](?!{edge})"))
        shouts = F.regexp_count(line, F.lit(r"[!?]{2,}"))
        return (
            ((bars >= 2) & (100 * bars >= rules.separators * n))
            | (100 * _symbols(line) >= rules.symbols * F.length(line))
            | ((shouts >= 2) & (100 * shouts >= rules.shouts * n))
            | ((n >= rules.sentence_words) & ~line.rlike(r"[.!?…:;。！？]"))
            | ((n <= rules.boilerplate_words) & line.rlike(BOILERPLATE))
        )

    return let(F.regexp_count(line, F.lit(WORD)), judged)


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that the text has twice or more. Hashes rule out most texts; what
    they leave is decided on the words themselves."""

    def exact(n: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["w"] == F.get(s, k)["w"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), n - 5), lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | same(j, j + 1))
            return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda v, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - v, F.lit(5))))
            return F.aggregate(steps, F.lit(0), lambda a, v: a + v)

        return let(let(windows, places), covered)

    def told(n: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(exact(n))

    return F.when(F.size(words) < 6, 0).otherwise(let(F.size(words), told))


def measures(text: Column, rules: Rules = Rules()) -> Column:
    """One struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean (the text without the lines that fail)."""

    def whole(words: Column, lines: Column, own: Column, good: Column) -> Column:
        chars = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.length(v))
        counts = F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars(words).alias("word_chars"),
            _symbols(text).cast("long").alias("n_symbols"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

        def verdict(c: Column) -> Column:
            failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat * c["n_words"])
            had, left = chars(own), chars(F.filter(good, lambda x: x.rlike(WORD)))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            return F.struct(
                *(c[x].alias(x) for x in names),
                failed.alias("base_failed"),
                (~failed & (100 * (had - left) <= rules.max_lost * had)).alias("kept"),
                F.array_join(good, "\n").alias("clean"),
            )

        return let(counts, verdict)

    def lined(words: Column, lines: Column) -> Column:
        return let(
            F.filter(lines, lambda x: x.rlike(WORD)),
            lambda own: let(F.filter(lines, lambda x: ~x.rlike(WORD) | ~line_fails(x, rules)), lambda good: whole(words, lines, own, good)),
        )

    return let(_words(text), lambda words: let(F.split(text, "\n"), lambda lines: lined(words, lines)))


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", into: str = "quality") -> DataFrame:
    """df with a struct column of measures(); a column of that name is replaced."""
    return df.withColumn(into, measures(text_of(text), rules))


def clean(df: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that the rules keep, their failing lines removed. Columns stay; n_chars, if there, follows the text."""
    # A generator evaluates its input once; a filter over a projected struct would be pushed down and evaluate it again.
    kept = F.filter(F.array(measures(text_of(text), rules)), lambda m: m["kept"])
    others = [c for c in df.columns if c not in (text, "n_chars")]
    made = fresh(df.select(*map(named, others)), "clean")
    judged = df.select(*map(named, others), F.explode(F.transform(kept, lambda m: m["clean"])).alias(made))
    own = {text: F.col(made), "n_chars": F.length(made).cast("long")}
    return judged.select(*(own[c].alias(c) if c in own else named(c) for c in df.columns))
