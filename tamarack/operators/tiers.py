"""Dictionary matching as joins over distinct forms, for work over whole corpora.

A corpus has far fewer distinct words than words: occurrences are reduced to forms, each form is looked up once
per tier, and verdicts go back by an equi-join. Lexicon tables are broadcast only while they are small
(BROADCAST_ROWS); beyond that Spark joins them by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, native
from ..functions import tables as T
from ..lexicon import SEVERITIES, Lexicon
from ..plans.config import Config
from ..plans.scanner import HINDI

#: A lexicon table of at most so many rows (a few MB) is broadcast.
BROADCAST_ROWS = 100_000
_ENTRY = ("matched", "language", "severity", "category")


class Tables:
    """A lexicon's dimension tables for a configuration, built on the driver in closed form."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon, config: Config = Config()):
        words, phrases = lexicon.scan(config.languages)
        least = SEVERITIES.index(config.min_severity)
        self.spark, self.config, self.lexicon = spark, config, lexicon
        own = [(w.word, w.language, w.severity, w.category, SEVERITIES.index(w.severity) >= least) for w in words]
        keys: dict[str, int] = {}
        for k, w in enumerate(words):  # the first that lists a spelling, but the last whose own it is
            for other in (*w.normalized, *w.aliases):
                keys.setdefault(other.lower(), k)
        keys |= {w.word.lower(): k for k, w in enumerate(words)}
        partial: dict[str, int] = {}
        for k, w in enumerate(words):
            if w.partial and len(p := forms.normalize(w.word.lower())) >= 3:
                partial.setdefault(p, k)
        entry = "matched string, language string, severity string, category string, passes boolean"
        make = lambda rows, kind: self._sized(spark.createDataFrame(rows, kind), len(rows))
        self.keys = make([(key, *own[k]) for key, k in keys.items()], f"key string, {entry}")
        self.partial = make([(p, *own[k]) for p, k in partial.items()], f"pattern string, {entry}")
        self.canonical = make([(w.word.lower(), k) for k, w in enumerate(words)], "word string, ord int")
        self.safe = make([(x,) for x in sorted(lexicon.safe_words({w.language for w in words}) | config.lowered())], "safe string")
        self.phrase_rows = [(forms.normalize(p.phrase), p.phrase, p.language, p.severity, p.category, SEVERITIES.index(p.severity) >= least, len(p.phrase.split())) for p in phrases]
        self.phrases = make(self.phrase_rows, f"key string, {entry}, width int")
        self.words = make([(*o[:4], w.partial, len(w.normalized), len(w.aliases)) for o, w in zip(own, words)], "word string, language string, severity string, category string, partial boolean, normalized int, aliases int")

    @staticmethod
    def _sized(table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, value: every word of the main pattern, in order. Row-local."""
    return df.select(key, F.posexplode(native.words(F.col(text))).alias("pos", "value"))


def distinct_forms(occurrences: DataFrame, value: str = "value") -> DataFrame:
    """value and how often it occurs; partial counts are combined before the shuffle. Forms are few bytes but much
    work, so they are dealt over a stated number of tasks that adaptive execution doesn't merge."""
    counted = occurrences.groupBy(F.lower(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.repartition(int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")


def _hit(kind: str, confidence: Column | float) -> list[Column]:
    return [F.lit(kind).alias("match_type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence")]


def not_safe(found: DataFrame, tables: Tables) -> DataFrame:
    return found.join(tables.safe, F.col("value") == F.col("safe"), "left_anti")


def not_exempt(found: DataFrame, tables: Tables) -> DataFrame:
    """Without Devanagari forms one of whose readings is safe or whitelisted; after the exact tier."""
    read = found.where(native.has_devanagari(F.col("value"))).select("value", F.explode(native.romanisations(F.col("value"))).alias("_r"))
    exempt = read.join(tables.safe, F.col("_r") == F.col("safe"), "left_semi").select(F.col("value").alias("_x")).distinct()
    return found.join(exempt, F.col("value") == F.col("_x"), "left_anti")


def _fixed(found: DataFrame) -> DataFrame:
    """found, with its forms behind an expression that Spark takes for indeterminate (it is never anything but the form):
    joins and conditions of one tier aren't pushed below the reduction to distinct forms, where they would be worked out
    for every occurrence, and as all tiers read the same forms, they are made once."""
    return found.select(*(F.when(F.monotonically_increasing_id() >= 0, F.col(c)).alias(c) if c == "value" else F.col(c) for c in found.columns))


def _spelled(found: DataFrame) -> DataFrame:
    """found with _all, the spellings of each form; the fold, a Python function, is a column of its own. Explode _all by
    an outer generator: of an inner one Spark infers a filter on _all, pushes it below the reduction to distinct forms,
    and so spells every occurrence."""
    return found.withColumn("_f", native.folded(F.col("value"))).withColumn("_all", native.variants(F.col("_f"))).drop("_f")


def not_stopped(found: DataFrame, tables: Tables) -> DataFrame:
    """Without forms one of whose spellings is whitelisted; after the normalised tier, which only stops there."""
    white = sorted(tables.config.lowered())
    if not white:
        return found
    return _spelled(found).where(~F.exists("_all", lambda v: v.isin(white))).drop("_all")


def exact(found: DataFrame, tables: Tables) -> DataFrame:
    """Forms that are keys: a hash join."""
    return found.join(tables.keys, F.col("value") == F.col("key")).where("passes").select(*found.columns, *_ENTRY, *_hit("exact", 1.0))


def normalized(found: DataFrame, tables: Tables) -> DataFrame:
    """Forms one of whose spellings is a key; the first spelling decides, short ones don't count, those from a whitelisted one on neither."""
    white = sorted(tables.config.lowered())
    every = _spelled(found)
    if white:
        stop = F.array_position(F.transform("_all", lambda v: v.isin(white)), True)
        every = every.withColumn("_all", F.when(stop > 0, F.slice("_all", 1, (stop - 1).cast("int"))).otherwise(F.col("_all")))
    spelled = every.select(*found.columns, F.posexplode_outer("_all").alias("_k", "_v")).where((F.length("_v") >= 3) | (F.col("_v") == F.col("value")))
    hits = spelled.join(tables.keys, F.col("_v") == F.col("key")).where("passes")
    first = hits.groupBy(*found.columns).agg(F.min_by(F.struct(*_ENTRY), "_k").alias("e"))
    return first.select(*found.columns, *(f"e.{x}" for x in _ENTRY), *_hit("normalized", 0.95))


def transliterated(found: DataFrame, tables: Tables) -> DataFrame:
    """Forms one of whose readings or phonetic folds is a key of romanised Hindi; the first decides."""
    read = found.select("*", F.posexplode(native.transliterations(F.col("value"))).alias("_k", "_r"))
    spelled = read.withColumn("_f", native.folded(F.col("_r"))).withColumn("_v", native.normalize(F.col("_f"))).where((F.length("_v") >= 3) | (F.col("_v") == F.col("value")))
    hits = spelled.join(tables.keys, F.col("_v") == F.col("key")).where(F.col("passes") & (F.col("language") == HINDI))
    first = hits.groupBy(*found.columns).agg(F.min_by(F.struct(*_ENTRY), "_k").alias("e"))
    return first.select(*found.columns, *(f"e.{x}" for x in _ENTRY), *_hit("normalized", 0.9))


def partial(found: DataFrame, tables: Tables) -> DataFrame:
    """Forms that contain a pattern: an equi-join of a form's triples of letters with the first triple of a pattern, then
    the whole pattern. The earliest end wins, then the longest."""
    spelled = _spelled(found).select(*found.columns, F.posexplode_outer("_all").alias("_k", "_v")).where(F.length("_v") >= 4)
    triples = F.transform(F.sequence(F.lit(1), F.length("_v") - 2), lambda i: F.substring("_v", i, F.lit(3)))
    met = spelled.withColumn("_t", F.explode(F.array_distinct(triples)))
    at = F.instr(F.col("_v"), F.col("pattern"))
    hits = met.join(tables.partial, F.col("_t") == F.substring("pattern", 1, 3)).where("passes").where((at > 0) & (F.col("_v") != F.col("pattern")))
    rank = F.struct("_k", (at + F.length("pattern")).alias("end"), (-F.length("pattern")).alias("size"))
    first = hits.groupBy(*found.columns).agg(F.min_by(F.struct(*_ENTRY), rank).alias("e"))
    return first.select(*found.columns, *(f"e.{x}" for x in _ENTRY), *_hit("normalized", 0.85))


def fuzzy(found: DataFrame, tables: Tables) -> DataFrame:
    """Forms similar to a canonical word: an equi-join on the first letter, or a neighbour of it, and the length, for
    those lengths that leave the threshold within reach; then edit distance."""
    t = tables.config.threshold
    plain = found.withColumn("_f", native.folded(F.col("value"))).select(*found.columns, native.normalize(F.col("_f")).alias("_p")).where((F.length("value") >= 3) & (F.col("_p") != ""))
    turns = [(step, slack, turn) for turn, (step, slack) in enumerate(((0, 2), (-1, 1), (1, 1)))]
    probe = lambda step, more, turn: F.struct(F.char(F.ascii("_p") + step).alias("first"), (F.length("value") + more).alias("size"), F.lit(abs(step)).alias("off"), F.lit(turn).alias("turn"))
    blocks = plain.select("*", F.explode(F.array(*(probe(step, more, turn) for step, slack, turn in turns for more in range(-slack, slack + 1)))).alias("_b"))
    longest = F.greatest(F.length("_p"), F.col("_b.size"))
    edits = F.floor(longest * F.lit(1 - t))
    may = (F.abs(F.col("_b.size") - F.length("_p")) <= edits) & ((F.col("_b.off") == 0) | (edits >= 2))
    open_ = blocks.where(may)
    candidates = open_.join(tables.canonical, (F.col("_b.first") == F.substring("word", 1, 1)) & (F.col("_b.size") == F.length("word"))).where((edits > 0) | (F.col("_p") == F.col("word")))
    scored = candidates.withColumn("_s", native.similarity(F.col("_p"), F.col("word"))).where(F.col("_s") >= t)
    best = scored.groupBy(*found.columns).agg(F.max_by(F.struct("word", "_s"), F.struct("_s", (-F.col("_b.turn")).alias("turn"), (-F.col("ord")).alias("ord"))).alias("b"))
    return best.join(tables.keys, F.col("b.word") == F.col("key")).where("passes").select(*found.columns, *_ENTRY, *_hit("fuzzy", F.col("b._s")))


def cascade(found: DataFrame, tables: Tables) -> DataFrame:
    """Each form's verdict: of the tiers that hit it, the first. Tiers run once each, on all forms: those that an
    earlier tier has are few, and leaving them out by anti-joins would run the earlier tiers again for every later one."""
    left = not_safe(_fixed(found), tables)
    rest = not_exempt(left, tables)
    later = not_stopped(rest, tables)
    steps = [(exact, left), (normalized, rest), *([(transliterated, later)] if tables.config.transliteration else []), (partial, later), *([(fuzzy, later)] if tables.config.fuzzy else [])]
    every = None
    for rank, (step, forms_left) in enumerate(steps):
        hit = step(forms_left, tables).withColumn("_rank", F.lit(rank))
        every = hit if every is None else every.unionByName(hit)
    columns = [*_ENTRY, "match_type", "confidence"]
    first = every.groupBy(*found.columns).agg(F.min_by(F.struct(*columns), "_rank").alias("e"))
    return first.select(*found.columns, *(f"e.{c}" for c in columns))


def ngrams(occurrences: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """key, pos, phrase: windows of `size` words in a row, joined by a blank."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("pos")
    nexts = [F.lead("value", k).over(order) for k in range(1, size)]
    rows = occurrences.select(key, "pos", "value", *(c.alias(f"_{k}") for k, c in enumerate(nexts, 1)))
    return rows.where(F.col(f"_{size - 1}").isNotNull()).select(key, "pos", F.concat_ws(" ", "value", *(f"_{k}" for k in range(1, size))).alias("phrase"))


def phrase_hits(df: DataFrame, tables: Tables, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrases by their normal form, a document at a time: windows are slices of its own word array, so nothing is
    shuffled; a window is only normalised if its first word, where that is in its normal form, begins a phrase's key."""
    starts = sorted({k[:n] for k, *_ in tables.phrase_rows for n in range(1, len(k) + 1)})
    widths = sorted({row[-1] for row in tables.phrase_rows})
    rows = df.select(key, native.words(F.lower(text)).alias("_w"))
    windows = native.let(_likely(F.col("_w"), starts), lambda likely: F.flatten(F.array(*(_windows(F.col("_w"), likely, n) for n in widths))))
    found = rows.select(key, F.explode(windows).alias("_x")).select(key, F.col("_x.pos").alias("pos"), F.col("_x.phrase").alias("phrase"))
    keyed = found.withColumn("_key", native.normalize(F.col("phrase")))
    return keyed.join(tables.phrases, F.col("_key") == F.col("key")).where("passes").select(key, "pos", *_ENTRY, *_hit("phrase", 1.0))


def _likely(words: Column, starts: list[str]) -> Column:
    """Places of the words that may begin a phrase; looked for once for all widths."""
    one = {c: to for c, to in T.SINGLES.items() if len(to) == 1 and c.isalnum()}
    plain = lambda w: F.translate(w, "".join(one), "".join(one.values()))
    may = lambda w: w.isin(starts) | (w.rlike(_ODD) & (plain(w).isin(starts) | plain(w).rlike(r"[^a-z]|ph|vv|(.)\1\1") | F.contains(w, F.lit("13"))))
    return F.filter(F.transform(words, lambda w, i: F.when(may(w), i)), lambda i: i.isNotNull())


#: Words that translating, decoding and collapsing may change; all of those that aren't letters only.
_ODD = r"[^a-z]|ph|vv|([a-z])\1\1"


def _windows(words: Column, likely: Column, n: int) -> Column:
    fits = F.filter(likely, lambda i: i <= F.size(words) - n)
    return F.transform(fits, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("phrase")))
