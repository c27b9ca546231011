"""Detection, scoring, masking and reports over DataFrames.

detect() is one Arrow scan (plans.scanner) that adds an array of detections to each row: no shuffle, no join, a
memo of classified forms per worker; everything after it is built-in expressions over that array, so scores,
masks and flags cost no shuffle either. Works on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicon import CATEGORIES, SEVERITIES, Lexicon, Phrase, Word, load
from ..plans.config import MAX_CHARS, Config
from ..plans.scanner import Scanner
from ..ship import ship

HITS = "array<struct<start:int,end:int,original:string,matched:string,language:string,severity:string,category:string,match_type:string,confidence:double>>"
_FIELDS = ("start", "end", "original", "matched", "language", "severity", "category", "match_type", "confidence")
_KINDS = (pa.int32(), pa.int32(), *[pa.string()] * 6, pa.float64())

#: What a detection weighs in a score; repeated matches of one term beyond SPAM count as spam.
WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
SPAM, SPAM_FACTOR = 3, 1.5
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def quoted(name: str) -> Column:
    """A column by its name as it is, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def _scanner(lexicon: Lexicon, config: Config) -> Scanner:
    """In a worker: made once for each lexicon and configuration."""
    import sys

    made = sys.__dict__.setdefault("_tamarack_scanners", {})
    key = (lexicon, config)
    return made.get(key) or made.setdefault(key, Scanner(lexicon, config))


def _checked(text: str | None, strict: bool) -> str | None:
    if strict and text is not None and len(text) > MAX_CHARS:
        raise ValueError(f"a text is longer than {MAX_CHARS} characters")
    return text


def _hits(scanner: Scanner, texts: Iterable[str | None], strict: bool) -> pa.Array:
    found, offsets = [], [0]
    for text in texts:
        found += scanner.detect(_checked(text, strict))
        offsets.append(len(found))
    columns = [pa.array([getattr(h, name) for h in found], kind) for name, kind in zip(_FIELDS, _KINDS)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(_FIELDS)))


def hits(text: Column, lexicon: Lexicon, config: Config = Config()) -> Column:
    """A column of detections of a text column. Nulls and blank texts have none."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(lexicon, config)
        for column in columns:
            yield _hits(scanner, (x.as_py() for x in column), config.strict)

    return F.arrow_udf(run, HITS)(text)


def flagged(text: Column, lexicon: Lexicon, config: Config = Config()) -> Column:
    """Whether a text has any detection; a text is read no further than its first."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(lexicon, config)
        for column in columns:
            yield pa.array([scanner.flagged(_checked(x.as_py(), config.strict)) for x in column], pa.bool_())

    return F.arrow_udf(run, "boolean")(text)


def masked(text: Column, found: Column, mask: str = "*") -> Column:
    """text with every detection's characters replaced by the mask, which is repeated, whole, for each UTF-16 unit."""
    mask = mask if isinstance(mask, str) else "*"
    wide = lambda s: F.length(s) + F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]", ""))
    size = F.size(found)

    def piece(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(found, k - 1)["end"])
        end = F.when(k == size, F.length(text)).otherwise(F.get(found, k)["start"])
        gap = F.substring(text, start + 1, end - start)
        return F.when(k == size, gap).otherwise(F.concat(gap, F.repeat(F.lit(mask), wide(F.get(found, k)["original"]))))

    return F.when(text.isNull(), F.lit(None)).when(F.coalesce(size, F.lit(0)) <= 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), size), piece), ""))


def resolved(spans: Column) -> Column:
    """Of an array of structs with start, end and confidence those that a greedy pass keeps: by start, then by higher
    confidence, then by length; a span that begins before the last kept one ends goes."""
    ordered = F.array_sort(
        F.transform(spans, lambda x, i: F.struct(x["start"].alias("s"), (-x["confidence"]).alias("c"), (x["start"] - x["end"]).alias("l"), i.alias("i"), x.alias("x")))
    )
    start = F.struct(F.lit(-1).alias("free"), F.filter(spans, lambda x: F.lit(False)).alias("kept"))
    step = lambda a, y: F.when(y["s"] < a["free"], a).otherwise(F.struct(y["x"]["end"].alias("free"), F.concat(a["kept"], F.array(y["x"])).alias("kept")))
    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def _count(found: Column, test) -> Column:
    return F.size(F.filter(found, test)).cast("long")


class Engine:
    """A lexicon and a configuration; immutable. with_config(), with_words() and with_phrases() return new engines."""

    def __init__(self, lexicon: Lexicon | None = None, config: Config = Config()):
        self.lexicon, self.config = lexicon or load(), config

    def with_config(self, **changes) -> Engine:
        return Engine(self.lexicon, Config(**({f: getattr(self.config, f) for f in self.config.__dataclass_fields__} | changes)))

    def with_words(self, *words: Word) -> Engine:
        return Engine(self.lexicon.with_words(*words), self.config)

    def with_phrases(self, *phrases: Phrase) -> Engine:
        return Engine(self.lexicon.with_phrases(*phrases), self.config)

    def languages(self) -> list[str]:
        return self.lexicon.languages()

    # --- per row ----------------------------------------------------------------------------------------------

    def _prepare(self, spark: SparkSession) -> None:
        """Ships the sources and bounds the session's Arrow batches: texts are long, and a batch of the default number
        of them would fill a worker. The bounds stay set; they limit sizes only and change no result."""
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @staticmethod
    def _beside(df: DataFrame, **found: Column) -> DataFrame:
        """df with columns added; its own of the same names are replaced."""
        return df.select(*(quoted(c) for c in df.columns if c not in found), *(c.alias(name) for name, c in found.items()))

    def scan(self, df: DataFrame, text: str = "text", into: str = "detections") -> DataFrame:
        """df with an array of detections, and text_over_limit, whether the text is over the length limit; columns of
        these names are replaced."""
        self._prepare(df.sparkSession)
        over = F.coalesce(F.length(quoted(text)) > MAX_CHARS, F.lit(False))
        return self._beside(df, **{into: hits(quoted(text), self.lexicon, self.config), "text_over_limit": over})

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        """A row for each detection: df's columns but the text, then the detection's, with offsets in UTF-16 units too.
        Columns of df that are named as one of the detection's are left out."""
        self._prepare(df.sparkSession)
        names = [*_FIELDS, "utf16_start", "utf16_end"]
        keep = [c for c in df.columns if c != text and c not in names]
        one = _fresh(df, "_d")
        wide = lambda end: F.col(f"{one}.{end}") + F.length(F.regexp_replace(F.substring(quoted(text), F.lit(1), F.col(f"{one}.{end}")), r"[^\x{10000}-\x{10FFFF}]", ""))
        rows = df.select(*map(quoted, keep), quoted(text), F.explode(hits(quoted(text), self.lexicon, self.config)).alias(one))
        return rows.select(*map(quoted, keep), *(F.col(f"{one}.{f}").alias(f) for f in _FIELDS), wide("start").alias("utf16_start"), wide("end").alias("utf16_end"))

    def is_clean(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with is_clean, whether a text has no detection; a column of that name is replaced."""
        self._prepare(df.sparkSession)
        return self._beside(df, is_clean=~flagged(quoted(text), self.lexicon, self.config))

    def censor(self, df: DataFrame, text: str = "text", mask: str = "*", into: str = "censored") -> DataFrame:
        """df with the masked text; a column of that name is replaced."""
        found = _fresh(df, "_found")
        scanned = self._beside(df, **{found: hits(quoted(text), self.lexicon, self.config)})
        self._prepare(df.sparkSession)
        kept = [c for c in df.columns if c != into]
        return scanned.select(*map(quoted, kept), masked(quoted(text), F.col(found), mask).alias(into))

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with detections, text_over_limit, toxicity (0 to 1; null for a null text), categories, severities,
        repetition_spam, unique_matches and total_matches; columns of these names are replaced. Weights are summed over
        words, and times SPAM_FACTOR where a term repeats."""
        found = F.col("detections")
        scanned = self.scan(df, text)
        names = F.transform(found, lambda x: x["matched"])
        spam = F.exists(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) >= SPAM)
        weight = F.aggregate(found, F.lit(0.0), lambda a, x: a + sum((F.when(x["severity"] == s, F.lit(w)).otherwise(0.0) for s, w in WEIGHTS.items()), F.lit(0.0)))
        words = F.greatest(F.regexp_count(quoted(text), F.lit(r"\S+")), F.lit(1))
        toxicity = F.least(F.lit(1.0), weight / words * F.when(spam, SPAM_FACTOR).otherwise(1.0))
        kinds = F.array_distinct(F.transform(found, lambda x: x["category"]))
        return self._beside(
            scanned, toxicity=F.when(quoted(text).isNotNull(), toxicity),
            categories=F.map_from_entries(F.transform(F.array_sort(kinds), lambda c: F.struct(c, _count(found, lambda x: x["category"] == c)))),
            severities=F.struct(*(self._severity(found, s) for s in SEVERITIES)),
            repetition_spam=spam, unique_matches=F.size(F.array_distinct(names)).cast("long"), total_matches=F.size(found).cast("long"),
        )

    @staticmethod
    def _severity(found: Column, name: str) -> Column:
        return _count(found, lambda x: x["severity"] == name).alias(name)

    # --- reports ----------------------------------------------------------------------------------------------

    def audit(self, df: DataFrame, text: str = "text", top: int = 12) -> DataFrame:
        """Detections by match type, language and term: how many, and some of the surface forms; genuine
        inflections (one contains the other) are left out."""
        found = self.detect(df.select(quoted(text)), text)
        low, term = F.lower("original"), F.lower("matched")
        odd = found.where(~(F.contains(low, term) | F.contains(term, low)))
        forms = odd.groupBy("match_type", "language", "matched", low.alias("form")).agg(F.count(F.lit(1)).alias("n"))
        shown = F.array_join(F.slice(F.array_sort(F.collect_set("form")), 1, top), ", ")
        return forms.groupBy("match_type", "language", "matched").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("forms"), shown.alias("samples")).orderBy(F.desc("hits"), "match_type", "language", "matched")

    def report(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Detections by language, category and severity, with all subtotals."""
        return self.detect(df.select(quoted(text)), text).cube("language", "category", "severity").agg(F.count(F.lit(1)).alias("hits"))

    def evaluate(self, df: DataFrame, label: str, text: str = "text") -> DataFrame:
        """Confusion counts, precision, recall, F1 and accuracy of `any detection` against a 0/1 column."""
        known = df.where(quoted(label).isin(0, 1)).select(quoted(label).alias("y"), quoted(text).alias("text"))
        return confusion(self.is_clean(known).select("y", (~F.col("is_clean")).alias("f")))


def confusion(rows: DataFrame) -> DataFrame:
    """From columns y (0 or 1) and f (flagged)."""
    tp, fp, fn, tn = (F.count_if((F.col("y") == y) & (F.col("f") == F.lit(f))) for y, f in ((1, True), (0, True), (1, False), (0, False)))
    counts = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    t, p, n, u = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select("tp", "fp", "fn", "tn", share(t, t + p).alias("precision"), share(t, t + n).alias("recall"), share(2 * t, 2 * t + p + n).alias("f1"), share(t + u, t + p + n + u).alias("accuracy"))


def register(spark: SparkSession, engine: Engine) -> None:
    """SQL functions profanity_hits, profanity_count, profanity_censor, profanity_score, is_clean and text_normalize,
    and the table function detect_terms(text)."""
    from pyspark.sql.functions import udtf

    from ..functions import forms

    ship(spark)
    lexicon, config = engine.lexicon, engine.config

    def scanner() -> Scanner:
        return _scanner(lexicon, config)

    def over(kind: str, one):
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = scanner()
            arrow = {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}[kind]
            for column in columns:
                yield pa.array([one(own, x) for x in column.to_pylist()], arrow)

        return F.arrow_udf(run, kind)

    def censored(own: Scanner, text: str | None) -> str | None:
        out, at = [], 0
        for h in own.detect(text):
            out += [text[at : h.start], "*" * (len(h.original.encode("utf-16-le")) // 2)]
            at = h.end
        return None if text is None else "".join(out) + text[at:]

    def scored(own: Scanner, text: str | None) -> float | None:
        if text is None:
            return None
        found = own.detect(text)
        names = [h.matched for h in found]
        spam = any(names.count(n) >= SPAM for n in set(names))
        return min(1.0, sum(WEIGHTS[h.severity] for h in found) / max(1, len(text.split())) * (SPAM_FACTOR if spam else 1.0))

    def listed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _hits(scanner(), column.to_pylist(), config.strict)

    spark.udf.register("profanity_hits", F.arrow_udf(listed, HITS))
    spark.udf.register("profanity_count", over("int", lambda own, t: len(own.detect(t))))
    spark.udf.register("profanity_censor", over("string", censored))
    spark.udf.register("profanity_score", over("double", scored))
    spark.udf.register("is_clean", over("boolean", lambda own, t: not own.flagged(t)))
    spark.udf.register("text_normalize", over("string", lambda own, t: None if t is None else forms.normalize(t)))

    class DetectTerms:
        def eval(self, text: str):
            for h in scanner().detect(text):
                yield h.start, h.end, h.original, h.matched, h.language, h.severity, h.category, h.match_type, h.confidence

    kind = "start int, `end` int, original string, matched string, language string, severity string, category string, match_type string, confidence double"
    spark.udtf.register("detect_terms", udtf(DetectTerms, returnType=kind))


__all__ = ["CATEGORIES", "Config", "Engine", "HITS", "SEVERITIES", "confusion", "hits", "masked", "register", "resolved"]
