import pytest
from pyspark.sql import functions as F

from tamarack.lexicon import load
from tamarack.operators import tiers
from tamarack.operators.moderation import Engine, confusion, register, resolved
from tamarack.plans.config import Config
from tamarack.plans.scanner import Scanner
from tamarack.sources import texts


@pytest.fixture(scope="module")
def engine():
    return Engine()


def test_detect_and_wide_offsets(spark, engine):
    rows = engine.detect(texts(spark, "😀 idiot", None, "", "nice")).collect()
    assert [(r.doc_id, r.start, r.end, r.utf16_start, r.utf16_end) for r in rows] == [(0, 2, 7, 3, 8)]


def test_score(spark, engine):
    rows = engine.score(texts(spark, "idiot moron go home now", None, "", "idiot idiot idiot x")).orderBy("doc_id").collect()
    assert [None if r.toxicity is None else round(r.toxicity, 4) for r in rows] == [0.18, None, 0.0, 0.3375]
    assert rows[0].categories == {"insult": 2} and tuple(rows[0].severities) == (1, 1, 0)
    assert [r.repetition_spam for r in rows] == [False, False, False, True] and [r.unique_matches for r in rows] == [2, 0, 0, 1]


def test_censor(spark, engine):
    rows = engine.censor(texts(spark, "you idiot, you moron", "😀 ｍｏｒｏｎ", None, "fine")).orderBy("doc_id").collect()
    assert [r.censored for r in rows] == ["you *****, you *****", "😀 *****", None, "fine"]
    assert engine.censor(texts(spark, "idiot"), mask="#").first().censored == "#####"


def test_clean_audit_report_evaluate(spark, engine):
    df = texts(spark, "idiot", "fine", "scoundrl")
    assert [r.is_clean for r in engine.is_clean(df).orderBy("doc_id").collect()] == [False, True, False]
    assert [(r.match_type, r.matched, r.samples) for r in engine.audit(df).collect()] == [("fuzzy", "scoundrel", "scoundrl")]
    assert engine.report(df).where("language is null and category is null and severity is null").first().hits == 2
    row = engine.evaluate(df.withColumn("y", F.lit(1)), "y").first()
    assert (row.tp, row.fn, row.precision) == (2, 1, 1.0)
    assert confusion(spark.createDataFrame([], "y int, f boolean")).first().precision is None


def test_empty_table_and_other_columns(spark, engine):
    df = spark.createDataFrame([], "doc_id long, text string, start string, detections int")
    assert engine.score(df).count() == 0 and engine.scan(df).count() == 0


CLASHES = "text string, start string, `end` string, language string, detections string, text_over_limit string, toxicity string, severities string, censored string, is_clean string, _found string, _d string, `a.b` string"


@pytest.mark.parametrize("method, made", [("scan", {"detections", "text_over_limit"}), ("detect", None), ("score", {"detections", "text_over_limit", "toxicity", "severities"}), ("censor", {"censored"}), ("is_clean", {"is_clean"})])
def test_columns_of_clashing_names(spark, engine, method, made):
    """Result columns replace those of their names; every other column stays as it is."""
    frame = spark.createDataFrame([("you idiot", *["own"] * 12), (None, *["own"] * 12)], CLASHES)
    got = getattr(engine, method)(frame)
    rows = got.collect()
    assert len(got.columns) == len(set(got.columns)) and len(rows) == (1 if made is None else 2)
    made = {"text", "start", "end", "language"} if made is None else made
    for name in set(frame.columns) - made - {"text"}:
        assert {r[name] for r in rows} == {"own"}, name
    assert all(r[name] != "own" for r in rows for name in made if name in got.columns)


def test_text_columns_with_dots(spark, engine):
    frame = spark.createDataFrame([("you idiot", 1)], "`my.text` string, y int")
    assert engine.censor(frame, "my.text").first().censored == "you *****" and not engine.is_clean(frame, "my.text").first().is_clean
    assert engine.detect(frame, "my.text").first().matched == "idiot" and engine.score(frame, "my.text").first().total_matches == 1
    assert engine.evaluate(frame, "y", "my.text").first().tp == 1


def test_strict(spark, engine):
    long = texts(spark, "a " * 60_000)
    assert engine.scan(long).first().text_over_limit
    with pytest.raises(Exception, match="longer"):
        engine.with_config(strict=True).scan(long).collect()


def test_sql(spark, engine):
    register(spark, engine)
    texts(spark, "you idiot", "fine").createOrReplaceTempView("t")
    rows = spark.sql("select profanity_count(text) n, is_clean(text) c, profanity_censor(text) m, profanity_score(text) s, text_normalize('h3ll0') x from t order by doc_id").collect()
    assert [(r.n, r.c, r.m, round(r.s, 2), r.x) for r in rows] == [(1, False, "you *****", 0.15, "hello"), (0, True, "fine", 0.0, "hello")]
    assert spark.sql("select profanity_hits('you idiot')[0].matched m").first().m == "idiot"
    assert spark.sql("select t2.matched from t, lateral detect_terms(text) t2").collect()[0].matched == "idiot"


def test_resolved(spark):
    df = spark.sql("select array(named_struct('start', 5, 'end', 9, 'confidence', 1.0D), named_struct('start', 0, 'end', 6, 'confidence', 0.8D), named_struct('start', 0, 'end', 4, 'confidence', 0.9D)) s")
    assert [(x["start"], x["end"]) for x in df.select(resolved(F.col("s")).alias("r")).first().r] == [(0, 4), (5, 9)]


def test_tiers_agree_with_the_scanner(spark):
    lexicon = load()
    words = ["idiot", "idi0t", "morooon", "xxidiotxx", "scoundrl", "hello", "shell", "imbecille", "stoopid", "blockheadz", "degenerat", "kamena", "b00k"]
    tables = tiers.Tables(spark, lexicon)
    df = spark.createDataFrame([(w, 1) for w in words], "value string, n int")
    joined = {r.value: (r.matched, r.match_type, round(r.confidence, 6)) for r in tiers.cascade(df, tables).collect()}
    scanner = Scanner(lexicon)
    for w in words:
        v = scanner.verdict(w, True, False)
        if v is None or v[0].language != "hi-latn":
            assert joined.get(w) == (None if v is None else (v[0].word, v[1], round(v[2], 6))), w


def test_tiers_agree_on_hindi_and_folded_forms(spark):
    lexicon = load()
    words = ["gadha", "gaddhaa", "गधा", "निकम्मा", "कमीना", "उल्लू", "काम", "bewakooph", "nikaamma", "ｍｏｒｏｎ", "ідiоt", "mоrоn", "idi\u0301ot", "xxidıotxx", "crétin", "īdiot", "\U0001d426oron", "idi0t", "id1ot", "morooon", "scoundrl", "कमीने", "ullu", "kamiina", "नमस्ते"]
    df = spark.createDataFrame([(w, 1) for w in words], "value string, n int")
    for config in (Config(), Config(transliteration=False), Config(whitelist=("kamina", "idiot")), Config(whitelist=("ullu",), fuzzy=False), Config(languages=("en",))):
        joined = {r.value: (r.matched, r.match_type, round(r.confidence, 6)) for r in tiers.cascade(df, tiers.Tables(spark, lexicon, config)).collect()}
        scanner = Scanner(lexicon, config)
        told = {w: (v[0].word, v[1], round(v[2], 6)) for w in words if (v := scanner.verdict(w, True, False))}
        assert joined == told, config
        assert config != Config() or {"गधा", "निकम्मा", "कमीना", "ｍｏｒｏｎ"} <= set(joined)


def test_ngrams(spark):
    lines = {1: "a b c d e a b", 2: "a b", 3: "x", 4: "", 5: "b a b a b a"}
    words = tiers.tokens(spark.createDataFrame(list(lines.items()), "doc_id long, text string"))
    for size in (2, 3, 4, 5):
        told = [(d, k, " ".join(w[k : k + size])) for d, t in lines.items() for w in [t.split()] for k in range(len(w) - size + 1)]
        assert sorted(tuple(r) for r in tiers.ngrams(words, size).collect()) == sorted(told), size


def test_stream(spark, engine, tmp_path):
    texts(spark, "idiot", "fine").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = engine.detect(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("found").count() == 1


def test_entry_has_sql_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
