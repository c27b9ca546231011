"""Queries on texts and sizes that the small tables don't hold."""

import random

import duckdb
import pytest

import __spark_entry__
from tamarack.lexicon import load
from tamarack.operators import tiers
from tamarack.plans.config import Config
from tamarack.plans.scanner import WORDY, Scanner


def _agree(spark, tmp_path, name, texts):
    """A query's rows over these texts, and those of its SQL."""
    rows = [(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect()), key=repr), sorted(told, key=repr)


def test_phrases_in_their_own_words(spark, tmp_path):
    ours, told = _agree(spark, tmp_path, "phrase_context_hits", ["see thea nd go", "See The and go", "tot he end. oft he", "of the x, 0f the", "of the thea nd", "run to the"])
    assert ours == told and len(ours) == 4


def _forms(n: int) -> list[str]:
    """Terms of the lexicon with letters taken, changed and put in, and signs around them; and plain words."""
    rng, lexicon = random.Random(1), load()
    terms = [x for w in lexicon.words for x in (w.word, *w.normalized, *w.aliases)] + [x for p in lexicon.phrases for x in p.phrase.split()]
    letters, out = "abcdefghijklmnopqrstuvwxyzhhaeiouéèçüñß", set()
    while len(out) < n:
        word = list(rng.choice(terms)) if rng.random() < 0.7 else rng.choices(letters, k=rng.randint(1, 12))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choices((*letters, "0", "$", "'", "-"), k=rng.randint(0, 1))
        word = rng.choice(("", "", "(", "ab")) + "".join(word) + rng.choice(("", "", ".", ",", "!!", "***", "&&&", "$", "s"))
        out.add(rng.choice((str, str.upper, str.title))(word))
    return sorted(x for x in out if x and not set(x) & set(" \t\n"))


@pytest.mark.parametrize("config", [{}, {"threshold": 0.7}, {"phrases": False, "transliteration": False}, {"whitelist": ("idiots", "crap"), "min_severity": "high"}])
def test_sieve_passes_no_word_that_can_hit(config):
    scanner, forms_ = Scanner(load(), Config(**config)), _forms(6000)
    passed = [v for k in range(0, len(forms_), 50) for v in scanner.sieve.passed(forms_[k : k + 50])]
    assert len(passed) > 500 and all(scanner._kind(v) == WORDY for v in passed)


def test_new_words_are_not_classified_one_by_one():
    """Words seen once, which no memo holds, and words that begin a phrase that isn't there, take no verdicts and no memory."""
    rng = random.Random(2)
    words = ["".join(rng.choices(("on", "re", "queux", "être", "an", "hou", "tion"), k=rng.randint(4, 6))) + rng.choice(("", ",", "***")) for _ in range(4000)]
    scanner = Scanner(load())
    assert scanner.detect(" was ".join(words)) == []
    assert len(scanner.memo.new) < 200 and len(scanner.kinds.new) > 2000
    assert [h.matched for h in scanner.detect(" was ".join(words) + " was (te) of, space")] == ["waste of space"]


def test_phrase_beginnings_are_looked_for_once_for_all_widths(spark):
    """The regular expressions over every word, the dearest part of dedupe_spans and phrase_hits."""
    docs = spark.createDataFrame([(1, "go to hell, shut 1t up; sshhut up waste of space phut")], "doc_id long, text string")
    found = tiers.phrase_hits(docs, tiers.Tables(spark, load()))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("ph|vv|(.)") == 1
    assert sorted((r.pos, r.matched) for r in found.collect()) == [(0, "go to hell"), (8, "waste of space")]


def test_ngram_profile_sends_each_place_once(spark, tmp_path):
    """One shuffle of a row for each word's place, whatever the number of sizes; then only totals."""
    ours, told = _agree(spark, tmp_path, "ngram_profile", ["a b a b c", "one", "", None, "The the THE end of the end", "x y"])
    assert ours == told and [r[0] for r in ours] == [2, 3, 4]
    plan = __spark_entry__.queries()["ngram_profile"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_tiers_work_on_distinct_forms(spark):
    """No tier's condition is worked out for every occurrence."""
    found = __spark_entry__.queries()["form_verdicts"](spark, "/root/testdata/sf0.001")
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    words = [k for k, line in enumerate(lines) if "Generate posexplode(regexp_extract_all" in line]
    assert words and not any("length(lower(" in lines[k - 1] or "LeftAnti" in lines[k - j] for k in words for j in (1, 2, 3))
