import time

import pytest

from tamarack.lexicon import Phrase, Word, load
from tamarack.plans.config import Config
from tamarack.plans.scanner import Scanner, spoken, tokens


def found(text, scanner=Scanner(load())):
    return [(h.original, h.matched, h.match_type, round(h.confidence, 3)) for h in scanner.detect(text)]


@pytest.mark.parametrize("text, values", [("hello, world!", ["hello", "world"]), ("he'll go", ["he", "ll", "go"]), ("d'accord", ["d", "accord"]), ("qu'il", ["qu'il"]), ("a b c d", ["abcd"]), ("a b cd", ["a", "b", "cd"]), ("don’t", ["don", "t"])])
def test_tokens(text, values):
    assert [t.value for t in tokens(text)] == values
    assert all(t.value == text[t.start : t.end] or len(t.value) < t.end - t.start for t in tokens(text))


@pytest.mark.parametrize("text, words", [("you'll", ["you", "will"]), ("i'm", ["i", "am"]), ("mom's", ["mom", "s"]), ("he's", ["he", "is"]), ("won't", ["will", "not"]), ("didn't", ["did", "not"]), ("gonna", ["going", "to"]), ("I m", ["I", "m"])])
def test_spoken(text, words):
    assert [t.value for t in spoken(tokens(text), text)] == words


@pytest.mark.parametrize(
    "text, term, kind, confidence",
    [
        ("you idiot", "idiot", "exact", 1.0), ("id10t", "idiot", "normalized", 0.95), ("i d i o t", "idiot", "exact", 1.0), ("st.u.p.i.d", "stupid", "normalized", 0.9), ("(idiot)", "idiot", "exact", 1.0),
        ("ѕtupid", "stupid", "exact", 1.0), ("ｍｏｒｏｎ", "moron", "exact", 1.0), ("dumb@ss", "dumbass", "exact", 1.0), ("morooon", "moron", "normalized", 0.95), ("scoundrl", "scoundrel", "fuzzy", 0.889),
        ("xxidiotxx", "idiot", "normalized", 0.85), ("गधा", "gadha", "normalized", 0.9), ("imbécil", "imbécil", "exact", 1.0), ("MORON's", "moron", "exact", 1.0),
    ],
)
def test_hits(text, term, kind, confidence):
    assert [x[1:] for x in found(text)] == [(term, kind, confidence)]


@pytest.mark.parametrize("text", ["", "   ", None, "hello", "he'll", "SKU-B00B-42", "my_idiot_var", "drop dead gorgeous", "we get lost often", "you will pay attention", "3f2a91bc-idio", "shell", "600k"])
def test_clean(text):
    assert not found(text)


def test_phrases_and_context():
    assert found("you'll pay!") == [("you'll pay", "you will pay", "phrase", 1.0)]
    assert found("get, lost") == [("get, lost", "get lost", "phrase", 1.0)]
    assert found("ulloo ka patthaa")[0][1:] == ("ullu ka pattha", "phrase", 0.9)


def test_custom_phrase():
    own = Scanner(load().with_phrases(Phrase("launch the rockets", "en", "high", "threat", ("tomorrow",))))
    for text, hit in (("launch the rockets now", True), ("launch the rockets. Tomorrow we rest", True), ("launch the rockets Tomorrow", False)):
        assert bool(own.detect(text)) == hit


def test_positions_are_of_the_original():
    h = Scanner(load()).detect("😀 ｍｏｒｏｎ!")[0]
    assert (h.start, h.end, h.original) == (2, 7, "ｍｏｒｏｎ")


def test_config():
    lexicon = load()
    assert not found("idiot", Scanner(lexicon, Config(min_severity="medium")))
    assert not found("idiot", Scanner(lexicon, Config(languages=("fr",)))) and not found("idiot", Scanner(lexicon, Config(languages=())))
    assert not found("Idiot", Scanner(lexicon, Config(whitelist=("IDIOT",)))) and not found("shut up", Scanner(lexicon, Config(whitelist=("shut up",))))
    assert not found("scoundrl", Scanner(lexicon, Config(fuzzy=False))) and not found("shut up", Scanner(lexicon, Config(phrases=False)))
    assert not found("गधा", Scanner(lexicon, Config(transliteration=False)))


def test_last_canonical_and_first_spelling_win():
    own = load().with_words(Word("zorp", "en", "low", "insult", aliases=("idiot", "blarg")), Word("zorp", "fr", "high", "hate", aliases=("blarg",)))
    hits = Scanner(own).detect("zorp idiot blarg")
    assert [(h.matched, h.language) for h in hits] == [("zorp", "fr"), ("idiot", "en"), ("zorp", "en")]


@pytest.mark.parametrize("bad", [{"severity": "awful"}, {"category": "bad"}, {"word": " "}])
def test_validation(bad):
    with pytest.raises(ValueError):
        load().with_words(Word(**({"word": "x", "language": "en", "severity": "low", "category": "insult"} | bad)))
    with pytest.raises(TypeError):
        Config(whitelist=(1,))


@pytest.mark.parametrize("text", ["a" * 50_000, "(" * 50_000, "1" * 50_000, "a." * 25_000, "a'" * 25_000, "@" * 50_000])
def test_linear_time(text):
    began = time.time()
    Scanner(load()).detect(text)
    assert time.time() - began < 5
