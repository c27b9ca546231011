"""What a user meets first: disguises that must be found and ordinary text that must not, with made-up terms of the
shapes that matter."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.functions import forms
from tamarack.functions import tables as T
from tamarack.lexicon import Lexicon, Phrase, Word, load
from tamarack.plans.config import Config
from tamarack.plans.scanner import Scanner, tokens


def word(text, language="en", **more):
    return Word(text, language, "high", "slur", **more)


OWN = Lexicon(
    (
        word("zorp"), word("blarg", partial=True), word("sneeb"), word("glimhole", aliases=("glimholes",)), word("vuckle", partial=True), word("zlig", partial=True), word("blore"), word("zoggot"), word("mimbo"),
        word("threebad", aliases=("3bad",)), word("azz"), word("qz", aliases=("q.z",)), word("phrumple"), word("tharkesh", "hi-latn"), word("zon", "fr"), word("drible", "fr"), word("zul", "fr"), word("puzy"), word("teta", "es"),
    ),
    (Phrase("launch the rockets", "en", "high", "threat", ("tomorrow",)), Phrase("you will sneeze", "en", "low", "threat"), Phrase("go zip", "en", "low", "insult", at_clause_end=True), Phrase("blue kot", "hi-latn", "low", "insult")),
    (("*", ("bbz",)), ("en", ("zon", "drible", "zlighting"))),
)


def found(text, scanner=Scanner(OWN)):
    return [h.matched for h in scanner.detect(text)]


@pytest.mark.parametrize(
    "text, term",
    [
        ("z0rp", "zorp"), ("bl@rg", "blarg"), ("$neeb", "sneeb"), ("sn33b", "sneeb"), ("g|imho|e", None), ("gl!mh0l3", "glimhole"), ("|>", None), ("bl4r9", "blarg"), ("\\/uckle", "vuckle"), ("phrumple", "phrumple"), ("frumple", None),
        ("z.o.r.p", "zorp"), ("z-o-r-p", "zorp"), ("z_o_r_p", "zorp"), ("S.N.3.E.B", "sneeb"), ("snee*b", "sneeb"), ("s*neeb", "sneeb"), ("zooooorp", "zorp"), ("sneeeeeb", "sneeb"), ("ZoRp", "zorp"), ("ZORP", "zorp"),
        ("z o r p", "zorp"), ("g l i m h o l e", "glimhole"), ("t h a r k e s h", "tharkesh"), ("zоrp", "zorp"), ("ｚｏｒｐ", "zorp"), ("𝐳𝐨𝐫𝐩", "zorp"), ("z​orp", "zorp"), ("zo­rp", "zorp"),
        ("z4rp", None), ("|3lore", "blore"), ("blor3", "blore"), ("5neeb", "sneeb"), ("zogg07", "zoggot"), ("mim80", "mimbo"), ("3bad", "threebad"), ("vuckle99", "vuckle"), ("q.z", "qz"), ("qz", "qz"), ("glimhoel", None), ("glimhle", "glimhole"),
    ],
)
def test_disguises(text, term):
    assert found(text)[:1] == ([term] if term else [])


#: Codes, quantities and labels; the lexicon of this test holds all that they could be read as.
CODES = [
    "6DU", "9DU", "N16 6DU", "N166DU", "LA83 3DB", "LA833DB", "N16", "HA9", "A55", "N1G 2W1", "J4P", "N5H1T3", "A60 P3D0", "600k", "900k views", "AB05", "10kg", "5H1790", "5H46", "ab33df5", "7bffb32abeed",
    "de95fb79-4227-86ab-eede-08c4e87a1465", "SKU-B00B-42", "SKU-6DU-22", "(6DU)", "6-DU", "422", "1337",
]


@pytest.mark.parametrize("code", CODES)
def test_codes_are_not_read_as_words(code):
    read = {forms.normalize(t.value) for t in tokens(code)}
    read |= {forms.decode(x.lower(), False) for x in read} | {forms.collapse(x, 2, 1) for x in read}
    plain = {x for x in read if len(x) >= 3 and not any(c.isdigit() for c in x)} - {t.value.lower() for t in tokens(code)}
    assert not found(code, Scanner(Lexicon(tuple(word(x, partial="-" not in code) for x in sorted(plain)), ())))


@pytest.mark.parametrize("text", ["zlighting12", "99zlighting", "zlighting7", "chars12", "bbz", "zon", "drible", "hello", "(or", "[or", "<or>", "#orp", "#or", "my_zorp_name", "puzhy", "theta", "thetas", "slt ça va", "привет", "καλημέρα", "class document"])
def test_ordinary_text(text):
    assert not found(text)


@pytest.mark.parametrize("text, start, end", [('"zorp"', 1, 5), ("(zorp)", 1, 5), ("><zorp", 2, 6), ("].zorp", 2, 6), ("hi ｚｏｒｐ all", 3, 7), ("oh 𝐳𝐨𝐫𝐩!", 3, 7), ("they zоrp dogs", 5, 9)])
def test_positions(text, start, end):
    h = Scanner(OWN).detect(text)[0]
    assert (h.start, h.end, h.original) == (start, end, text[start:end])


def test_words_safe_in_one_language_count_in_another():
    fr = Scanner(OWN, Config(languages=("fr",)))
    for text in ("zon", "drible", "(zon)", "><zon"):
        assert found(text, fr) and not found(text)
    assert not any(found("bbz", Scanner(OWN, Config(languages=(x,)))) for x in ("en", "fr", "es"))


def test_code_beside_a_disguise():
    assert found("Order N16 6DU shipped, what a z0rp service") == ["zorp"] and found("the 2nd z0rp") == ["zorp"]


@pytest.mark.parametrize(
    "text, hits",
    [
        ("launch the rockets now", 1), ("launch the rockets. Tomorrow we rest", 1), ("launch the rockets Tomorrow", 0), ("you'll sneeze", 1), ("youll sneeze", 1), ("you will, sneeze", 1), ("u will sneeze", 1), ("you sneeze", 0),
        ("go zip", 1), ("go zip!", 1), ("go zip line", 0), ("go zip\nline", 1), ("bluu kot", 0), ("bloo kot", 0), ("blue  kot", 1),
    ],
)
def test_phrases(text, hits):
    assert len(found(text)) == hits


PARTS = "the a I b c x of we you'll don't im u r 40 12 600k 6DU ab33df5 N16 café ｚｏｒｐ launch the rockets tomorrow go zip you will sneeze blue kot zorp blarg xxblargxx z0rp glimhle z.o.r.p q.z my_zorp_x (zorp) #or SKU-B00B-42 -- *** e.g. zorp's गधा".split()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 70))
def test_regions_lose_nothing(seed, n):
    """A text cut into regions has the hits of the text as a whole."""
    rng = random.Random(seed)
    text = " ".join(rng.choice(PARTS) if rng.random() < 0.5 else rng.choice(("plain", "word", "other", "of")) for _ in range(n))
    for own in (OWN, load()):
        scanner = Scanner(own)
        whole = scanner._within(forms.fold(text))
        assert [(h.start, h.end, h.matched, h.match_type) for h in scanner.detect(text)] == [(h.start, h.end, h.matched, h.match_type) for h in whole] and scanner.flagged(text) == bool(whole)


def test_tables():
    """Every sequence and every character, spelled out."""
    sequences = (
        (r"\/\/", "w"), (r"|\\|", "n"), ("/\\/\\", "n"), ("/-\\", "a"), ("|-|", "h"), ("|_|", "u"), (r"|\|", "n"), (r"/\/", "n"), ("><", "x"), ("}{", "x"), ("/\\", "a"), (r"\/", "v"), ("|)", "d"), ("|<", "k"), ("|3", "b"),
        ("|*", "p"), ("|o", "p"), ("|2", "r"), ("|=", "f"), ("|_", "l"), ("_|", "j"), ("/<", "k"), ("/2", "r"), ("()", "o"), ("[]", "d"), ("[)", "d"), ("0_", "q"), ("`/", "y"), ("~/", "z"), ("13", "b"), ("ph", "f"), ("vv", "w"), ("//", "n"),
    )
    assert len(sequences) == 33 and dict(sequences) == T.SEQUENCES
    for sequence, letter in sequences:
        assert forms.decode(sequence, False) == letter and forms.decode(f"e{sequence}e", False) == f"e{letter}e"
    singles = "0o 1i 2z 3e 4a 5s 6g 7t 8b 9g @a $s §s !i |i +t †t (c <c {c [c ^a #h * ×x ¡i €e £l ¥y äa áa àa âa ãa åa ëe ée èe êe ïi íi ìi îi öo óo òo ôo õo øo üu úu ùu ûu ñn çc ðd ßss æae œoe þth".split()
    assert {x[0]: x[1:] for x in singles} == T.SINGLES
    for x in singles:
        assert forms.decode(x[0], False) == x[1:]
    assert forms.normalize("/-\\ss") == "ass" and forms.normalize("/\\/\\o") == "no" and forms.normalize("a∅b") == "a∅b"
    assert forms.decode("|3 |2 /2 0_ 13 7", True) == "i3 i2 /2 0_ 13 7"
