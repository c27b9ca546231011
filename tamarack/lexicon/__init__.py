"""Lexicons: words, phrases and safe words, read from a JSON file whose path is a parameter.

The package ships a small starter lexicon of mild terms of its own; a full vocabulary is data, not code: point
load() at its file. A lexicon is immutable; with_words() and with_phrases() validate and return a new one.

File: {"words": [{word, normalized, language, severity, category, partial, aliases}],
       "phrases": [{phrase, language, severity, category[, not_followed_by, not_preceded_by, at_clause_end]}],
       "safe": {language or "*": [words that are innocent there]}}
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from functools import lru_cache

SEVERITIES = ("low", "medium", "high")
CATEGORIES = ("slur", "sexual", "insult", "hate", "threat", "drug", "other")
LANGUAGES = ("en", "hi-latn", "es", "fr", "de")  # the order packs come in
STARTER = os.path.join(os.path.dirname(__file__), "starter.json")


@dataclass(frozen=True)
class Word:
    word: str
    language: str
    severity: str
    category: str
    normalized: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    partial: bool = False


@dataclass(frozen=True)
class Phrase:
    phrase: str
    language: str
    severity: str
    category: str
    not_followed_by: tuple[str, ...] = ()
    not_preceded_by: tuple[str, ...] = ()
    at_clause_end: bool = False


def _checked(entry: Word | Phrase) -> Word | Phrase:
    named = entry.word if isinstance(entry, Word) else entry.phrase
    lists = (entry.normalized, entry.aliases) if isinstance(entry, Word) else (entry.not_followed_by, entry.not_preceded_by)
    flag = entry.partial if isinstance(entry, Word) else entry.at_clause_end
    if not isinstance(named, str) or not named.strip():
        raise ValueError("an entry needs a non-empty text")
    if entry.severity not in SEVERITIES:
        raise ValueError(f"severity {entry.severity!r} is none of {SEVERITIES}")
    if entry.category not in CATEGORIES:
        raise ValueError(f"category {entry.category!r} is none of {CATEGORIES}")
    if not isinstance(entry.language, str) or not entry.language:
        raise ValueError("an entry needs a language")
    if not isinstance(flag, bool):
        raise ValueError("a switch of an entry is true or false")
    for texts in lists:
        if not isinstance(texts, tuple) or not all(isinstance(x, str) for x in texts):
            raise ValueError("spellings and context words are lists of strings")
        if isinstance(entry, Phrase) and not all(x.strip() for x in texts):
            raise ValueError("a context word is empty")
    return entry


@dataclass(frozen=True)
class Lexicon:
    words: tuple[Word, ...]
    phrases: tuple[Phrase, ...]
    safe: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def languages(self) -> list[str]:
        have = dict.fromkeys(x.language for x in (*self.words, *self.phrases))
        return [x for x in LANGUAGES if x in have] + [x for x in have if x not in LANGUAGES]

    def scan(self, languages: tuple[str, ...] | None) -> tuple[list[Word], list[Phrase]]:
        """Entries of all languages, or of those listed, in the order listed; unknown ones give nothing."""
        chosen = self.languages() if languages is None else list(dict.fromkeys(languages))
        return [w for x in chosen for w in self.words if w.language == x], [p for x in chosen for p in self.phrases if p.language == x]

    def safe_words(self, languages: set[str]) -> frozenset[str]:
        """Words innocent anywhere, and those innocent in a language that has words here."""
        return frozenset(w for x, words in self.safe if x == "*" or x in languages for w in words)

    def with_words(self, *words: Word) -> Lexicon:
        return replace(self, words=(*self.words, *map(_checked, words)))

    def with_phrases(self, *phrases: Phrase) -> Lexicon:
        return replace(self, phrases=(*self.phrases, *map(_checked, phrases)))


def parse(told: dict) -> Lexicon:
    tuples = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
    words = tuple(_checked(Word(**tuples(x))) for x in told["words"])
    phrases = tuple(_checked(Phrase(**tuples(x))) for x in told["phrases"])
    return Lexicon(words, phrases, tuple((k, tuple(v)) for k, v in told.get("safe", {}).items()))


@lru_cache(8)
def load(path: str = STARTER) -> Lexicon:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))
