"""Which plain words can have no part in any hit, told for many words at once.

Corpora have a long tail of words seen once or twice, which no memo holds, and a verdict on each costs many lookups.
Here the words that are new to a worker are put into one string, spelled as the tiers spell them by a few
replacements over the whole string, and looked for in sets. The answer errs on one side only: a word that is let
through has no verdict and begins no phrase; one that is held back may have, and takes the usual way.
"""

from __future__ import annotations

import re
from collections import defaultdict

from ..functions import tables as T
from .config import Config

#: Accented letters of one plain letter.
_ACCENTED = {c: to for c, to in T.SINGLES.items() if c.isalpha() and not c.isascii() and len(to) == 1 and c.upper().lower() == c}
_EDGES = re.escape("".join(c for c in T.EDGES if c not in T.APOSTROPHES))
_LETTERS = f"a-zA-Z{''.join(_ACCENTED)}{''.join(_ACCENTED).upper()}"
#: Signs after a word, and what they decode to.
_SIGNS = {"&": "&", "%": "%", "*": "", "$": "s", "!": "i"}
_PLAIN = re.compile(f"(?m)^([{_EDGES}]*([{_LETTERS}]{{2,}})(?:([{''.join(_SIGNS)}])(\\3*))?[{_EDGES}]*)$")
_AS_PLAIN, _DROPPED = tuple(_ACCENTED.items()), tuple((c, "") for c in _ACCENTED)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_TWICE = [(c * 2, c) for c in _ALPHABET]
_UNSETTLED = ("ph", "vv", *(c * 3 for c in _ALPHABET))  # what decoding and collapsing change
_VOWELS = (("aa", "a"), ("ee", "i"), ("oo", "u"))


def _replaced(text: str, pairs) -> str:
    for a, b in pairs:
        if a in text:
            text = text.replace(a, b)
    return text


class Sieve:
    def __init__(self, index, config: Config):
        self.config, self.patterns = config, tuple(index.partial)
        self.any_pattern = re.compile("|".join(map(re.escape, self.patterns))) if self.patterns else None
        self.words = frozenset(index.keys) | config.lowered()  # spellings that have, or stop, a verdict
        self.begins = self.words | (index.beginnings | T.ONE_WORD.keys() if config.phrases else frozenset())
        self.read = self.words | index.folded_beginnings
        every = (*self.words, *self.patterns)
        self.odd = frozenset(c for c in _SIGNS if any(c in x for x in every if c not in "*$!" or x.endswith(c)) or any(c * 3 in x or _SIGNS[c] * 3 in x for x in every if _SIGNS[c]))
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for other in dict.fromkeys(x for others in index.by_first.values() for x in others):
            self.by_size[len(other)].append(other)
        self.reaches: dict[int, tuple] = {}

    def _reach(self, n: int) -> tuple:
        """Of words of n letters, what a similar entry needs: beginnings and ends by their length (of two words one edit
        apart, the half without it is the same in both), and first letters where more edits are allowed."""
        heads, tails, first = defaultdict(set), defaultdict(set), set()
        for step, slack in ((0, 2), (-1, 1), (1, 1)):
            for size in range(max(1, n - slack), n + slack + 1):
                edits = int(max(n, size) * (1 - self.config.threshold))
                if abs(n - size) > edits or (step and edits < 2):
                    continue
                for other in self.by_size.get(size, ()):
                    if edits >= 2:
                        first.add(chr(max(0, ord(other[0]) - step)))
                    elif edits:
                        heads[size // 2].add(other[: size // 2])
                        tails[size - size // 2].add(other[size // 2 :])
        return tuple(heads.items()), tuple(tails.items()), first

    def _similar(self, word: str) -> bool:
        n = len(word)
        found = self.reaches.get(n)
        if found is None:
            found = self.reaches[n] = self._reach(n)
        heads, tails, first = found
        if first and word[0] in first:
            return True
        for k, some in heads:
            if word[:k] in some:
                return True
        for k, some in tails:
            if word[n - k :] in some:
                return True
        return False

    def _clean(self, words: list[str]) -> list[bool]:
        """Of lower-case words of letters (and a sign) those that are looked for in vain, however they are spelled."""
        low, held = "\n".join(words), set()
        accented = not low.isascii()
        dressed = (lambda text: _replaced(text, _AS_PLAIN)) if accented else lambda text: text

        def hold(text: str, needles, pattern: re.Pattern | None = None) -> None:
            """Words in which there is one of the needles."""
            if some := [x for x in needles if x in text]:
                for m in (pattern or re.compile("|".join(map(re.escape, some)))).finditer(text):
                    held.add(text.count("\n", 0, m.start()))

        def meet(text: str, known) -> None:
            """Words that are known."""
            own = text.split("\n")
            if not known.isdisjoint(own):
                held.update(k for k, w in enumerate(own) if w in known)

        plain = dressed(low)
        hold(plain, _UNSETTLED)
        for text in dict.fromkeys((plain, _replaced(plain, _TWICE), *((_replaced(low, _DROPPED),) if accented else ()))):
            hold(text, self.patterns, self.any_pattern)
            meet(text, self.begins)
        if accented:
            meet(low, self.begins)
        if self.config.transliteration or self.config.phrases:
            for text in dict.fromkeys((low, _replaced(low, T.PHONETIC), _replaced(low, _VOWELS))):
                hold(own := dressed(text), _UNSETTLED)
                meet(own, self.read)
                if own != text:
                    meet(text, self.read)
        similar = self._similar if self.config.fuzzy else lambda word: False
        return [k not in held and not similar(word) for k, word in enumerate(plain.split("\n"))]

    def passed(self, values: list[str]) -> list[str]:
        """Of segments of a folded text those that are a plain word, without or with a sign after it, without any part
        in a hit. The word and its sign, run together to two, are held against the lexicon by themselves."""
        found = _PLAIN.findall("\n".join(values))
        if not found:
            return []
        cores = "\n".join([core for _, core, _, _ in found]).lower().split("\n")
        signed = [k for k, x in enumerate(found) if x[2]]
        clean = self._clean([*cores, *(cores[k] + _SIGNS[found[k][2]] * (2 if found[k][3] else 1) for k in signed)])
        for at, k in enumerate(signed, len(cores)):
            clean[k] = clean[k] and clean[at] and found[k][2] not in self.odd
        return [x[0] for x, fine in zip(found, clean) if fine]
