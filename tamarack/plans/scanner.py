"""The row-local scanner: one text in, its detections out.

Plain Python over a compiled lexicon; verdicts on words and segments depend on their surface form alone, so a
worker keeps them in a bounded memo and classifies each form once. Most segments can have no part in any hit,
wherever they stand: a text is cut into regions around those that can, and only regions are tokenised and matched.
Words new to a worker are told many at once (sieve); few are left to be classified one by one.
Runs inside an Arrow UDF, without a shuffle, and so on streams too. operators.tiers has the same lookups as joins,
for work over whole corpora.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

from ..functions import forms, script
from ..functions import tables as T
from ..lexicon import SEVERITIES, Lexicon, Phrase, Word
from .config import Config
from .sieve import Sieve

HINDI = "hi-latn"
MEMO = 50_000  # entries of a memo's generation
LONG = 64  # characters; longer segments are matched every time
#: Kinds of segments: without a word, with words, with a word of one letter, one word (or one letter) that begins a
#: phrase and has no other part in a hit, able to have part in a hit.
INERT, WORDY, LETTER, BEGINS, BEGINS_LETTER, ACTIVE = range(6)
_TOKEN = re.compile(f"[{T.WORD}]+(?:[{T.APOSTROPHES}][{T.LATIN}]{{1,20}})?")
_ELISION = re.compile(f"([A-Za-z])[{T.APOSTROPHES}](.+)", re.DOTALL)
_CONTRACTION = re.compile(f"([A-Za-z]{{2,}})[{T.APOSTROPHES}](ll|d|ve|re|s|m|t)", re.IGNORECASE)
_SEGMENT = re.compile(f"[^{T.BLANK}]+")
_GAP = re.compile(f"[{T.BLANK}]+")
_JOINED = re.compile(f"[{T.BLANK}{T.APOSTROPHES}]*")
_PARTS = re.compile(r"[\W_]+")
_DIGIT = re.compile("[0-9]")


# --- tokens ---------------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Token:
    value: str
    start: int
    end: int
    segment: int = -1
    literal: bool = False
    hexadecimal: bool = False


def tokens(text: str) -> list[Token]:
    """Words with elisions and contractions split off, and spelled-out words put together."""
    found: list[Token] = []
    for m in _TOKEN.finditer(text):
        value, start = m[0], m.start()
        pieces = [(value, start)]
        if any(c in value for c in T.APOSTROPHES):
            if cut := _ELISION.fullmatch(value):
                pieces = [(cut[1], start), (cut[2], start + 2)]
            pieces = [x for piece in pieces for x in _contracted(*piece)]
        found += [Token(v, s, s + len(v)) for v, s in pieces]
    return _spelled(found, text)


def _contracted(value: str, start: int) -> list[tuple[str, int]]:
    cut = _CONTRACTION.fullmatch(value)
    return [(cut[1], start), (cut[2], start + len(cut[1]) + 1)] if cut else [(value, start)]


def _spelled(found: list[Token], text: str) -> list[Token]:
    """Three or more single letters in a row, with nothing but blanks between them, become one word."""
    single = [t.end - t.start == 1 and t.value.isascii() and t.value.isalpha() for t in found]
    out, at = [], 0
    while at < len(found):
        end = at + 1
        while single[at] and end < len(found) and single[end] and _GAP.fullmatch(text, found[end - 1].end, found[end].start):
            end += 1
        if end - at >= 3:
            out.append(Token("".join(t.value for t in found[at:end]), found[at].start, found[end - 1].end))
        else:
            out += found[at:end]
        at = end
    return out


def stripped(value: str) -> tuple[str, int]:
    """A segment without punctuation at its edges, and how much went before it."""
    tail = value.lstrip(T.EDGES)
    return tail.rstrip(T.EDGES), len(value) - len(tail)


def in_code(segments: list[str], k: int) -> bool:
    """Whether the digits of segment k belong to a longer code: joined parts, or a short code before it."""
    if not _DIGIT.search(segments[k]):
        return False
    parts = [p for p in _PARTS.split(stripped(segments[k])[0]) if len(p) >= 2]
    digits = [_DIGIT.search(p) is not None for p in parts]
    if any(digits[j] and sum(digits) > 1 and ((p.isascii() and p.isdigit()) or forms.looks_like_code(p)) for j, p in enumerate(parts)):
        return True
    before = stripped(segments[k - 1])[0] if k else ""
    return bool(before) and before[0].isalpha() and forms.looks_like_code(before) and len(forms.shape(before)[0]) <= 4


def snake_case(segment: str) -> bool:
    parts = [p for p in segment.split("_") if p]
    return "_" in segment and len(parts) > 1 and any(len(p) >= 2 for p in parts)


@dataclass(slots=True)
class Spoken:
    """A word of the stream with contractions spelled out; source: its token's index."""

    value: str
    start: int
    end: int
    source: int
    rewritten: bool


def _pair(first: str, second: str) -> tuple[str, str] | None:
    if second in T.SUFFIXES:
        return first, T.SUFFIXES[second]
    if second == "m":
        return (first, "am") if first == "i" else None
    if second == "s":
        return (first, "is") if first in T.IS_AFTER else None
    if second == "t" and len(first) >= 2 and first.endswith("n"):
        return T.NOT_AFTER.get(first, first[:-1]), "not"
    return None


def spoken(found: list[Token], text: str) -> list[Spoken]:
    out: list[Spoken] = []
    k = 0
    while k < len(found):
        t = found[k]
        after = found[k + 1] if k + 1 < len(found) else None
        pair = _pair(t.value.lower(), after.value.lower()) if after and after.start == t.end + 1 and text[t.end] in T.APOSTROPHES else None
        if pair:
            out.append(Spoken(pair[0], t.start, t.end, k, pair[0] != t.value.lower()))
            out.append(Spoken(pair[1], after.start, after.end, k + 1, True))
            k += 2
            continue
        whole = T.ONE_WORD.get(t.value.lower()) if len(t.value) <= 8 else None
        out += [Spoken(w, t.start, t.end, k, True) for w in whole.split()] if whole else [Spoken(t.value, t.start, t.end, k, False)]
        k += 1
    return out


# --- index ----------------------------------------------------------------------------------------------------


@dataclass
class Context:
    """What around a phrase cancels it."""

    after: list[list[str]]
    before: list[list[str]]
    at_end: bool
    key: object


@dataclass
class Index:
    keys: dict[str, Word] = field(default_factory=dict)
    by_first: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    partial: dict[str, Word] = field(default_factory=dict)
    phrases: dict[str, list[Phrase]] = field(default_factory=lambda: defaultdict(list))
    folded: dict[str, list[Phrase]] = field(default_factory=lambda: defaultdict(list))
    folded_widths: set[int] = field(default_factory=set)
    widest: int = 2
    first_words: set[str] = field(default_factory=set)
    beginnings: set[str] = field(default_factory=set)
    folded_beginnings: set[str] = field(default_factory=set)
    contexts: dict[Phrase, Context] = field(default_factory=dict)
    safe: frozenset[str] = frozenset()


def _word_key(language: str):
    return script.phrase_fold if language == HINDI else forms.plain_key


def build(lexicon: Lexicon, languages: tuple[str, ...] | None) -> Index:
    words, phrases = lexicon.scan(languages)
    index = Index(safe=lexicon.safe_words({w.language for w in words}))
    canonical = {w.word.lower(): w for w in words}  # the last of a spelling
    for w in words:  # other spellings go to the first that has them
        for other in (*w.normalized, *w.aliases):
            index.keys.setdefault(other.lower(), w)
        low = w.word.lower()
        index.by_first[low[:1]].append(low)
        if w.partial and len(pattern := forms.normalize(low)) >= 3:
            index.partial.setdefault(pattern, w)
    index.keys |= canonical
    for p in phrases:
        own = tokens(p.phrase)
        told = spoken(own, p.phrase)
        for key in dict.fromkeys([forms.normalize(p.phrase), *([forms.normalize(" ".join(t.value for t in told))] if any(t.rewritten for t in told) else [])]):
            index.phrases[key].append(p)
            index.beginnings.update(key[:n] for n in range(1, len(key) + 1))
        index.widest = max(index.widest, len(own), len(told))
        index.first_words |= {forms.normalize(x[0].value) for x in (own, told) if x}
        if p.at_clause_end or p.not_followed_by or p.not_preceded_by:
            key = _word_key(p.language)
            sequences = lambda texts: [s for x in texts if (s := [key(t.value) for t in spoken(tokens(x), x)])]
            index.contexts[p] = Context(sequences(p.not_followed_by), sequences(p.not_preceded_by), p.at_clause_end, key)
        if p.language == HINDI and (folded := "".join(map(script.phrase_fold, p.phrase.split()))):
            index.folded[folded].append(p)
            index.folded_beginnings.update(folded[:n] for n in range(1, len(folded) + 1))
            index.folded_widths.add(len(p.phrase.split()))
    return index


# --- scanner --------------------------------------------------------------------------------------------------


class Memo:
    """Bounded: a full generation becomes the old one, and what is asked for again moves to the new one."""

    def __init__(self, make, limit: int = MEMO):
        self.make, self.limit, self.new, self.old = make, limit, {}, {}

    def get(self, key):
        found = self.new.get(key, self)
        if found is self:
            found = self.old.get(key, self)
            if found is self:
                found = self.make(key)
            self.put(key, found)
        return found

    def put(self, key, found) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = found


def _shortened(word: str) -> set[str]:
    """A word and what is left of it without one letter."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


@dataclass(slots=True)
class Hit:
    start: int
    end: int
    original: str
    matched: str
    language: str
    severity: str
    category: str
    match_type: str
    confidence: float


class Scanner:
    def __init__(self, lexicon: Lexicon, config: Config = Config()):
        self.index, self.config = build(lexicon, config.languages), config
        self.white, self.least = config.lowered(), SEVERITIES.index(config.min_severity)
        self.allowed = None if config.languages is None else set(config.languages)
        self.any_partial = re.compile("|".join(map(re.escape, self.index.partial))) if self.index.partial else None
        sequences = [x for c in self.index.contexts.values() for x in (*c.after, *c.before)]
        self.margin = self.index.widest + max(map(len, sequences), default=0) + 3  # words around an active segment that its hits can depend on
        self.near: dict[tuple[int, int], list[tuple[int, str]]] = defaultdict(list)
        self.shortened: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for letter, others in self.index.by_first.items():
            for order, other in enumerate(others):
                self.near[(ord(letter or "\0"), len(other))].append((order, other))
                for key in _shortened(other):
                    self.shortened[key].append((order, other))
        self.sieve = Sieve(self.index, config)
        self.memo, self.starts, self.kinds = Memo(lambda key: self._verdict(*key)), Memo(lambda key: self._beginning(*key)), Memo(self._kind)

    # verdicts: (entry, match type, confidence) of a surface form

    def _passes(self, entry: Word | Phrase | None) -> bool:
        return entry is not None and SEVERITIES.index(entry.severity) >= self.least and (self.allowed is None or entry.language in self.allowed)

    def _look_up(self, key: str, literal: bool) -> Word | None:
        """Spellings with digits are out of reach where digits are meant as such."""
        found = None if literal and _DIGIT.search(key) else self.index.keys.get(key)
        return found if self._passes(found) else None

    def _innocent_inside(self, low: str) -> bool:
        core = low.strip("0123456789")
        return core != low and (core in self.index.safe or core in self.white)

    def _contains(self, variant: str) -> Word | None:
        """The pattern that ends first in a variant, the longest of those, other than the variant itself."""
        if len(variant) < 4 or self.any_partial is None or not self.any_partial.search(variant):
            return None
        ends = []
        for pattern, entry in self.index.partial.items():
            if pattern != variant and (at := variant.find(pattern)) >= 0 and self._passes(entry):
                ends.append((at + len(pattern), -len(pattern), entry))
        return min(ends, key=lambda x: x[:2])[2] if ends else None

    def _nearest(self, word: str, length: int) -> tuple[Word, float] | None:
        """The most similar canonical word; its entry has to pass, no other is tried. Words of the same first letter
        go before those of its neighbours, and then in the lexicon's order."""
        threshold, best = self.config.threshold, (0.0, 0, 0, "")
        one_edit = None
        for turn, (step, slack) in enumerate(((0, 2), (-1, 1), (1, 1))):
            for size in range(length - slack, length + slack + 1):
                edits = int(max(len(word), size) * (1 - threshold))
                if abs(len(word) - size) > edits or (step and edits < 2):
                    continue
                if edits < 2:  # words within one edit are equal after a letter of each, at most, is left out
                    if one_edit is None:
                        one_edit = {x for key in _shortened(word) for x in self.shortened.get(key, ())}
                    others = [x for x in one_edit if len(x[1]) == size and x[1][:1] == word[:1] and (edits or x[1] == word)]
                else:
                    others = self.near.get((ord(word[0]) + step, size), ())
                for order, other in others:
                    score = 1 - forms.levenshtein(word, other) / max(len(word), size)
                    if score >= threshold and (score, -turn, -order) > best[:3]:
                        best = (score, -turn, -order, other)
        entry = self.index.keys.get(best[3]) if best[3] else None
        return (entry, best[0]) if self._passes(entry) else None

    def _verdict(self, value: str, in_word: bool, literal: bool) -> tuple | None:
        """Of a word (a token) or of a segment without its edges; the tiers in their order, the first that holds."""
        low = value.lower()
        if low in self.index.safe or (in_word and low in self.white) or (literal and self._innocent_inside(low)):
            return None
        edge = not literal and forms.has_edge_digits(value)
        later = literal or edge
        exempt = edge and self._innocent_inside(low)
        if low not in self.white and (found := self._look_up(low, literal)):
            return found, "exact", 1.0
        if script.has_devanagari(low) and any(x in self.white or x in self.index.safe for x in script.romanisations(low)):
            return None
        rewritten = (forms.normalize(value),) if edge else forms.variants(value, literal)
        for variant in rewritten:
            if variant in self.white:
                return None
            if len(variant) < 3 and variant != low:
                continue
            if found := self._look_up(variant, literal):
                return found, "normalized", 0.95 if in_word else 0.9
            if not in_word and not edge and (found := self._contains(variant)):
                return found, "normalized", 0.8
        if exempt:
            return None
        if in_word and self.config.transliteration:
            for reading in script.transliterations(value):
                key = forms.normalize(reading, later)
                if len(key) >= 3 or key == low:
                    found = self._look_up(key, literal)
                    if found and found.language == HINDI:
                        return found, "normalized", 0.9
        if in_word or edge:
            for variant in forms.variants(value, later):
                if found := self._contains(variant):
                    return found, "normalized", 0.85 if in_word else 0.8
        if self.config.fuzzy:
            plain = forms.normalize(low if in_word else value, later)
            length = len(low) if in_word else len(plain)
            if length >= 3 and plain and (best := self._nearest(plain, length)):
                return best[0], "fuzzy", best[1]
        return None

    def verdict(self, value: str, in_word: bool, literal: bool) -> tuple | None:
        return self.memo.get((value.lower() if value.isascii() else value, in_word, literal))

    # a text

    def _words(self, text: str, found: list[Token]) -> list[Hit]:
        hits = []
        for t in found:
            if t.hexadecimal or "_" in (text[t.start - 1 : t.start], text[t.end : t.end + 1]):
                continue
            if v := self.verdict(t.value, True, t.literal):
                hits.append(self._hit(text, t.start, t.end, *v))
        return hits

    def _segments(self, text: str, spans: list[tuple[int, int]], codes: list[bool], blobs: list[bool], words: list[Hit], found: list[Token]) -> list[Hit]:
        hits, at = [], 0
        whole = {t.start: t for t in found}
        for (start, end), code, blob in zip(spans, codes, blobs):
            while at < len(words) and words[at].end < end:  # words are in order and don't overlap
                at += 1
            value = text[start:end]
            if blob or (at < len(words) and words[at].start <= start) or snake_case(value):
                continue
            value, lead = stripped(value)
            if not value or value.lower() in self.index.safe:
                continue
            token = whole.get(start + lead)
            if token and token.end == start + lead + len(value) and "_" not in (text[token.start - 1 : token.start], text[token.end : token.end + 1]):
                # The segment is one word: a hit of the word outdoes the segment's; a word without one has none here
                # either, unless its normal form is another or the whitelist stopped it.
                low = value.lower()
                if self.verdict(value, True, token.literal) or (low not in self.white and forms.normalize(value, token.literal) == low and value.isalpha()):
                    continue
            if cut := _CONTRACTION.fullmatch(value):
                value = cut[1]
            if v := self.verdict(value, False, forms.keeps_digits(value, code)):
                hits.append(self._hit(text, start + lead, start + lead + len(value), *v))
        return hits

    @staticmethod
    def _hit(text: str, start: int, end: int, entry: Word | Phrase, kind: str, confidence: float) -> Hit:
        return Hit(start, end, text[start:end], entry.word if isinstance(entry, Word) else entry.phrase, entry.language, entry.severity, entry.category, kind, confidence)

    def _cancelled(self, context: Context, stream: list[Spoken], first: int, last: int, text: str) -> bool:
        joined = lambda a, b: a.source == b.source or _JOINED.fullmatch(text, a.end, b.start) is not None
        if context.at_end:
            if last + 1 < len(stream) and stream[last + 1].source == stream[last].source:
                return True
            rest = text[stream[last].end :].lstrip(" \t")
            if rest and rest[0] not in "\n\r" and rest[0].isalnum():
                return True

        def runs(sequence: list[str], at: int, step: int) -> bool:
            for k in range(len(sequence)):
                near, far = at + step * k, at + step * (k + 1)
                if not 0 <= far < len(stream):
                    return False
                a, b = sorted((near, far))
                if not joined(stream[a], stream[b]) or context.key(stream[far].value) != sequence[k]:
                    return False
            return True

        return any(runs(s, last, 1) for s in context.after) or any(runs(s[::-1], first, -1) for s in context.before)

    def _begins(self, value: str, literal: bool) -> tuple[bool, bool]:
        """Whether a window that starts with this word can be a phrase, and a folded phrase. A window's normal form is
        that of its words, end to end; only digits alone are decoded beside other words."""
        return self.starts.get((value, literal))

    def _beginning(self, value: str, literal: bool) -> tuple[bool, bool]:
        plain = forms.normalize(value, literal)
        every = {plain, forms.collapse(forms.decode(plain, literal), 3, 2)} if plain.isdigit() else {plain}
        begins = not plain.isascii() or not self.index.beginnings.isdisjoint(every)
        return begins, self.config.transliteration and script.phrase_fold(value) in self.index.folded_beginnings

    # which segments matter

    def _kind(self, value: str) -> int:
        """Of a segment, whatever stands around it."""
        found = tokens(value)
        phrases = self.config.phrases and bool(self.index.phrases)
        if phrases and (any(c in value for c in T.APOSTROPHES) or any(t.value.lower() in T.ONE_WORD for t in found)):
            return ACTIVE
        ways = (False, True) if _DIGIT.search(value) else (False,)
        begins = False
        for t in found:
            if any(self.verdict(t.value, True, way) for way in ways):
                return ACTIVE
            if phrases and any(any(self._begins(t.value, way)) for way in ways):
                begins = True
        if begins and (len(found) > 1 or len(ways) > 1 or not forms.normalize(found[0].value).isascii()):
            return ACTIVE
        core = stripped(value)[0]
        if cut := _CONTRACTION.fullmatch(core):
            core = cut[1]
        alone = len(found) == 1 and found[0].value == core and core.isalpha() and forms.normalize(core) == core.lower() and core.lower() not in self.white
        if core and not alone and any(self.verdict(core, False, way) for way in ways):
            return ACTIVE
        letter = any(t.end - t.start == 1 for t in found)
        if begins:
            return BEGINS_LETTER if letter else BEGINS
        return LETTER if letter else WORDY if found else INERT

    def _continues(self, first: str, after: str) -> bool:
        """Whether a window can be a phrase that starts with the one word of a segment and the first one of the next:
        a window's normal form is that of its words, end to end."""
        a, b = tokens(first)[0].value, tokens(after)[0].value
        plain = forms.normalize(b)
        if _DIGIT.search(b) or not plain.isascii() or forms.normalize(a) + plain in self.index.beginnings:
            return True
        return self.config.transliteration and script.phrase_fold(a) + script.phrase_fold(b) in self.index.folded_beginnings

    def _regions(self, text: str) -> list[tuple[int, int]]:
        """Where hits can be, with as many words around as they can depend on."""
        values = _SEGMENT.findall(text)
        kinds = list(map(self.kinds.new.get, values))
        if None in kinds:
            old = self.kinds.old
            for v in self.sieve.passed(list({v for v, k in zip(values, kinds) if k is None and len(v) <= LONG and v not in old})):
                self.kinds.put(v, WORDY)
            kinds = [(ACTIVE if len(v) > LONG else self.kinds.get(v)) if k is None else k for v, k in zip(values, kinds)]
        some = [k for k, kind in enumerate(kinds) if kind > WORDY]
        if not some:
            return []
        lettered = {k for k in some if kinds[k] != BEGINS}
        for k in some:  # three or more in a row may spell a word
            if k in lettered and k - 1 in lettered and k - 2 in lettered and any(kinds[j] != ACTIVE for j in (k - 2, k - 1, k)):
                kinds[k - 2 : k + 1] = [ACTIVE] * 3
        for k in some:
            if BEGINS <= kinds[k] < ACTIVE:
                after = next((j for j in range(k + 1, len(kinds)) if kinds[j]), None)
                if after is not None and (kinds[after] == ACTIVE or self._continues(values[k], values[after])):
                    kinds[k] = ACTIVE
        active = [k for k in some if kinds[k] == ACTIVE]
        if not active:
            return []
        spans = [m.span() for m in _SEGMENT.finditer(text)]
        worded = [k for k, kind in enumerate(kinds) if kind]
        out: list[list[int]] = []
        for k in active:
            place = bisect_left(worded, k)
            low, high = worded[max(0, place - self.margin)], worded[min(len(worded) - 1, place + self.margin)]
            if out and spans[low][0] <= out[-1][1] + 1:
                out[-1][1] = spans[high][1]
            else:
                out.append([spans[low][0], spans[high][1]])
        return [(a, b) for a, b in out]

    def _phrases(self, text: str, found: list[Token]) -> list[Hit]:
        index, hits = self.index, []
        stream: list[Spoken] = []
        place: dict[int, tuple[int, int]] = {}

        def speak() -> None:
            if not stream:
                stream.extend(spoken(found, text))
                for k, t in enumerate(stream):
                    place[t.source] = (place.get(t.source, (k, k))[0], k)

        def accept(entries: list[Phrase], folded: bool, first: int, last: int, start: int, end: int) -> None:
            for p in entries:
                context = index.contexts.get(p)
                if self._passes(p) and not (context and self._cancelled(context, stream, first, last, text)):
                    hits.append(self._hit(text, start, end, p, "phrase", 0.9 if folded else 1.0))

        begins, may_fold = zip(*(self._begins(t.value, t.literal) for t in found)) if found else ((), ())
        some = [k for k in range(len(found)) if begins[k] or may_fold[k]]
        for size in range(2, min(index.widest, len(found)) + 1):
            wide = size in index.folded_widths
            for k in some:
                if k + size > len(found) or not (begins[k] or (wide and may_fold[k])):
                    continue
                window = found[k : k + size]
                phrase = " ".join(t.value for t in window)
                key = forms.normalize(phrase, any(t.literal for t in window))
                if phrase.lower() in self.white or key in self.white:
                    continue
                entries, folded = index.phrases.get(key), False
                if not entries and wide and may_fold[k]:
                    entries, folded = index.folded.get("".join(script.phrase_fold(t.value) for t in window)), True
                if entries:
                    speak()
                    accept(entries, folded, place[k][0], place[k + size - 1][1], window[0].start, window[-1].end)
        if not any(c in text for c in T.APOSTROPHES) and T.ONE_WORD.keys().isdisjoint({t.value.lower() for t in found}):
            return hits
        speak()
        rewritten = [k for k, t in enumerate(stream) if t.rewritten]
        starts = sorted({s for k in rewritten for s in range(max(0, k - index.widest + 1), k + 1)})
        for first in starts:
            if forms.normalize(stream[first].value, found[stream[first].source].literal) not in index.first_words:
                continue
            for size in range(2, min(index.widest, len(stream) - first) + 1):
                window = stream[first : first + size]
                if not any(t.rewritten for t in window):
                    continue
                phrase, start, end = " ".join(t.value for t in window), window[0].start, window[-1].end
                key = forms.normalize(phrase, any(found[t.source].literal for t in window))
                surface = text[start:end]
                if self.white and self.white & {phrase.lower(), key, surface.lower(), forms.normalize(surface)}:
                    continue
                if entries := index.phrases.get(key):
                    accept(entries, False, first, first + size - 1, start, end)
        return hits

    def _within(self, text: str) -> list[Hit]:
        """Detections of a folded text, in order of their start, without overlaps."""
        found = tokens(text)
        spans = [m.span() for m in _SEGMENT.finditer(text)]
        values = [text[a:b] for a, b in spans]
        codes = [in_code(values, k) for k in range(len(values))]
        blobs = [_DIGIT.search(v) is not None and forms.is_hex_blob(stripped(v)[0]) for v in values]
        at = 0
        for t in found:
            while at < len(spans) - 1 and spans[at][1] <= t.start:
                at += 1
            t.hexadecimal, t.literal = blobs[at], _DIGIT.search(t.value) is not None and forms.keeps_digits(t.value, codes[at])
        words = self._words(text, found)
        every = words + self._segments(text, spans, codes, blobs, words, found)
        if self.config.phrases and self.index.phrases:
            every += self._phrases(text, found)
        kept, free = [], -1
        for hit in sorted(every, key=lambda h: (h.start, -h.confidence, h.start - h.end)):
            if hit.start >= free:
                kept.append(hit)
                free = hit.end
        return kept

    def detect(self, original: str | None) -> list[Hit]:
        """Detections in order of their start, without overlaps; offsets in code points of the original."""
        if not original or not original.strip():
            return []
        text = forms.fold(original)
        kept = []
        for a, b in self._regions(text):
            for hit in self._within(text[a:b]):
                hit.start, hit.end = hit.start + a, hit.end + a
                kept.append(hit)
        if kept and text != original:
            _, places = forms.fold_with_map(original)
            for hit in kept:
                hit.start, hit.end = places[hit.start], places[hit.end]
                hit.original = original[hit.start : hit.end]
        return kept

    def flagged(self, original: str | None) -> bool:
        """Whether there is any detection; ends with the first region that has one."""
        if not original or not original.strip():
            return False
        text = forms.fold(original)
        return any(self._within(text[a:b]) for a, b in self._regions(text))
