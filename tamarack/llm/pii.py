"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are kept as their patterns and checks have them, whatever the score.
The method adds kinds of its own where pattern, checksum and context together reach the threshold, and only
outside base spans. Rows are scanned one by one in Arrow batches; nothing is shuffled.

Defined results: null or empty text has no spans; every step is linear in a text's length; repeated rows are
scanned row by row; extra columns are carried along, a column of the result's name is replaced.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

#: Base kinds first, as listed; then the method's own.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?)?[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4})?(?![0-9A-Za-z]|[.-][0-9])")

#: Score that a pattern alone gives, words near a span that speak for its kind, and words that speak against any.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "local_phone": 0.3}
_CHECKED = 0.4
_FOR = {
    "email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "téléphone"),
}
_AGAINST = ("order", "invoice", "isbn", "version", "serial", "part no", "tracking")
_NEAR = 40
_FOR_WORDS = {kind: re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})\b") for kind, words in _FOR.items()}
_AGAINST_WORDS = re.compile(rf"\b(?:{'|'.join(map(re.escape, _AGAINST))})\b")
THRESHOLD = 0.6


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(x)) > 9 else d for x in even)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it and a dotted domain after it, from left to right."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 12:
            yield m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Pattern, checksum and whole words near a span; a word cut by the distance counts as it stands."""
    near = f"{text[max(0, start - _NEAR) : start]} {text[end : end + _NEAR]}".lower()
    found = _PRIOR[kind] + _CHECKED * (kind in ("card", "iban"))
    found += 0.35 * (_FOR_WORDS[kind].search(near) is not None)
    found -= 0.3 * (_AGAINST_WORDS.search(near) is not None)
    return round(min(1.0, max(0.0, found)), 2)


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in code points, by start and then by kind as listed."""
    found = []
    digit = not text.isalpha() and re.search("[0-9]", text) is not None
    if "@" in text:
        found += [("email", *x) for x in _emails(text)]
    if digit:
        found += [("ip", *x) for x in _ips(text)]
        found += [("card", *x) for x in _cards(text)]
        if "+" in text:
            found += [("phone", *x) for x in _phones(text)]
    spans = [(k, s, e, score(text, k, s, e), True) for k, s, e in found]
    if digit:
        for kind, proposals in (("iban", _ibans(text)), ("local_phone", _local_phones(text))):
            taken, at = sorted((s, e) for _, s, e, *_ in spans), 0  # base spans and proposals both go from left to right
            for s, e in proposals:
                while at < len(taken) and taken[at][1] <= s:
                    at += 1
                if not (at < len(taken) and taken[at][0] < e) and (x := score(text, kind, s, e)) >= THRESHOLD:
                    spans.append((kind, s, e, x, False))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans) -> str:
    """Each span, or run of overlapping spans, becomes the bracketed name of the first one's kind."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([[dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in find(t or "")] for t in column.to_pylist()], _ARROW)


def _redact(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([redacted(t or "", find(t or "")) for t in column.to_pylist()], pa.string())


def scan(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """df with an array column of spans."""
    bounded_batches(df.sparkSession)
    return df.withColumn(into, F.arrow_udf(_scan, SPANS)(text_of(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its personal data replaced by markers; n_chars, if there, follows the text."""
    bounded_batches(df.sparkSession)
    out = df.withColumn(text, F.arrow_udf(_redact, "string")(text_of(text)))
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in df.columns else out


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
