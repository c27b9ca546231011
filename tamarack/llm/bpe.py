"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the bytes before a white space decides whether a text is cut there, so equal passages are
cut alike wherever they stand. A worker encodes each distinct chunk once and reuses its ids in all documents
it sees (memo bounded in bytes); a new chunk asks the library for its distinct pieces only. Each join is then repaired: a window around it is encoded as a whole and
must agree with what the two chunks end and begin with; while it doesn't, the window doubles, and at last
both chunks are encoded as one. Documents are encoded independently: no shuffle.

Defined results: null or empty text has no ids and decodes to an empty text; texts without white space are
one chunk; repeated rows are encoded row by row; extra columns are carried along, columns of the results'
names are replaced.
"""

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, PrefixHash, batch_bytes, binary_array, bounded_batches, fresh, named, per_process, text_of

WINDOW = 24  # bytes that the rolling hash looks back
SPARSE = 255  # mask: of the white spaces, one in so many + 1 is a cut
MEMO_BYTES = 16 << 20
JOIN = 12  # characters on either side of a join that are encoded again at first
JOIN_MEMO = 20_000
MEMO_PIECES = 700_000
CHUNK_PIECES = 180_000  # beside chunks
LOT = 1 << 17  # characters that the library gets at once
SPACED = 200  # pieces to a text
#: A fixed value: the pattern of tokenizers that drop white space and never match across it.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return found

    return per_process(f"tokenizer:{path}", make)


# --- pieces: the tokenizer's own split ------------------------------------------------------------------------

#: Characters whose classes all Unicode versions agree on; texts with others go to the library whole.
_LAST = 0x24F
_UNSAFE = re.compile(f"[^\\t\\n\\r -~\\xa0-{chr(_LAST)}]")


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, (*range(0x20, 0x7F), *range(0xA0, _LAST + 1))) if unicodedata.category(c)[0] == kind)


def _byte_level() -> re.Pattern:
    """The split of byte-level vocabularies, over the safe characters."""
    letters, digits, spaces = _class("L"), _class("N"), "\\t\\n\\r \\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, others from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


class PieceEncoder:
    """Ids by the library, asked once for each distinct piece of a text; the memo is bounded. What a piece is
    follows from the tokenizer's file: byte-level vocabularies split by their pattern; those that only keep
    what has no white space in it split at white space. Others, and texts that the split doesn't cover, go to
    the library whole."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before, normalizer = told["pre_tokenizer"] or {}, told["normalizer"]
        special = [x["content"] for x in told["added_tokens"]]
        steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])]
        first = (before.get("pretokenizers") or [{}])[0]
        self.split, self.covers, self.model = None, lambda text: False, None
        if normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.split = _byte_level().findall
            self.model, self.table = self.tokenizer.model, _byte_letters()
            self.covers = lambda text: not _UNSAFE.search(text) and not any(s in text for s in special)
        elif set(steps) <= {"NFC", "Replace", "Lowercase"} and first.get("pattern", {}).get("Regex") == SPACELESS and first.get("behavior") == "Removed" and not any(re.search(r"\s", s) for s in special):
            self.split = re.compile(r"[^ \t\n\r]+").findall
            self.covers = lambda text: True
        self.memo = Generations(memo)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        covered = [self.covers(t) for t in texts]
        whole = iter(self.library([t for t, c in zip(texts, covered) if not c]))
        pieces = [self.split(t) if c else None for t, c in zip(texts, covered)]
        self._learn(set().union(*(p for p in pieces if p)))
        known = self.memo.new.__getitem__
        out = [next(whole) if p is None else b"".join(map(known, p)) for p in pieces]
        if len(self.memo.new) > self.memo.limit:
            self.memo.old, self.memo.new = self.memo.new, {}
        return out

    def _learn(self, pieces: set[str]) -> None:
        old, new = self.memo.old, self.memo.new
        missing = pieces.difference(new)
        new.update((p, old[p]) for p in missing.intersection(old))
        ask = list(missing.difference(old))
        new.update(zip(ask, self._merged(ask) if self.model is not None else self._spaced(ask)))

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Of pieces without white space: some hundred at once as one text with blanks between them, whose ids are cut
        where the pieces end; that spares most of the library's cost for each text."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), SPACED * 32):
            lots = [pieces[k : k + SPACED] for k in range(lo, min(len(pieces), lo + SPACED * 32), SPACED)]
            for lot, x in zip(lots, self.tokenizer.encode_batch([" ".join(lot) for lot in lots], add_special_tokens=False)):
                raw = array("I", x.ids).tobytes()
                ends = np.cumsum([len(p) + 1 for p in lot])  # behind each piece's blank
                starts = np.fromiter((start for start, _ in x.offsets), np.int64, len(x.ids))
                cuts = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that the byte-level split has made already: the library's model by itself."""
        tokenize, table = self.model.tokenize, self.table
        return [array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(table))]).tobytes() for p in pieces]

    def library(self, texts: list[str]) -> list[bytes]:
        """Encoded in small lots: the library holds far more for each token than its id."""
        out: list[bytes] = []
        lot, size = [], 0
        for k, text in enumerate(texts):
            lot.append(text)
            size += len(text) + 16
            if size >= LOT or k == len(texts) - 1:
                out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)]
                lot, size = [], 0
        return out


# --- chunks ---------------------------------------------------------------------------------------------------


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk boundaries of texts laid end to end, and the index of each text's first one (rows + 1)."""
    spaces = np.flatnonzero((data == 32) | (data == 10))
    first = offsets[np.searchsorted(offsets, spaces, "right") - 1]
    spaces = spaces[spaces - first >= WINDOW]
    hashed = PrefixHash(data).of(spaces - WINDOW, spaces)
    chosen = spaces[(hashed >> np.uint64(40)) & np.uint64(SPARSE) == 0]
    every = np.union1d(chosen, offsets)
    return every, np.searchsorted(every, offsets)


class ChunkCodec:
    def __init__(self, path: str):
        self.pieces = PieceEncoder(path, CHUNK_PIECES)
        self.tokenizer = self.pieces.tokenizer
        self.chunks = Generations(MEMO_BYTES)
        self.joins = Generations(JOIN_MEMO)

    def _window(self, left: str, right: str, size: int) -> tuple[tuple[str, str], bool]:
        """The text before and after a join: size characters on both sides, out to white space; whether that is all there is."""
        tail, head = left[_before(left, size) :], right[: _after(right, size)]
        return (tail, head), len(tail) == len(left) and len(head) == len(right)

    def _cut(self, windows: list[tuple[str, str]]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each window, encoded as a whole by the library, before and after its join; None where a token lies across it."""
        out: list[tuple[bytes, bytes] | None] = []
        for lo in range(0, len(windows), 512):
            lot = windows[lo : lo + 512]
            for (tail, _), x in zip(lot, self.tokenizer.encode_batch([a + b for a, b in lot], add_special_tokens=False)):
                k = sum(end <= len(tail) for _, end in x.offsets)
                across = any(start < len(tail) < end for start, end in x.offsets) or any(end <= len(tail) for _, end in x.offsets[k:])
                out.append(None if across else (array("I", x.ids[:k]).tobytes(), array("I", x.ids[k:]).tobytes()))
        return out

    def _agrees(self, left: str, right: str, a: bytes, b: bytes) -> bool:
        """Whether some window over the join, encoded as a whole by the library, is, before the join, what a ends with and, after it, what b begins with."""
        size = JOIN
        while True:
            window, whole = self._window(left, right, size)
            found = self.joins.get(window)
            if found is None:
                found = self._cut([window])
                self.joins.put(window, found)
            if found[0] is not None and a.endswith(found[0][0]) and b.startswith(found[0][1]):
                return True
            if whole:
                return False
            size *= 2

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string array, little-endian unsigned 32-bit."""
        data, offsets = batch_bytes(column)
        every, firsts = cuts(data, offsets)
        raw = data.tobytes()
        bounds = every.tolist()
        keys = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        got = {key: self.chunks.get(key) for key in dict.fromkeys(keys)}
        new = [key for key, ids in got.items() if ids is None]
        for key, ids in zip(new, self.pieces.encode([key.decode() for key in new])):
            got[key] = ids
            self.chunks.put(key, ids, len(key) + len(ids) + 200)
        texts = [key.decode() for key in keys]
        row_of = np.searchsorted(firsts, np.arange(len(keys)), "right")
        pairs = np.flatnonzero(row_of[1:] == row_of[:-1]).tolist()
        windows = dict.fromkeys(self._window(texts[k], texts[k + 1], JOIN)[0] for k in pairs)
        windows = [w for w in windows if self.joins.get(w) is None]
        for window, found in zip(windows, self._cut(windows)):
            self.joins.put(window, [found])
        out = []
        for row in range(len(offsets) - 1):
            parts: list[bytes] = []
            last = ""
            for k in range(firsts[row], firsts[row + 1]) if offsets[row] < offsets[row + 1] else ():
                text, ids = texts[k], got[keys[k]]
                if parts and not self._agrees(last, text, parts[-1], ids):
                    text = last + text
                    ids = self.pieces.library([text])[0]
                    parts.pop()
                parts.append(ids)
                last = text
            out.append(b"".join(parts))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


def _before(text: str, size: int) -> int:
    """The last white space at least size characters before the end, or 0."""
    end = len(text) - size
    return max(text.rfind(" ", 0, end), text.rfind("\n", 0, end), 0) if end > 0 else 0


def _after(text: str, size: int) -> int:
    """The first white space after size characters, or the end."""
    found = [x for x in (text.find(" ", size), text.find("\n", size)) if x >= 0]
    return min(found, default=len(text))


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """df with ids (binary, little-endian unsigned 32-bit) and n_tokens; decoded adds the text those ids decode to."""
    bounded_batches(df.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = per_process(f"chunks:{path}", lambda: ChunkCodec(path))
        for column in texts:
            ids = codec.encode(column)
            found = [binary_array(ids), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.StructArray.from_arrays([*found, pa.array(codec.decode(ids), pa.string())][: 2 + decoded], ["ids", "n_tokens", "decoded"][: 2 + decoded])

    names = ["ids", "n_tokens", "decoded"][: 2 + decoded]
    kind = "struct<ids:binary,n_tokens:bigint" + ",decoded:string" * decoded + ">"
    made = fresh(df, "_bpe")
    held = df.withColumn(made, F.arrow_udf(run, kind)(text_of(text)))
    return held.select(*(named(c) for c in df.columns if c not in names), *(F.col(made).getField(x).alias(x) for x in names))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text that a column of ids, as encode() makes it, decodes to; null ids decode to an empty text."""
    bounded_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for column in columns:
            found = [np.frombuffer(x or b"", "<u4").tolist() for x in column.to_pylist()]
            yield pa.array(tokenizer.decode_batch(found, skip_special_tokens=False), pa.string())

    return df.withColumn(into, F.arrow_udf(run, "string")(named(ids)))
