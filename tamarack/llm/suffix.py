"""Exact repeats across documents: a hash-compared suffix sort over anchored pieces of the corpus.

A byte goes if it lies in a WINDOW-byte string that also starts in a document of smaller doc_id. Equal windows
have equal minimizers (the ANCHOR-byte substring of least hash), so the windows of a document fall into runs
with one anchor each, and a run's bytes (a piece) hold all its windows. Hence the corpus need not be sorted in
one place: pieces meet others of their anchor only.

1. Documents are staged once; rows of equal text are represented by those of the least doc_id, any other copy
   goes whole. Anchors are counted over the representatives (parts.frequencies); most occur in one document.
2. Pieces with an anchor that two rows share are sent to their anchor's bucket; a flush keeps one piece, of the
   least doc_id, of equal ones: it marks those of other documents itself, and those of the same document are noted
   as its twins. So a passage costs one piece a flush, however often a text repeats it. In a bucket,
   equal pieces are found by their hash; where an anchor has different pieces, their windows, which are suffixes
   of the pieces, are sorted: a mergesort whose comparisons find the common extension of two suffixes by binary
   search over polynomial prefix hashes, in a logarithmic number of steps. Neighbours with a common extension of
   a whole window, and pieces taken as equal, are then compared byte by byte, so no collision gets through. Windows
   whose hash no other one of the bucket has can't be repeats and aren't sorted.
   Pieces of an anchor that more than HOT_ROWS rows have are sent as single windows, by the window's own hash, the
   least doc_id of each only: a phrase in millions of documents, in ever other surroundings, goes to all buckets.
   A bucket is worked through SORT_BYTES at a time, whole anchors together; the windows of an anchor with more
   than that meet by their hash, a share of the hashes in each round, and are compared byte by byte as well.
3. Marked windows, as ranges of their starts, and twins go back to their part; a last pass marks the twins as their
   piece is, joins the windows' bytes and cuts them.

Defined results: null or empty text has no bytes; texts shorter than a window lose nothing; rows with a null
doc_id neither lose bytes nor cost others any; rows that repeat a doc_id don't cost each other bytes; an empty
table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import PrefixHash, batch_bytes, mix64, named, scratch, text_of
from .parts import Known, bucket_bits, by_part, frequencies, side, stage

WINDOW = 50
ANCHOR = 24
FLUSH_BYTES = 3 << 20
HOT_ROWS = 20_000
SORT_BYTES = 1 << 20  # of pieces sorted at once, in some hundred bytes of memory each; also windows that meet by hash
PIECES, MARKS, TWINS = range(3)  # kinds of blobs
_LOW = 32  # bits for a position in a batch: texts of up to 4 GB


# --- pieces ---------------------------------------------------------------------------------------------------


def pieces(data: np.ndarray, offsets: np.ndarray, prefix: PrefixHash):
    """Of texts laid end to end: each piece's row, start, length, anchor's position and anchor's hash."""
    span = WINDOW - ANCHOR + 1
    hashes = mix64(prefix.all(ANCHOR))
    none = np.zeros(0, np.int64)
    if len(hashes) < span:
        return none, none, none, none, none.astype(np.uint64)
    least = hashes & ~np.uint64((1 << _LOW) - 1) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + WINDOW <= offsets[1:][row])
    anchor = (least[start] & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(first, len(start)))
    begin, at = start[first], anchor[first]
    return row[begin], begin, count + WINDOW - 1, at, hashes[at]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _slices(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of items with a total weight of about `most` each."""
    if len(weights):
        of = np.cumsum(weights) // most
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(weights)]
        yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


# --- suffix sort ----------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of data, cut after WINDOW bytes, compared by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, prefix: PrefixHash):
        self.data, self.prefix = data, prefix

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, at most WINDOW."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.prefix.of(a, a + middle) == self.prefix.of(b, b + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before that at b; ties: what equal ones count as."""
        shared = self.extension(a, b)
        whole = shared == WINDOW
        at = np.minimum(shared, WINDOW - 1)
        return np.where(whole, ties, self.data[a + at] < self.data[b + at])

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order that sorts the suffixes within each group; groups are runs of equal, ascending numbers. A
        bottom-up mergesort: in a round, each suffix finds its rank in the neighbouring run by binary search."""
        n = len(starts)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        base, room = np.repeat(first, size), np.repeat(size, size)
        order = np.arange(n)
        run = 1
        while (room > run).any():
            active = np.flatnonzero(room > run)  # positions, not suffixes
            place = active - base[active]
            own = place // run
            other = (own ^ 1) * run
            low = np.minimum(other, room[active])
            end = np.minimum(other + run, room[active])
            left = own % 2 == 0
            bottom, top = low.copy(), end.copy()
            mine = starts[order[active]]
            while True:
                open_ = np.flatnonzero(bottom < top)
                if not len(open_):
                    break
                middle = (bottom[open_] + top[open_]) // 2
                theirs = starts[order[base[active[open_]] + middle]]
                # from the left run, equal suffixes of the right one come after; from the right run, before
                passed = self.before(theirs, mine[open_], ~left[open_])
                bottom[open_] = np.where(passed, middle + 1, bottom[open_])
                top[open_] = np.where(passed, top[open_], middle)
            target = base[active] + np.minimum(own, own ^ 1) * run + (place - own * run) + (bottom - low)
            moved = order[active]
            order[target] = moved
            run *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the bytes at a and b are the same, compared themselves."""
        if not len(a):
            return np.zeros(0, bool)
        differ = self.data[_ranges(a, lengths)] != self.data[_ranges(b, lengths)]
        return np.add.reduceat(differ, np.cumsum(lengths) - lengths) == 0


def duplicated(data: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to) of ranges, in bytes of a piece, that are covered by windows some piece of a smaller doc has.
    anchor: the anchor's offset in a piece."""
    prefix = PrefixHash(data)
    sorter = Suffixes(data, prefix)
    key = mix64(prefix.of(start + anchor, start + anchor + ANCHOR))
    whole = mix64(prefix.of(start, start + length) + (length * 64 + anchor).astype(np.uint64))
    order = np.lexsort((doc, whole, key))
    k, w, d = key[order], whole[order], doc[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each piece, in this order, the first of its class
    same = length[order] == length[head]
    same[same] = sorter.equal(start[order][same], start[head][same], length[order][same])
    if not same.all():  # a collision: those pieces become classes of their own
        new |= ~same
        after = np.flatnonzero(~same) + 1
        new[after[after < len(new)]] = True
    cls = np.cumsum(new) - 1
    least = d[new]
    later = d > least[cls]
    whole_pieces = order[later]

    heads = order[new]
    group_of = np.cumsum(np.concatenate(([True], key[heads][1:] != key[heads][:-1]))) - 1
    several = np.bincount(group_of)[group_of] > 1
    chosen = np.flatnonzero(several)  # classes whose anchor has other pieces
    windows = length[heads[chosen]] - WINDOW + 1
    own = np.repeat(chosen, windows)
    at = _ranges(start[heads[chosen]], windows)
    hashed = prefix.of(at, at + WINDOW)
    by_hash = np.argsort(hashed, kind="stable")
    alike = hashed[by_hash][1:] == hashed[by_hash][:-1]
    met = np.zeros(len(at), bool)
    met[by_hash[1:][alike]] = met[by_hash[:-1][alike]] = True
    own, at = own[met], at[met]
    back = start[heads[own]] + anchor[heads[own]] - at  # the anchor's offset in the window
    pre = np.lexsort((at, back, group_of[own]))
    own, at, back = own[pre], at[pre], back[pre]
    changes = (group_of[own][1:] != group_of[own][:-1]) | (back[1:] != back[:-1])
    group = np.concatenate(([0], np.cumsum(changes))) if len(own) else np.zeros(0, np.int64)
    order2 = sorter.sort(at, group)
    own, at, group = own[order2], at[order2], group[order2]
    alike = np.zeros(len(at), bool)
    pair = np.flatnonzero(group[1:] == group[:-1]) + 1
    pair = pair[prefix.of(at[pair], at[pair] + WINDOW) == prefix.of(at[pair - 1], at[pair - 1] + WINDOW)]
    alike[pair] = sorter.equal(at[pair], at[pair - 1], np.full(len(pair), WINDOW))
    run = np.cumsum(~alike) - 1
    lowest = np.minimum.reduceat(least[own], np.flatnonzero(~alike)) if len(own) else least[:0]
    hit = least[own] > lowest[run] if len(own) else np.zeros(0, bool)
    hit_cls, hit_at = own[hit], at[hit] - start[heads[own[hit]]]

    # each hit holds for every piece of its class that has the class's least doc
    keep = np.flatnonzero(~later)
    first = np.searchsorted(cls[keep], hit_cls, "left")
    count = np.searchsorted(cls[keep], hit_cls, "right") - first
    members = order[keep[_ranges(first, count)]] if len(hit_cls) else np.zeros(0, np.int64)
    offset = np.repeat(hit_at, count)
    return np.concatenate([whole_pieces, members]), np.concatenate([np.zeros(len(whole_pieces), np.int64), offset]), np.concatenate([length[whole_pieces], offset + WINDOW])


def by_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As duplicated(), a window to each range, with memory for SORT_BYTES windows whatever the pieces' number: each
    round takes a share of the windows' hashes."""
    compare = Suffixes(data, None)
    rounds = np.uint64(-(-int((length - WINDOW + 1).sum()) // SORT_BYTES))
    for turn in range(int(rounds)):
        held = []
        for k in _slices(length, SORT_BYTES):
            n = length[k] - WINDOW + 1
            begin = np.cumsum(length[k]) - length[k]
            at = _ranges(begin, n)
            hashed = mix64(PrefixHash(data[_ranges(start[k], length[k])]).of(at, at + WINDOW))
            mine = np.flatnonzero(hashed % rounds == turn)
            piece = np.repeat(np.arange(len(n)), n)[mine]
            held.append((hashed[mine], piece + k.start, at[mine] - begin[piece]))
        hashed, piece, offset = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc[piece], hashed))
        hashed, piece, offset = hashed[order], piece[order], offset[order]
        if not len(piece):
            continue
        new = np.concatenate(([True], hashed[1:] != hashed[:-1]))
        cls = np.cumsum(new) - 1
        head = np.flatnonzero(new)[cls]
        hit = doc[piece] > doc[piece[head]]
        place = start[piece] + offset
        later = np.flatnonzero(hit)
        for k in _slices(np.full(len(later), WINDOW), SORT_BYTES):
            own = later[k]
            hit[own] = compare.equal(place[own], place[head[own]], np.full(len(own), WINDOW))
        for c in np.unique(cls[later[~hit[later]]]):  # a collision: by the bytes themselves
            own = np.flatnonzero(cls == c)
            bytes_ = [data[place[k] : place[k] + WINDOW].tobytes() for k in own]
            least: dict[bytes, int] = {}
            for x, d in zip(bytes_, doc[piece[own]].tolist()):
                least[x] = min(d, least.get(x, d))
            hit[own] = doc[piece[own]] > np.array([least[x] for x in bytes_])
        yield piece[hit], offset[hit], offset[hit] + WINDOW


def repeats(data: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As duplicated(), of any number of pieces laid end to end, SORT_BYTES at a time."""
    if len(data) <= SORT_BYTES:
        yield duplicated(data, start, length, anchor, doc)
        return
    key = np.zeros(len(start), np.uint64)
    for k in _slices(length, SORT_BYTES):
        at = start[k] - start[k][0]
        prefix = PrefixHash(data[start[k][0] : start[k][-1] + length[k][-1]])
        key[k] = prefix.of(at + anchor[k], at + anchor[k] + ANCHOR)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    edges = np.append(first, len(order))
    weight = np.add.reduceat(length[order], first)
    large = weight > SORT_BYTES
    for g in np.flatnonzero(large):
        own = order[edges[g] : edges[g + 1]]
        for piece, lo, hi in by_windows(data, start[own], length[own], doc[own]):
            yield own[piece], lo, hi
    rest = order[np.repeat(~large, np.diff(edges))]
    edges = np.append(0, np.cumsum(np.diff(edges)[~large]))
    for k in _slices(weight[~large], SORT_BYTES):
        own = rest[edges[k.start] : edges[k.stop]]
        n = length[own]
        piece, lo, hi = duplicated(data[_ranges(start[own], n)], np.cumsum(n) - n, n, anchor[own], doc[own])
        yield own[piece], lo, hi


# --- tables ---------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, size = struct.unpack_from("<cQ", raw, at)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at + 9))
        at += 9 + size
    return out


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each row joined where they overlap or touch, ascending."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    shift = row.astype(np.int64) << 32
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], (np.maximum.reduceat(end + shift, first) - shift[first]).astype(start.dtype)


def twinned(row: np.ndarray, start: np.ndarray, end: np.ndarray, to: np.ndarray, at: np.ndarray, of: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of twins: of merged ranges (row, start, end), what lies in row `of` from begin on, count long, moved to
    row `to` at `at`."""
    low = (of << 32) + begin
    lo, hi = np.searchsorted((row << 32) + end, low, "right"), np.searchsorted((row << 32) + start, low + count, "left")
    n = np.maximum(hi - lo, 0)
    k, i = _ranges(lo, n), np.repeat(np.arange(len(to)), n)
    shift = (at - begin)[i]
    return merged(to[i], np.maximum(start[k], begin[i]) + shift, np.minimum(end[k], (begin + count)[i]) + shift)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _rows_of(folder: str, part: int) -> np.ndarray:
    found = side(folder, part)
    return np.sort(found["rid"].to_numpy()) if found is not None else np.zeros(0, np.int64)


def marks(staged: DataFrame, representatives: str) -> str:
    """A folder with, for each part, the windows of its rows that go, as ranges of their starts, and pieces that go as
    their twins do. representatives: the folder of the rows that take part."""
    spark = staged.sparkSession
    bits = bucket_bits(spark)
    more = bits + 2
    last: dict[int, np.ndarray] = {}

    def taking_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = _column(batch, "part")[0].as_py()
        if part not in last:
            last.clear()
            last[part] = _rows_of(representatives, part)
        return batch.filter(pa.array(np.isin(_column(batch, "rid").to_numpy(), last[part])))

    def anchors(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = batch_bytes(_column(taking_part(batch), "text"))
        row, _, _, _, hashes = pieces(data, offsets, PrefixHash(data))
        cut = np.searchsorted(row, np.arange(len(offsets)))
        out = [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:]) if a < b]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    known = frequencies(staged, ["rid", "text"], anchors, "suffix-anchors")

    def flush(part: int, held: list[tuple]) -> pa.RecordBatch:
        rows, docs, starts, lengths, at, hashes, texts = (np.concatenate(x) for x in zip(*held))
        where = np.cumsum(lengths) - lengths
        prefix = PrefixHash(texts)
        whole = mix64(prefix.of(where, where + lengths) + (lengths * 64 + at).astype(np.uint64))
        order = np.lexsort((docs, whole))
        new = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = (lengths[order] == lengths[head]) & (order != head)
        same[same] = Suffixes(texts, prefix).equal(where[order][same], where[head][same], lengths[order][same])
        later = docs[order] > docs[head]
        gone, sent = order[same & later], np.sort(order[~same])
        twins, of = order[same & ~later], head[same & ~later]
        bucket = (hashes[sent] >> np.uint64(64 - more)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sent, bucket = sent[by_bucket], bucket[by_bucket]
        cut = np.searchsorted(bucket, np.arange((1 << more) + 1))
        ids, kinds, blobs = [], [], []
        for b in np.flatnonzero(np.diff(cut)):
            own = sent[cut[b] : cut[b + 1]]
            blobs.append(_pack(rows[own].astype(np.uint32), docs[own], starts[own].astype(np.uint32), lengths[own].astype(np.uint8), at[own].astype(np.uint8), texts[_ranges(where[own], lengths[own])]))
            ids.append(int(b))
            kinds.append(PIECES)
        if len(gone):
            blobs.append(_pack(*(x.astype(np.uint32) for x in merged(rows[gone], starts[gone], starts[gone] + lengths[gone] - WINDOW + 1))))
            ids.append(int(part) % (1 << more))
            kinds.append(MARKS)
        if len(twins):
            blobs.append(_pack(*(x.astype(np.uint32) for x in (rows[twins], starts[twins], rows[of], starts[of], lengths[of] - WINDOW + 1))))
            ids.append(int(part) % (1 << more))
            kinds.append(TWINS)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part", "kind", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part = 0, -1
        for batch, counts in by_part(batches, lambda p: Known(known, p, bits)):
            own = _column(batch, "part")[0].as_py()
            if held and own != part:
                yield flush(part, held)
                held, size = [], 0
            part, batch = own, taking_part(batch)
            data, offsets = batch_bytes(_column(batch, "text"))
            prefix = PrefixHash(data)
            row, start, length, at, hashes = pieces(data, offsets, prefix)
            often = counts.of(hashes)
            shared = often > 1
            row, start, length, at, hashes = (x[shared] for x in (row, start, length, at, hashes))
            if len(row):
                rid, docs = _column(batch, "rid").to_numpy() & ((1 << 33) - 1), _column(batch, "doc_id").to_numpy()
                hot = often[shared] > HOT_ROWS
                whole = ~hot
                for k in _slices(length[whole], FLUSH_BYTES // 2):  # texts of short periods have many times their bytes in pieces
                    r, s, n = row[whole][k], start[whole][k], length[whole][k]
                    held.append((rid[r], docs[r], s - offsets[r], n, at[whole][k] - s, hashes[whole][k], data[_ranges(s, n)]))
                    size += int(n.sum())
                    if size > FLUSH_BYTES:
                        yield flush(part, held)
                        held, size = [], 0
                for k in _slices(length[hot] - WINDOW + 1, FLUSH_BYTES // WINDOW):
                    r, s, n = row[hot][k], start[hot][k], length[hot][k] - WINDOW + 1
                    r, s, a = np.repeat(r, n), _ranges(s, n), np.repeat(at[hot][k], n)
                    n = np.full(len(s), WINDOW)
                    yield flush(part, [(rid[r], docs[r], s - offsets[r], n, a - s, mix64(prefix.of(s, s + WINDOW)), data[_ranges(s, n)])])
        if held:
            yield flush(part, held)

    def find(table: pa.Table) -> pa.Table:
        out, held = [], []
        for part, kind, blob in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind == PIECES:
                held.append((part, *_unpack(blob)))
            else:
                out.append((part, kind, blob))
        if held:
            parts = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in held])
            rows, docs, starts, lengths, at, texts = (np.concatenate([x[k] for x in held]) for k in range(1, 7))
            held.clear()
            lengths, starts = lengths.astype(np.int64), starts.astype(np.int64)
            for piece, lo, hi in repeats(texts, np.cumsum(lengths) - lengths, lengths, at.astype(np.int64), docs):
                order = np.argsort(parts[piece], kind="stable")
                piece, lo, hi = piece[order], lo[order], hi[order] - WINDOW + 1
                found = parts[piece]
                for part in np.unique(found):
                    a, b = np.searchsorted(found, part, "left"), np.searchsorted(found, part, "right")
                    own = piece[a:b]
                    out.append((int(part), MARKS, _pack(*(x.astype(np.uint32) for x in merged(rows[own], starts[own] + lo[a:b], starts[own] + hi[a:b])))))
        return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate((("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())))})

    sent = staged.select("rid", "part", "doc_id", "text").mapInArrow(send, "bucket int, part int, kind int, blob binary")
    path = scratch(spark, "suffix-marks")
    sent.groupBy("bucket").applyInArrow(find, "part int, kind int, blob binary").repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def _packed(columns: list[str]):
    return F.struct(*(named(c).alias(c) for c in columns)) if columns else F.lit(None).cast("int")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal runs that went) and kept (the remaining bytes, binary); columns
    of these names are replaced."""
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    carried = [c for c in docs.columns if c not in names]
    frame = docs.select(_packed([c for c in carried if c != text]).alias("_row"), named(key).cast("long").alias("doc_id"), text_of(text).alias("text"), named(text).isNull().alias("_null"))
    staged = stage(frame.withColumn("class", F.unhex(F.sha2("text", 256))), "suffix-docs")
    spark = staged.sparkSession
    # Rows of the least doc_id of their text; texts that can't hold a window need no part in it.
    able = staged.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select("class", "doc_id", "rid", "part")
    least = able.groupBy("class").agg(F.min("doc_id").alias("least"))
    first = able.join(least, "class").where(F.col("doc_id") == F.col("least")).select("rid", "part")
    representatives = scratch(spark, "suffix-representatives")
    first.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(representatives)

    folder = marks(staged, representatives)

    def open_part(part: int):
        found = side(folder, part)
        told = list(zip(found["kind"].to_pylist(), found["blob"].to_pylist())) if found is not None else []
        blobs = [[np.zeros(0, np.int64)] * 3, *(_unpack(b) for kind, b in told if kind == MARKS)]
        marked = merged(*(np.concatenate([b[k] for b in blobs]).astype(np.int64) for k in range(3)))
        blobs = [marked, *(twinned(*marked, *(x.astype(np.int64) for x in _unpack(b))) for kind, b in told if kind == TWINS)]
        row, start, end = (np.concatenate([b[k] for b in blobs]) for k in range(3))
        return merged(row, start, end + WINDOW - 1), _rows_of(representatives, part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ((row, start, end), own) in by_part(batches, open_part):
            rids = _column(batch, "rid").to_numpy()
            firsts = np.isin(rids, own)
            nulls = _column(batch, "doc_id").is_null().to_numpy(zero_copy_only=False)
            data, offsets = batch_bytes(_column(batch, "text"))
            raw = data.tobytes()
            at = rids & ((1 << 33) - 1)
            lo, hi = np.searchsorted(row, at, "left"), np.searchsorted(row, at, "right")
            removed, spans, kept = [], [], []
            for k in range(len(rids)):
                mine = raw[offsets[k] : offsets[k + 1]]
                if not nulls[k] and not firsts[k] and len(mine) >= WINDOW:
                    gaps = [(0, len(mine))]
                else:
                    gaps = list(zip(start[lo[k] : hi[k]].tolist(), end[lo[k] : hi[k]].tolist()))
                place, parts = 0, []
                for s, e in gaps:
                    parts.append(mine[place:s])
                    place = e
                parts.append(mine[place:])
                kept.append(b"".join(parts) if gaps else mine)
                removed.append(len(mine) - len(kept[-1]))
                spans.append(len(gaps))
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "_row"), _column(batch, "text"), _column(batch, "_null"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["_row", "text", "_null", *names],
            )

    kind = StructType([*(staged.schema[c] for c in ("_row", "text", "_null")), *(StructField(c, LongType()) for c in names[:3]), StructField("kept", BinaryType())])
    done = staged.select("rid", "part", "doc_id", "_row", "text", "_null").mapInArrow(cut, kind)
    back = [F.when(~F.col("_null"), F.col("text")).alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in carried]
    return done.select(*back, *names)
