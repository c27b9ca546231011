"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; each boosting round goes through the features in turn and fits a shallow tree
of one feature to the gradient of the logistic loss, whose leaves are added, shrunk, to that feature's lookup
table. Pairs of features are then ranked by what four quadrants over both gain on the rest, and the best ones
are boosted the same way into two-dimensional tables. A score is an intercept plus one table entry for each
feature and pair, vectorised over rows.

The model is fitted on the driver from at most TRAIN_ROWS labelled rows, those of the smallest hashes, so that
the same tables give the same model; their features, not their texts, are collected. Scoring is one Arrow scan with tables of a few kilobytes.

Defined results: null or empty text has features of its own (all 0) and gets a score; null labels aren't
learned from; without labelled rows every score is 0.5; labels of one class give that class; rows that repeat
a doc_id are scored row by row; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, batch_bytes, bounded_batches, text_of, words_of

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.15
LEAVES = 4
SMOOTH = 1.0  # added to a leaf's curvature

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "exclaims", "bars", "non_ascii", "commas",
    "same_as_before", "distinct_words", "lines", "line_length", "ended_lines", "repeated_lines", "longest_word", "braces",
)

_UPPER, _DIGIT, _SYMBOL, _MARK, _EXCLAIM, _BAR, _HIGH, _COMMA, _LINE, _BRACE = range(1, 11)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for kind, members in ((_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_SYMBOL, b"#*$%&<>"), (_MARK, b".?:;"), (_EXCLAIM, b"!"), (_BAR, b"|"), (_HIGH, range(192, 256)), (_COMMA, b","), (_LINE, b"\n"), (_BRACE, b"{}[]=\"\\/_")):
        table[list(members)] = kind
    return table


def features(column: pa.Array) -> np.ndarray:
    """(rows, features) of a string array, without a loop over rows."""
    data, offsets = batch_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    counts = np.bincount(row * np.int32(16) + _classes()[data], minlength=16 * n).reshape(n, 16).astype(float)
    starts, ends, first = words_of(data, offsets)
    words = np.diff(first).astype(float)
    per_word, size = 1 / np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    of = row[starts] if len(starts) else np.zeros(0, np.int32)
    prefix = PrefixHash(data)
    hashed = prefix.of(starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashed, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (of[order][1:] != of[order][:-1])
    lengths = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = np.where(data[line_ends - 1] == 10, line_ends - 1, line_ends)
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_row = row[line_starts] if len(line_starts) else np.zeros(0, np.int32)
    lines = np.bincount(line_row, minlength=n)
    last = data[line_ends - 1] if len(line_ends) else np.zeros(0, np.uint8)
    ended = np.isin(last, np.frombuffer(b".!?:;\"", np.uint8))
    line_hash = prefix.of(line_starts, line_ends)
    by_line = np.lexsort((line_hash, line_row))
    again = np.zeros(len(by_line), bool)
    again[1:] = (line_hash[by_line][1:] == line_hash[by_line][:-1]) & (line_row[by_line][1:] == line_row[by_line][:-1])
    per_line = 1 / np.maximum(lines, 1)

    columns = (
        np.log1p(words), np.bincount(of, lengths, n) * per_word, counts[:, _UPPER] / size, counts[:, _DIGIT] / size, counts[:, _SYMBOL] / size,
        counts[:, _MARK] * per_word, counts[:, _EXCLAIM] * per_word, counts[:, _BAR] * per_word, counts[:, _HIGH] / size, counts[:, _COMMA] * per_word,
        np.bincount(of, same, n) * per_word, np.bincount(of[order], new, n) * per_word, np.log1p(lines), np.log1p(words * per_line),
        np.bincount(line_row, ended, n) * per_line, np.bincount(line_row[by_line], again, n) * per_line, np.log1p(longest), counts[:, _BRACE] / size,
    )
    for k, x in enumerate(columns):
        out[:, k] = x
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """A leaf value for each bin: the ordered bins are cut, best cut first, into LEAVES runs at most."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(curve)))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTH)
    runs = [(0, len(grad))]
    while len(runs) < LEAVES:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(runs):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gains = worth(a, cut) + worth(cut, b) - worth(a, b)
                best = max(best, (float(gains.max()), k, int(cut[gains.argmax()])))
        if not best[2]:
            break
        a, b = runs[best[1]]
        runs[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(grad))
    for a, b in runs:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTH)
    return out


def _quadrants(grad: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features at once: its worth and the value of each cell."""
    g, h = grad.cumsum(0).cumsum(1), curve.cumsum(0).cumsum(1)
    n = len(grad)
    sides = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    parts = list(zip(sides(g), sides(h)))
    total = sum(x**2 / (y + SMOOTH) for x, y in parts)
    i, j = np.unravel_index(total.argmax(), total.shape)
    out = np.empty_like(grad)
    low_i, low_j = np.arange(n)[:, None] <= i, np.arange(n)[None, :] <= j
    for (x, y), where in zip(parts, (low_i & low_j, low_i & ~low_j, ~low_i & low_j, ~low_i & ~low_j)):
        np.copyto(out, (x / (y + SMOOTH))[i, j], where=where)
    return float(total[i, j]), out


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[:, i], b[:, j]]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: (rows, features), y: 0 or 1."""
    if not len(y):
        return Model([np.zeros(0)] * len(FEATURES))
    model = Model([np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.intercept = float(np.log(share / (1 - share)))
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS if 0 < y.mean() < 1 else 0):
        for k, table in enumerate(model.tables):
            p = _sigmoid(total)
            step = RATE * _tree(np.bincount(b[:, k], y - p, BINS), np.bincount(b[:, k], p * (1 - p), BINS))
            table += step
            total += step[b[:, k]]

    def cells(i: int, j: int) -> tuple[float, np.ndarray]:
        p, at = _sigmoid(total), b[:, i] * BINS + b[:, j]
        return _quadrants(np.bincount(at, y - p, BINS * BINS).reshape(BINS, BINS), np.bincount(at, p * (1 - p), BINS * BINS).reshape(BINS, BINS))

    ranked = sorted(((cells(i, j)[0], (i, j)) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [pair for _, pair in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((BINS, BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS if 0 < y.mean() < 1 else 0):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * cells(i, j)[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that aren't held out."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    n = known.count()
    share = min(1.0, 2 * rows / max(n, 1))  # so that few rows more than needed are sorted
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 30))
    chosen = known.where(place <= int(share * (1 << 30))).orderBy(place, "_key", "_label").limit(rows)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = features(column)
            yield pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))

    joined = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(F.broadcast(chosen), "_key")  # `rows` bounds it
    told = joined.select("_key", "_label", F.xxhash64("_text").alias("_hash"), F.arrow_udf(run, "array<double>")("_text").alias("_x"))
    found = told.orderBy(place, "_key", "_label", "_hash").limit(rows).select("_x", "_label").toPandas()
    x = np.array(found["_x"].tolist(), float).reshape(-1, len(FEATURES))
    y = found["_label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order rows arrive in
    return fit(x[order], y[order])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with a score from 0 to 1, higher where label 1 is likelier."""
    bounded_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(model.score(features(column)))

    return df.withColumn(into, F.arrow_udf(run, "double")(text_of(text)))
