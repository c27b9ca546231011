"""Nearest neighbours by cosine: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Unit vectors are cut into pairs of components, each pair coded in four bits. Codebooks and codes minimise a
loss that weighs the part of the residual parallel to the vector PARALLEL times as much as the rest: that part
is what changes the scores of the vectors that matter, those nearly parallel to a query. Codebooks are fitted
on a bounded sample (SAMPLE vectors, chosen by hash); every row is indexed.

A search is a stated query set against all rows, in blocks: each task gathers a slab of rows, reads the
queries block by block from the shared folder, adds table entries for the codes, keeps each query's CANDIDATES
best rows of the slab, scores those exactly in double precision, and returns its five best. So a query gets
rows by slab and not by vector; the rest is a window over few rows for each query.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite
component take no part, nor do null vec_ids; rows that repeat a vec_id count once, with the best score (as a
query, with the least vector); equal scores go by smaller vec_id: of equal vectors in a slab only the
k + 1 smallest vec_ids are scored, which loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, scratch

SAMPLE = 16_384
PAIR = 2  # components to a four-bit code
PARALLEL = 4.0
ROUNDS = 6
SLAB = 32_768  # rows, fewer if they have more than SLAB_BYTES
SLAB_BYTES = 64 << 20
SOLVED = 32  # pairs whose centres are solved for at once
QUERY_BLOCK = 64
CANDIDATES = 256


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and no square over- or underflows."""
    if not x.size:
        return x
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


class Codebooks:
    """centres: (pairs, 16, 2). Vectors are padded with a zero to an even length."""

    def __init__(self, sample: np.ndarray, rounds: int = ROUNDS, seed: int = 5):
        x = self.pad(sample)
        n, m = len(x), x.shape[1] // PAIR
        rng = np.random.default_rng(seed)
        parts = x.reshape(n, m, PAIR)
        self.centres = np.stack([parts[rng.choice(n, 16, replace=n < 16), k] for k in range(m)]) if n else np.zeros((m, 16, PAIR))
        for _ in range(rounds):  # plain k-means of each pair
            codes = self._nearest(parts)
            for k in range(m):
                for d in range(PAIR):
                    total, count = np.bincount(codes[:, k], parts[:, k, d], 16), np.bincount(codes[:, k], minlength=16)
                    self.centres[k, :, d] = np.where(count > 0, total / np.maximum(count, 1), self.centres[k, :, d])
        for _ in range(rounds if n else 0):  # then all pairs together, by the anisotropic loss
            self._solve(parts, self.encode(sample))

    @staticmethod
    def pad(x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
        return np.pad(x, ((0, 0), (0, -x.shape[1] % PAIR)))

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        codes = np.empty(parts.shape[:2], np.int64)
        for k, c in enumerate(self.centres):
            codes[:, k] = np.argmin((c**2).sum(1) - 2 * parts[:, k] @ c.T, 1)
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, pairs) by coordinate descent on the anisotropic loss."""
        x = self.pad(x)
        parts = x.reshape(len(x), -1, PAIR)
        codes = self._nearest(parts)
        along = 1.0 - sum(np.einsum("id,id->i", parts[:, k], c[codes[:, k]]) for k, c in enumerate(self.centres))  # of the residual, times x
        for _ in range(2):
            for k, c in enumerate(self.centres):
                shares = parts[:, k] @ c.T
                rest = along + shares[np.arange(len(x)), codes[:, k]]
                loss = (c**2).sum(1) - 2 * shares + (PARALLEL - 1) * (rest[:, None] - shares) ** 2
                codes[:, k] = np.argmin(loss, 1)
                along = rest - shares[np.arange(len(x)), codes[:, k]]
        return codes

    def _solve(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """The centres of less loss for these codes: a linear system for SOLVED pairs at a time, the others held."""
        n, m = codes.shape
        along = 1.0 - sum(np.einsum("id,id->i", parts[:, k], c[codes[:, k]]) for k, c in enumerate(self.centres))
        for first in range(0, m, SOLVED):
            own = np.arange(first, min(m, first + SOLVED))
            size = len(own) * 16 * PAIR
            for k in own:
                along += np.einsum("id,id->i", parts[:, k], self.centres[k][codes[:, k]])
            a, b, counts = np.zeros((size, size)), np.zeros(size), np.zeros(size)
            for lo in range(0, n, 4096):
                rows = (((own - first) * 16 + codes[lo : lo + 4096, own]) * PAIR)[:, :, None] + np.arange(PAIR)
                rows = rows.reshape(len(rows), -1)
                g = np.zeros((len(rows), size))
                np.put_along_axis(g, rows, parts[lo : lo + 4096, own].reshape(len(rows), -1), 1)
                a += (PARALLEL - 1) * g.T @ g
                b += (PARALLEL - 1) * g.T @ along[lo : lo + 4096] + g.sum(0)
                counts += np.bincount(rows.ravel(), minlength=size)
            a[np.diag_indices(size)] += counts + 1e-3
            self.centres[own] = np.linalg.solve(a, b + 1e-3 * self.centres[own].ravel()).reshape(len(own), 16, PAIR)
            for k in own:
                along -= np.einsum("id,id->i", parts[:, k], self.centres[k][codes[:, k]])

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): the score that each value of a code byte, two codes, adds; 16-bit integers of one scale."""
        q = self.pad(queries).reshape(len(queries), -1, PAIR)
        one = np.einsum("qmd,mcd->mcq", q, self.centres)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros((1, *one.shape[1:]))])
        both = one[0::2, :, None, :] + one[1::2, None, :, :]
        both = both.reshape(len(both), 256, -1)
        scale = 32_000 / max(1e-12, np.abs(both).max(1).sum(0).max())
        return np.rint(both * scale).astype(np.int16)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)


def best(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, books: Codebooks, k: int):
    """(query, vec_id, score) arrays: each query's k best rows of a slab, by table scan and exact reranking. ids ascend."""
    vectors, queries = scaled(vectors), scaled(queries)
    norms = np.sqrt((vectors * vectors).sum(1))
    tables = books.tables(queries)
    sums = np.zeros((len(ids), len(queries)), np.int32)
    for byte in range(codes.shape[1]):
        sums += tables[byte][codes[:, byte]]
    m = min(len(ids), CANDIDATES + 1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(len(queries)):
        rows = np.sort(np.argpartition(-sums[:, j], m - 1)[:m]) if m < len(ids) else np.arange(len(ids))
        rows = rows[ids[rows] != query_ids[j]]
        q = queries[j]
        score = (vectors[rows] * q).sum(1) / (norms[rows] * np.sqrt((q * q).sum()))
        first = np.lexsort((ids[rows], -score))
        taken = ids[rows][first]
        fresh = first[np.sort(np.unique(taken, return_index=True)[1])][:k]
        out.append((np.full(len(fresh), query_ids[j]), ids[rows][fresh], score[fresh]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _thinned(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Rows without those that have `keep` equal vectors of smaller vec_id. ids ascend."""
    void = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(void, return_inverse=True)
    order = np.lexsort((ids, group))
    sorted_ids, sorted_group = ids[order], group[order]
    new = np.concatenate(([True], (sorted_group[1:] != sorted_group[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])))
    distinct = np.cumsum(new)
    start = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1])))
    nth = distinct - np.repeat(distinct[start], np.diff(np.append(start, len(ids))))
    return np.sort(order[new & (nth < keep)])


def valid(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part; those of other lengths than the commonest don't, with a warning."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~odd & F.exists(x, lambda v: v != 0.0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    if len(lengths) > 1:
        warnings.warn(f"vectors of other lengths than {lengths[0]['n']} take no part", stacklevel=2)
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame) -> Codebooks | None:
    """Codebooks from SAMPLE rows at most, those of the smallest hashes; None for an empty table."""
    n = rows.count()
    if not n:
        return None
    share = min(1.0, 2 * SAMPLE / n)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.where(place <= int(share * (1 << 30))).orderBy(place, "vec_id", "embedding").limit(SAMPLE)
    return Codebooks(_matrix(sample.select("embedding").toArrow()["embedding"].combine_chunks()))


def index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Every row with its codes, two to a byte."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = packed(books.encode(_matrix(batch.column(1)))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "codes"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, codes binary")


def search(indexed: DataFrame, queries: DataFrame, books: Codebooks, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows, other than rows of its own vec_id."""
    spark = indexed.sparkSession
    where = scratch(spark, "ann-queries")
    queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).write.parquet(where)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        from pyarrow import dataset

        fs, at = filesystem(where)
        for batch in dataset.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))

    def slab(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["vec_id"].to_numpy()
        vectors = _matrix(table["embedding"].combine_chunks() if isinstance(table["embedding"], pa.ChunkedArray) else table["embedding"])
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, vectors, codes = ids[order], vectors[order], codes[order]
        keep = _thinned(ids, vectors, k + 1)
        ids, vectors, codes = ids[keep], vectors[keep], codes[keep]
        for query_ids, own in blocks():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(ids, vectors, codes, query_ids, own, books, k)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= min(SLAB, max(1024, SLAB_BYTES // (8 * len(batch.column(1)[0])))):
                yield from slab(held)
                held, n = [], 0
        if n:
            yield from slab(held)

    found = indexed.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """search() of the rows whose vec_id is divisible by `every` against all rows."""
    rows = valid(df)
    books = fit(rows)
    if books is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index(rows, books), rows.where(F.col("vec_id") % every == 0), books, k)
