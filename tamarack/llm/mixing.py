"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about equal numbers of documents, and the source's
target becomes an exact quota of block draws: whole passes over all blocks, then whole blocks in an order
permuted by seed, then documents of one last block. A binary tree over the output shards splits the vector of
quotas: a node gives the left half of its shards a number of draws of each source by a multivariate
hypergeometric draw without replacement, so quotas stay exact and sources spread evenly. A shard's draws are
disjoint ranges of the permuted blocks; where the tree's leaves put a block is where its documents go, and a
document is taken as often as it has places. A shard's documents are shuffled locally, by hash.

The last block gives the documents that bring its source nearest the target: from the largest down each that
still fits, then the smallest one left if that comes nearer. So a source ends within half of the smallest
document left of the group chosen from. A block of more than LAST documents is first cut into smaller ones, of
which whole ones are taken likewise; so no task holds more than about LAST documents of a source.

What reaches the driver is a row per source and a sum per block (MAX_BLOCKS in all, and one per source more);
documents are staged once, and every later pass reads a few numbers of each. The hot source has the most
blocks and is never collected in a task.

Defined results: null or empty text has size 0; a null source is a source of its own, last in order; a source
of size 0 has target 0; rows that repeat a document are documents of their own: equal rows are told apart by a
running number, so that they go to blocks of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, named, stored, text_of
from .parts import stage

#: More sources than this are an error, raised before anything is taken: the plan is made on the driver.
MAX_SOURCES = 100_000
MAX_BLOCKS = 1 << 18
BLOCK_DOCS = 64  # documents that a block has at least, unless its source has fewer
LAST = 4096  # documents of a source that are chosen from one by one, at most
LASTS = 1_000_000  # and those of all sources
COPIES = 2  # no source, and no document, is taken more often
SHARD_WORDS = 8_000_000  # words of a shard, as long as there are draws enough
LEAST_SHARDS = 8


@dataclass
class Share:
    """A source's part of the plan. passes: over all blocks; order: of blocks, permuted; extra: how many of that order are
    drawn once more; partial: the block that is drawn in part (-1: none) and rest, the words it should give."""

    source: str | None
    docs: int
    blocks: int
    size: int = 0
    target: float = 0.0
    passes: int = 0
    order: np.ndarray | None = None
    extra: int = 0
    partial: int = -1
    rest: float = 0.0
    shards: list[list[int]] | None = None


def weigh(n: int) -> list[int]:
    """Weights of sources in order: 3, 1, 2, repeating."""
    return [(3, 1, 2)[k % 3] for k in range(n)]


def targets(sizes: list[int], weights: list[int], share: float = 1.5, most: float = COPIES) -> list[float]:
    """share of all sizes by weight, each at most `most` times its size, the excess shared again by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k])  # those that fill up first
    total = sum(weights)
    for k in order:
        out[k] = float(min(most * sizes[k], left * weights[k] / total))
        left, total = left - out[k], total - weights[k]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The tree's leaves from left to right: shard, its sources, and its draws of each. Sources without draws and shards
    without sources are left out, so the work is in proportion to draws and depth."""

    def node(first: int, n: int, sources: np.ndarray, draws: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(draws):
            return
        if n == 1:
            yield first, sources, draws
            return
        left = n // 2
        given = rng.multivariate_hypergeometric(draws, round(int(draws.sum()) * left / n), method="marginals")
        for at, size, part in ((first, left, given), (first + left, n - left, draws - given)):
            yield from node(at, size, sources[part > 0], part[part > 0])

    some = np.flatnonzero(quotas)
    yield from node(0, shards, some, quotas[some])


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def nearest(sizes: np.ndarray, rest: float) -> np.ndarray:
    """Which documents come near rest: from the largest down each that still fits, then the smallest one left if that is
    nearer. sizes in an order of the caller's, which settles ties."""
    taken, left = np.zeros(len(sizes), bool), rest
    order = np.argsort(-sizes, kind="stable")
    for k in order:
        if 0 < sizes[k] <= left:
            taken[k], left = True, left - sizes[k]
    others = [k for k in order if sizes[k] > 0 and not taken[k]]
    if others and sizes[others[-1]] - left < left:
        taken[others[-1]] = True
    return taken


def _told_apart(staged: DataFrame) -> DataFrame:
    """staged with a rank that equal rows don't share: the first keeps it, others get one by their running number. Rows
    of a rank are counted by the part they are in, so that many equal rows aren't brought together."""
    by_rank = Window.partitionBy("rank")
    counts = staged.groupBy("rank", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(by_rank)).where("`all` > 1")
    before = F.coalesce(F.sum("n").over(by_rank.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    repeats = stored(counts.select("rank", "part", before.alias("before")), "mix-repeats")
    if not repeats.limit(1).count():
        return staged
    nth = F.col("before") + F.row_number().over(Window.partitionBy("rank", "part").orderBy("rid")) - 1
    again = staged.select("rid", "rank", "part").join(repeats, ["rank", "part"]).select("rid", "rank", nth.alias("nth")).where("nth > 0").select("rid", F.xxhash64("rank", "nth").alias("other"))
    return staged.join(stored(again, "mix-again"), "rid", "left").withColumn("rank", F.coalesce("other", "rank")).drop("other")


def _shares(counts: list[tuple[str | None, int]]) -> list[Share]:
    most = max(1, MAX_BLOCKS // max(1, len(counts)))
    return [Share(source, docs, min(most, max(1, docs // BLOCK_DOCS))) for source, docs in sorted(counts, key=lambda x: (x[0] is None, x[0] or ""))]


def _planned(shares: list[Share], words: list[np.ndarray], seed: int, shards: int | None) -> int:
    """Sizes, targets, quotas and the tree; returns the number of shards."""
    for share, sums in zip(shares, words):
        share.size = int(sums.sum())
    rng = np.random.default_rng(seed)
    for share, sums, target in zip(shares, words, targets([s.size for s in shares], weigh(len(shares)))):
        share.target = target
        share.passes = int(target // share.size) if share.size else 0
        share.order = rng.permutation(share.blocks)
        left = target - share.passes * share.size
        if share.passes < COPIES and left > 0:
            ends = np.cumsum(sums[share.order])
            share.extra = int(np.searchsorted(ends, left, "right"))  # so many whole blocks fit
            share.rest = float(left - (ends[share.extra - 1] if share.extra else 0))
            if share.extra < share.blocks and share.rest > 0:
                share.partial = int(share.order[share.extra])
    quotas = np.array([s.passes * s.blocks + s.extra + (s.partial >= 0) for s in shares], np.int64)
    if shards is None:
        wanted = -(-int(sum(s.target for s in shares)) // SHARD_WORDS)
        shards = max(LEAST_SHARDS, min(wanted, int(quotas.sum()) // 2))
    of: list[list[np.ndarray]] = [[] for _ in shares]
    for shard, sources, draws in split(quotas, shards, rng):
        for k, n in zip(sources.tolist(), draws.tolist()):
            of[k].append(np.full(n, shard))
    for share, dealt in zip(shares, of):
        places = np.concatenate(dealt) if dealt else np.zeros(0, np.int64)  # a shard for each draw, in permuted order
        share.shards = []
        for p in range(COPIES):
            row = np.full(share.blocks, -1)
            part = places[p * share.blocks : (p + 1) * share.blocks]
            row[share.order[: len(part)]] = part
            share.shards.append(row.tolist())
    return shards


def _dealt(df: DataFrame, seed: int, shards: int | None, key: str, text: str, source: str, carried: list[str]) -> tuple[DataFrame, int]:
    """Rows with _row (the carried columns), size, source_size, target and places; and the number of shards."""
    spark = df.sparkSession
    row = F.struct(*(named(c).alias(c) for c in carried)) if carried else F.lit(None).cast("int")
    rank = F.xxhash64(F.lit(seed), named(key), named(text))
    staged = stage(df.select(row.alias("_row"), named(source).cast("string").alias("source"), size_of(text).alias("size"), rank.alias("rank")), "mix-docs")
    counts = [tuple(r) for r in staged.groupBy("source").agg(F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()]
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = _shares(counts)
    ranked = _told_apart(staged)

    def beside(rows: DataFrame, kind: str, values: list[tuple]) -> DataFrame:
        """Rows with what the plan has of their source; at most MAX_SOURCES rows and twice MAX_BLOCKS and as many numbers are broadcast."""
        told = spark.createDataFrame([(s.source, *v) for s, v in zip(shares, values)], f"_source string, {kind}")
        return rows.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    block = F.pmod("rank", F.col("blocks")).cast("int")
    sums = beside(ranked.select("source", "size", "rank"), "id int, blocks int", [(k, s.blocks) for k, s in enumerate(shares)])
    words, docs = ([np.zeros(s.blocks, np.int64) for s in shares] for _ in range(2))
    for r in sums.groupBy("id", block.alias("block")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).toLocalIterator():
        words[r["id"]][r["block"]], docs[r["id"]][r["block"]] = r["words"], r["docs"]
    shards = _planned(shares, words, seed, shards)

    # The block taken in part: smaller blocks of it while they fit, then the documents of one that come nearest.
    most = max(16, min(LAST, LASTS // max(1, len(shares))))
    cuts = [max(1, -(-int(docs[k][s.partial]) // most)) if s.partial >= 0 else 1 for k, s in enumerate(shares)]
    cut = F.pmod(F.xxhash64("rank"), F.col("cuts")).cast("int")
    partly = beside(ranked.select("source", "size", "rank", "rid"), "id int, blocks int, partial int, cuts int", [(k, s.blocks, s.partial, c) for k, (s, c) in enumerate(zip(shares, cuts))])
    partly = stored(partly.where(block == F.col("partial")).select("id", "size", "rank", "rid", cut.alias("cut")), "mix-partly")
    whole, last, rest = [0] * len(shares), [0] * len(shares), [s.rest for s in shares]
    if max(cuts, default=1) > 1:
        by_cut: list[dict[int, int]] = [{} for _ in shares]
        for r in partly.groupBy("id", "cut").agg(F.sum("size").alias("words")).toLocalIterator():
            by_cut[r["id"]][r["cut"]] = r["words"]
        for k, c in enumerate(cuts):
            while last[k] < c - 1 and by_cut[k].get(last[k], 0) <= rest[k]:  # cuts below `whole` are taken
                rest[k] -= by_cut[k].get(last[k], 0)
                last[k] += 1
            whole[k] = last[k]

    def choose(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["rid"].to_numpy(), table["rank"].to_numpy()))
        taken = nearest(table["size"].to_numpy()[order], rest[table["id"][0].as_py()])
        return pa.table({"rid": table["rid"].to_numpy()[order][taken]})

    lasts = spark.createDataFrame([(k, c) for k, c in enumerate(last)], "id int, last int")
    chosen = partly.join(F.broadcast(lasts), "id").where(F.col("cut") == F.col("last")).select("id", "size", "rank", "rid").groupBy("id").applyInArrow(choose, "rid long")
    chosen = stored(chosen, "mix-chosen").select("rid", F.lit(True).alias("chosen"))

    kind = "source_size long, target double, blocks int, passes int, partial int, cuts int, whole int, shards array<array<int>>"
    at = beside(ranked, kind, [(s.size, s.target, s.blocks, s.passes, s.partial, c, w, s.shards) for s, c, w in zip(shares, cuts, whole)])
    at = at.join(F.broadcast(chosen), "rid", "left")  # LASTS rows at most, or 16 a source
    left_out = (block == F.col("partial")) & ~((cut < F.col("whole")) | F.coalesce("chosen", F.lit(False)))
    drawn = (F.when((F.col("passes") == p) & left_out, -1).otherwise(F.coalesce(F.get(F.get("shards", F.lit(p)), block), F.lit(-1))) for p in range(COPIES))
    places = F.filter(F.array(*drawn), lambda shard: shard >= 0)
    return at.select("_row", "size", "source_size", "target", places.alias("places")), shards


def mix(df: DataFrame, seed: int = 17, shards: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", carried: list[str] | None = None) -> DataFrame:
    """df's documents, each once, with size, source_size, target, places (the shard of each copy that is taken), copies
    (how many, 0 to 2) and taken (size times copies). Columns of df (or those of them that are carried) come along;
    columns of these names are replaced. shards: by the mix's size if not given."""
    own = ["size", "source_size", "target", "copies", "taken", "places"]
    kept = [c for c in (df.columns if carried is None else carried) if c not in own]
    rows, _ = _dealt(df, seed, shards, key, text, source, kept)
    copies = F.size("places")
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in kept), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "places")


def mixed(df: DataFrame, seed: int = 17, shards: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: a row for each copy taken, with df's columns, dealt to its shard and shuffled there by hash."""
    found, n = _dealt(df, seed, shards, key, text, source, df.columns)
    rows = found.select("_row", F.posexplode("places").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col("_row").getField(key), F.col("_row").getField(text), "copy")
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", order)
    return dealt.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))
