"""N-gram Jaccard self-join with adaptive multi-match prefixes.

1. Documents are staged once. A pass over them takes each document's set of shingle hashes; equal sets form a
   class, whose least row represents it; shingles are counted over all rows (parts.frequencies).
2. A second pass orders each representative's shingles rarest first. Shingles that no other row has can't be
   shared: a document with fewer than ceil(0.75 n) others links with nothing and goes no further. The rest get
   a prefix: two documents that link share at least l of the first n - ceil(0.75 n) + l shingles of each. Every
   document takes the l, of LEVELS, with the least estimated cost: index entries, plus candidates, that is the
   frequencies in the prefix divided by l. With documents of its own size or larger a document shares 6/7 of its
   shingles, so against those a shorter prefix, its head, will do.
3. Candidates are pairs of documents under one shingle, in the head of the smaller one and the prefix of the
   other, that share min(l) such shingles, agree in size, and pass a bound on the symmetric difference from parity
   bitmaps, all exact filters; their sets are compared. Documents of one template that have more of their own than
   links allow have none of the template in their heads, so a family that doesn't link makes no pairs.
   join() takes all of them and so has every link; a large group is paired block by block, and its pairs grow with
   the square of its size, as its links may.
4. connect() is for components alone and leaves out links that can't change them: in a few rounds, members of a
   group are chained, each to the one before in an order of that shingle's own; verified links are contracted to
   components, and groups inside one component drop out. Last come all candidates across components, a large group
   block by block as in join().

Nothing is capped. join() compares every candidate; connect() only those whose sides no component joins yet, so
its components are those of join(), its links a part of them. Hashes have 64 bits.

Defined results: null or empty text, or one without words, has an empty set and no link; fewer words than five
are one shingle; equal doc_ids on several rows are rows of their own, and a component is named by its least
doc_id (null doc_ids only if it has no other); extra columns are carried along by dedupe(); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PrefixHash, batch_bytes, mix64, named, scratch, stored, words_of
from .components import components
from .parts import Known, bucket_bits, by_part, frequencies, side, stage

WORDS = 5
PERCENT = 75
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
CHAINS = (8, 4, 2)  # a round each: one in so many shingles' groups is chained
CHAIN = 1000
BLOCK = 500  # members of a group that a task pairs with as many others
ABOUT = ("rid", "n", "level", "alone", "bitmap")  # what an entry says of its document
BITMAP = 8  # longs of a parity bitmap
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, ascending, end to end, and the rows' offsets."""
    data, offsets = batch_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = words_of(data, offsets)
    hashed = mix64(PrefixHash(data).of(starts, ends) + (ends - starts).astype(np.uint64))
    n = len(hashed)
    factor = lambda k: np.uint64((_FACTORS[k % 5] * (2 * (k // 5) + 1)) & (2**64 - 1))
    every = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        every += hashed[k : n - words + 1 + k] * factor(k) if n >= words else 0
    every = mix64(every)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for row in range(len(sizes)):
        lo, hi = first[row], first[row + 1]
        if hi - lo >= words:
            own = np.unique(every[lo : hi - words + 1])
        elif hi > lo:
            own = mix64(np.array([sum(int(h) * int(factor(k)) for k, h in enumerate(hashed[lo:hi])) + int(hi - lo) & (2**64 - 1)], np.uint64))
        else:
            continue
        sizes[row] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _needed(n: int) -> int:
    """Shingles that a set of n shares with any set it links with."""
    return -(-PERCENT * n // 100)


def _needed_of_smaller(n: int) -> int:
    """Shingles that a set of n shares with any set of its own size or larger that it links with."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def _level(counts: np.ndarray, n: int, alone: int) -> tuple[int, int]:
    """(l, prefix entries) of least cost for a document whose shared shingles' frequencies ascend; alone: shingles it shares with none."""
    candidates = np.concatenate(([0], np.cumsum(counts - 1.0)))
    best = (np.inf, 1, 0)
    for level in LEVELS:
        entries = n - _needed(n) + level - alone
        if entries < level:
            return 0, 0  # a document that links has so many
        if level > 1 and entries > len(counts):
            break
        entries = min(entries, len(counts))
        best = min(best, (entries + candidates[entries] / level, level, entries))
    return best[1], best[2]


@dataclass
class Found:
    """sets: rid, doc_id, n, class id; roots: rid of a class's representative to its component's least rid; links: verified
    pairs of representatives, all of them from join() and enough for the components from connect(). join() gives classes
    their number of links, n_links: the classes that a class links with."""

    staged: DataFrame
    sets: DataFrame
    classes: DataFrame
    links: DataFrame
    roots: DataFrame


def _sets(staged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            every, cut = shingles(_text(batch))
            names = [xxhash.xxh3_128_digest(every[a:b].tobytes()) if b > a else None for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cut)), pa.array(names, pa.binary())], names=["rid", "part", "doc_id", "n", "class"])

    return stored(staged.select("rid", "part", "doc_id", "text").mapInArrow(run, "rid long, part int, doc_id long, n long, class binary"), "jaccard-sets")


def _indexed(staged: DataFrame, known: str, representatives: str) -> DataFrame:
    """Representatives that can link: rid, n, level, prefix (hashes; the first `heads` of it are the head), tokens (shared hashes, ascending), bitmap."""
    bits = bucket_bits(staged.sparkSession)

    def open_part(part: int):
        rows = side(representatives, part)
        return Known(known, part, bits), np.sort(rows["rid"].to_numpy()) if rows is not None else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (counts, own) in by_part(batches, open_part):
            every, cut = shingles(_text(batch))
            rids = batch.column(0).to_numpy()
            often = counts.of(every)
            chosen = np.isin(rids, own)
            shared = np.concatenate(([0], np.cumsum(often > 1)))[cut]
            rows = []
            for row in np.flatnonzero(chosen & (100 * np.diff(shared) >= PERCENT * np.diff(cut)) & (np.diff(cut) > 0)):
                tokens, freq = every[cut[row] : cut[row + 1]], often[cut[row] : cut[row + 1]]
                n = len(tokens)
                tokens, freq = tokens[freq > 1], freq[freq > 1]
                order = np.lexsort((tokens, freq))
                level, entries = _level(freq[order], n, n - len(tokens))
                if level:
                    odd = np.bincount((tokens >> np.uint64(13)).astype(np.int64) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
                    bitmap = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    heads = n - _needed_of_smaller(n) + level - (n - len(tokens))
                    rows.append((int(rids[row]), n, level, heads, tokens[order[:entries]].view(np.int64), tokens.tobytes(), bitmap))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["rid", "n", "level", "heads", "prefix", "tokens", "bitmap"])

    found = staged.select("rid", "part", "text").mapInArrow(run, "rid long, n long, level int, heads long, prefix array<long>, tokens binary, bitmap array<long>")
    return stored(found, "jaccard-index")


def _possible(a: str, b: str) -> Column:
    """Sizes and parity bitmaps leave it possible that a and b link: exact bounds, from columns <a>_n, <a>_bitmap."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    least = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    differ = sum((F.bit_count(F.get(f"{a}_bitmap", F.lit(k)).bitwiseXOR(F.get(f"{b}_bitmap", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
    alone = F.col(f"{a}_alone") + F.col(f"{b}_alone")  # not in the bitmaps
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (differ + alone <= n + m - 2 * least)


def _overlap(lefts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in lefts:
        yield pa.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


def _verified(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Of pairs (a, b) of rids those that link, by comparing their sets."""
    side_of = lambda x: index.select(F.col("rid").alias(x), F.col("n").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side_of("a"), "a").join(side_of("b"), "b")
    common = both.withColumn("common", F.arrow_udf(_overlap, "long")("a_tokens", "b_tokens"))
    return common.where(100 * F.col("common") >= PERCENT * (F.col("a_n") + F.col("b_n") - F.col("common"))).select("a", "b")


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Staged rows, sets, classes, index of representatives and their entries under shared prefix shingles."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    row = F.struct(*(named(c).alias(c) for c in others)) if others else F.lit(None).cast("int")
    frame = docs.select(row.alias("_row"), named(key).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    staged = stage(frame, "jaccard-docs")
    sets = _sets(staged)
    known = frequencies(staged, ["text"], lambda batch: shingles(_text(batch))[0], "jaccard-counts")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "part")).alias("r")
    classes = stored(sets.where("n > 0").groupBy("class").agg(least, F.count(F.lit(1)).alias("copies")).select("class", "copies", F.col("r.rid").alias("rep"), F.col("r.doc_id").alias("least"), F.col("r.part").alias("part")), "jaccard-classes")
    representatives = scratch(spark, "jaccard-representatives")
    classes.select(F.col("rep").alias("rid"), "part").repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(representatives)
    index = _indexed(staged, known, representatives)

    alone = (F.col("n") - F.expr("length(tokens) / 8").cast("long")).alias("alone")
    entries = index.select("rid", "n", "level", alone, "bitmap", "heads", F.posexplode("prefix").alias("place", "token")).withColumn("head", F.col("place") < F.col("heads")).drop("heads", "place")
    sizes = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = stored(entries.join(sizes, "token"), "jaccard-entries")
    return staged, sets, classes, index, entries


def _candidates(entries: DataFrame, apart: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of entries that meet under a token, in the head of the smaller one, and pass the exact filters. Two
    members of a group meet once, under the pair of their blocks, so that a hot group is many tasks. apart: a further
    condition, on columns x_... and y_... of ABOUT and `also`."""
    groups = entries.groupBy("token").agg(F.count_if("head").alias("heads"), F.count(F.lit(1)).alias("all")).where("heads > 0 and `all` > 1")
    rows = entries.join(groups, "token")
    cut = lambda c: F.ceil(F.col(c) / BLOCK)
    own = lambda c: F.pmod(F.xxhash64(F.lit(0), "rid"), cut(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), cut(c) - 1))
    sided = lambda side: (F.col(c).alias(f"{side}_{c}") for c in (*ABOUT, *also))
    x = rows.where("head").select("token", own("heads").alias("i"), every("all").alias("j"), *sided("x"))
    y = rows.select("token", every("heads").alias("i"), own("all").alias("j"), *sided("y"))
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_rid") < F.col("y_rid")))
    met = x.join(y, ["token", "i", "j"]).where(smaller & _possible("x", "y"))
    met = met if apart is None else met.where(apart)
    shared = met.groupBy("x_rid", "y_rid").agg(F.count(F.lit(1)).alias("common"), F.first(F.least("x_level", "y_level")).alias("level")).where("common >= level")
    return shared.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Found:
    """Find all links of docs."""
    staged, sets, classes, index, entries = _prepared(docs, key, text)
    pairs = stored(_candidates(entries), "jaccard-pairs")
    links = stored(_verified(pairs, index), "jaccard-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    classes = stored(classes.join(ends, "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "jaccard-counted")
    return Found(staged, sets, classes, links, stored(components(links), "jaccard-roots"))


def linked(found: Found) -> DataFrame:
    """rid, doc_id and n_links, the number of other rows that a row links with, for what join() found."""
    both = found.links.union(found.links.select("b", "a"))
    others = both.join(found.classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    classes = found.classes.join(others, "rep", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return found.sets.join(classes, "class", "left").select("rid", "doc_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def connect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Found:
    """Find the components of docs: as many links as make them, not all."""
    spark = docs.sparkSession
    staged, sets, classes, index, entries = _prepared(docs, key, text)
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    tried = spark.createDataFrame([], "a long, b long")
    open_entries = entries.withColumn("root", F.col("rid"))
    for k, share in enumerate(CHAINS):
        # Members of some shingles' groups, in an order of each shingle's own, are paired with the one before.
        some = open_entries.where(F.pmod(F.xxhash64(F.lit(k), "token"), F.lit(share)) == 0)
        salt = F.pmod(F.xxhash64(F.lit(k), "rid"), F.ceil(F.col("size") / CHAIN))  # so that a hot group is many chains
        order = Window.partitionBy("token", "salt").orderBy(F.xxhash64(F.lit(k), "token", "rid"), "rid")
        other = F.lag(F.struct(*ABOUT, "root")).over(order)
        chain = some.withColumn("salt", salt).withColumn("other", other).where("root <> other.root")
        flat = chain.select(*(F.col(c).alias(f"x_{c}") for c in ABOUT), *(F.col(f"other.{c}").alias(f"y_{c}") for c in ABOUT))
        pairs = flat.where(_possible("x", "y")).select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-chain")
        tried = tried.union(pairs)
        links = stored(links.union(_verified(pairs, index)), "jaccard-links")
        roots = stored(components(links), "jaccard-roots")
        open_entries = entries.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        mixed = open_entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        open_entries = stored(open_entries.join(mixed, "token"), "jaccard-open")
    across = _candidates(open_entries, F.col("x_root") != F.col("y_root"), ("root",))
    pairs = stored(across.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = stored(_verified(pairs, index), "jaccard-more")
    links = links.union(more)
    if more.limit(1).count():
        roots = stored(components(links), "jaccard-roots")
    return Found(staged, sets, classes, links, roots)


def labelled(found: Found) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, and whether the row is the one that stays of its component."""
    named = found.classes.join(found.roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    keeper = F.min(F.struct(F.col("least").isNull(), "least", F.col("rep").alias("rid"))).alias("k")
    names = named.groupBy("root").agg(keeper).select("root", F.col("k.least").alias("component_id"), F.col("k.rid").alias("keeper"))
    classes = named.join(names, "root").select("class", "component_id", "keeper")
    rows = found.sets.join(classes, "class", "left")
    return rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("keeper").isNull() | (F.col("keeper") == F.col("rid"))).alias("stays"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document, that of the least doc_id, of each component."""
    found = connect(docs, key, text)
    stays = labelled(found).where("stays").select("rid")
    kept = found.staged.join(stays, "rid", "left_semi")
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))
