"""Tables staged in parts, and what is known of each part's tokens from all the others.

A stage() is the input written once to the shared folder, with a row number (rid) and the part (the task that
wrote it). frequencies() counts tokens over all rows: each task sends its tokens, aggregated and packed in
binary blobs by bucket of the token's hash, so a shuffled token costs four bytes and a hot token one entry a
task; the reducer of a bucket adds up and returns to each part its own tokens that occur twice or more. A
worker that reads the part again loads that list from the shared folder: texts are never shuffled.

Counts are kept by KEY_BITS of the hash. They steer work (what is rare, what can be shared at all); two tokens
falling together only makes both look more frequent, for all rows alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, scratch

FLUSH = 1_000_000  # tokens that a task holds before it sends them


def stage(df: DataFrame, what: str) -> DataFrame:
    """df with rid (unique) and part, written and read again."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, what)
    rid = F.monotonically_increasing_id()
    df.withColumn("rid", rid).withColumn("part", F.shiftright("rid", 33).cast("int")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def bucket_bits(spark: SparkSession) -> int:
    """Buckets follow the cluster's shuffle partitions, four to each, 64 at least."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 more bits of each hash."""
    return hashes >> np.uint64(32 - bits)


def frequencies(staged: DataFrame, columns: list[str], tokens: Callable[[pa.RecordBatch], np.ndarray], what: str) -> str:
    """A folder with, for each part, its tokens of two or more rows. tokens(batch) has each token of a row once;
    columns name what it reads, beside part; a batch is of one part."""
    spark = staged.sparkSession
    bits = bucket_bits(spark)

    def send(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(keys(np.concatenate(held), bits), return_counts=True)
        bucket, low = (found >> np.uint64(32)).astype(np.int64), found.astype(np.uint32)
        cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = [b for b in range(1 << bits) if cut[b] < cut[b + 1]]
        once, often, times = [], [], []
        for b in rows:
            c, x = counts[cut[b] : cut[b + 1]], low[cut[b] : cut[b + 1]]
            once.append(x[c == 1].tobytes())
            often.append(x[c > 1].tobytes())
            times.append(c[c > 1].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array([part] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in (once, often, times))], names=["bucket", "part", "once", "often", "times"]
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, part = 0, -1
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("part")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
            for lo, hi in zip(edges, edges[1:]):
                if held and (own[lo] != part or size > FLUSH):
                    yield send(part, held)
                    held, size = [], 0
                part = int(own[lo])
                held.append(tokens(batch.slice(lo, hi - lo)))
                size += len(held[-1])
        if size:
            yield send(part, held)

    def total(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        lows, counts, sources = [], [], []
        for k, (once, often, times) in enumerate(zip(table["once"].to_pylist(), table["often"].to_pylist(), table["times"].to_pylist())):
            lows += [np.frombuffer(once, np.uint32), np.frombuffer(often, np.uint32)]
            counts += [np.ones(len(lows[-2]), np.uint32), np.frombuffer(times, np.uint32)]
            sources.append(np.full(len(lows[-2]) + len(lows[-1]), k, np.int32))
        low, count, source = np.concatenate(lows), np.concatenate(counts), np.concatenate(sources)
        order = np.argsort(low, kind="stable")
        low, count, source = low[order], count[order], source[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        size = np.diff(np.append(first, len(low)))
        whole = np.repeat(np.add.reduceat(count.astype(np.int64), first), size)
        twice = whole > 1
        low, whole, source = low[twice], np.minimum(whole[twice], 0xFFFFFFFF).astype(np.uint32), source[twice]
        back = np.argsort(source, kind="stable")
        cut = np.searchsorted(source[back], np.arange(len(parts) + 1))
        rows = [k for k in range(len(parts)) if cut[k] < cut[k + 1]]
        take = lambda x: pa.array([x[back[cut[k] : cut[k + 1]]].tobytes() for k in rows], pa.binary())
        return pa.table({"part": pa.array([parts[k] for k in rows], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int32()), "low": take(low), "count": take(whole)})

    sent = staged.select(*columns, "part").mapInArrow(split, "bucket int, part int, once binary, often binary, times binary")
    path = scratch(spark, what)
    totals = sent.groupBy("bucket").applyInArrow(total, "part int, bucket int, low binary, count binary")
    totals.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def side(path: str, part: int) -> pa.Table | None:
    """The rows that a folder partitioned by part has for one, in a worker."""
    from pyarrow import fs as pfs
    from pyarrow import parquet

    fs, at = filesystem(path)
    where = f"{at}/part={part}"
    if fs.get_file_info(where).type != pfs.FileType.Directory:
        return None
    files = [x.path for x in fs.get_file_info(pfs.FileSelector(where)) if x.path.endswith(".parquet")]
    return pa.concat_tables([parquet.ParquetFile(fs.open_input_file(x)).read() for x in files]) if files else None


class Known:
    """The tokens of a part that occur in two or more rows anywhere, and in how many."""

    def __init__(self, path: str, part: int, bits: int):
        table = side(path, part)
        found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for bucket, low, count in zip(*(table[c].to_pylist() for c in ("bucket", "low", "count"))) if table is not None else ():
            found.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            counts.append(np.frombuffer(count, np.uint32))
        self.bits = bits
        self.keys, first = np.unique(np.concatenate(found), return_index=True)
        self.counts = np.concatenate(counts)[first]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Rows that have each token; 1 for those that no other row has."""
        if not len(self.keys):
            return np.ones(len(hashes), np.uint32)
        own = keys(hashes, self.bits)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, self.counts[at], np.uint32(1))


def by_part(batches: Iterator[pa.RecordBatch], open_part: Callable[[int], object]) -> Iterator[tuple[pa.RecordBatch, object]]:
    """Batches cut where the part changes, each with what open_part made of it."""
    part, opened = None, None
    for batch in batches:
        own = batch.column(batch.schema.get_field_index("part")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
        for lo, hi in zip(edges, edges[1:]):
            if part != own[lo]:
                opened = None
                part, opened = int(own[lo]), open_part(int(own[lo]))
            yield batch.slice(lo, hi - lo), opened
