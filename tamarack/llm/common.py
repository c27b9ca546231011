"""What the operators of this subpackage share: folders, Arrow batches, byte-level text views.

Nulls: a null text is an empty text everywhere. Extra columns: operators read the columns they name
and carry the rest along untouched, unless their docstring says otherwise.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D, as every contract here has it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the texts' length.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers get small; very long texts would fill them otherwise. This sets two
    limits of the session, which stay set; they bound sizes only and change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, and on a local master only,
    a folder of this user's is used (tests); on a cluster without the setting this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/tamarack-{os.getuid()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()  # a path without a scheme is one of the default file system
    return re.sub("^file:/+", "file:///", whole.rstrip("/"))


_MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. Results are read lazily, so it stays until clear() is called."""
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Delete what this driver's operators have written below the shared folder, once their results were used; archives
    and token files written to a folder of the caller's stay. Returns how many paths went."""
    gone = 0
    while _MADE:
        where = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def make_dirs(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(pyarrow file system, path in it) for a URI or a plain path; used in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else os.path.abspath(path))


def named(name: str) -> Column:
    """A column by its name as it is, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(named(name), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), where value is computed once: a lambda's argument can't be inlined by the optimizer."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets); offsets has one entry more than there are rows. Nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), in place on a fresh array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Base of the polynomial hashes modulo 2**64, odd so that it can be inverted.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        step, got = base, 1
        while got < size:
            have[got : 2 * got] = have[:got] * np.uint64(step)
            step, got = step * step % (1 << 64), 2 * got
        _POWERS[base] = have
    return have[:n]


class PrefixHash:
    """Polynomial prefix hashes of bytes; any substring's hash in constant time, vectorised."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.down = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        """Of every substring of k bytes."""
        n = len(self.sums) - 1
        return (self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] if n >= k else np.zeros(0, np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and the first word's index per text (rows + 1)."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.empty(n + 1, bool)
    begins[:n] = ~space
    begins[n] = False
    ends = np.zeros(n + 1, bool)
    inner = begins[:n].copy()
    begins[1:n] &= space[: n - 1]
    ends[1:n] = inner[: n - 1] & space[1:]
    if n:
        ends[n] = inner[n - 1]
        cut = offsets[(offsets > 0) & (offsets < n)]  # a word ends where its text ends
        both = cut[inner[cut] & inner[cut - 1]]
        begins[both] = True
        ends[both] = True
    starts, stops = np.flatnonzero(begins[:n]), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def per_process(key: str, make):
    """make() once in a Python worker's life; functions travel by value, so their modules' globals don't last."""
    import sys

    store = sys.__dict__.setdefault("_tamarack_per_process", {})
    if key not in store:
        store[key] = make()
    return store[key]


def binary_array(parts: list[bytes]):
    import pyarrow as pa

    return pa.array(parts, pa.binary())


class Generations:
    """A memo of bounded size: two dictionaries, the older one is dropped when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 0)
        return found

    def put(self, key, value, cost: int = 1) -> None:
        self.new[key] = value
        self.size += cost
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
