"""Token ids in binary files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file is a sequence of zstandard frames, an index and a seek table, the last two in skippable frames, so any
zstandard reader still gets the data. A reader loads the tail, finds the frames whose range of doc_id can
hold what is asked for, and decompresses only those. Numbers are little-endian.

  data frame, decompressed: u32 documents, u32 id bytes (2 or 4); per document i64 doc_id, u8 doc_id is null,
                            u32 tokens; then all ids
  index frame:              u32 0x184D2A50, u32 size; per data frame i64 least and greatest doc_id (nulls left
                            out), u8 has null, u32 documents, u64 tokens
  seek table:               u32 0x184D2A5E, u32 size; per frame (data and index) u32 compressed size,
                            u32 decompressed size, u32 low half of XXH64; u32 frames, u8 0x80, u32 0x8F92EAB1

Documents are dealt into ranges of doc_id and sorted within; each task writes a file of its own under a name
that no other attempt uses, and only files of tasks that ended get into the manifest, so lost executors and
speculative attempts leave nothing behind that a reader sees.

Defined results: null or empty text has the end id alone; null doc_ids come first; rows with one doc_id are
ordered by their texts; extra columns aren't stored.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import bounded_batches, filesystem, make_dirs, named, per_process, scratch, stored, text_of

FRAME_BYTES = 1 << 20  # of ids, before a frame is closed
LEVEL = 1
SEEK, INDEX, FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
MANIFEST = "shard int, path string, first_doc long, docs long, tokens long, bytes long"
_ENTRY = "<qqBIQ"


# --- one file -------------------------------------------------------------------------------------------------


class FileWriter:
    def __init__(self, sink, id_bytes: int):
        import zstandard

        self.sink, self.id_bytes = sink, id_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []
        self.held: list[tuple[int | None, bytes]] = []
        self.held_bytes = self.docs = self.tokens = self.bytes = 0
        self.first: int | None = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.first is None:
            self.first = doc_id
        self.held.append((doc_id, ids))
        self.held_bytes += len(ids)
        if self.held_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.held:
            return
        n = len(self.held)
        known = [d for d, _ in self.held if d is not None]
        ids = np.frombuffer(b"".join(x for _, x in self.held), "<u4")
        raw = b"".join((
            struct.pack("<II", n, self.id_bytes),
            np.array([d or 0 for d, _ in self.held], "<i8").tobytes(),
            np.array([d is None for d, _ in self.held], "u1").tobytes(),
            np.array([len(x) // 4 for _, x in self.held], "<u4").tobytes(),
            ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes(),
        ))
        packed = self.pack(raw)
        self._write(packed, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.index.append(struct.pack(_ENTRY, min(known, default=0), max(known, default=-1), len(known) < n, n, len(ids)))
        self.docs, self.tokens = self.docs + n, self.tokens + len(ids)
        self.held, self.held_bytes = [], 0

    def _write(self, packed: bytes, size: int, checksum: int) -> None:
        self.sink.write(packed)
        self.bytes += len(packed)
        self.frames.append((len(packed), size, checksum))

    def close(self) -> None:
        import xxhash

        self.flush()
        index = b"".join(self.index)
        self._write(struct.pack("<II", INDEX, len(index)) + index, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOTER)
        self.sink.write(struct.pack("<II", SEEK, len(table)) + table)
        self.bytes += 8 + len(table)


class TokenFile:
    """Reads a file by its tail; frames are decompressed one by one, when they are asked for."""

    def __init__(self, source, size: int):
        """source: has seek() and read(n)."""
        import xxhash
        import zstandard

        self.source, self.unpack, self.hash = source, zstandard.ZstdDecompressor().decompress, xxhash.xxh64_intdigest
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table at the file's end")
        table = self._read(size - 9 - 12 * n - 8, 12 * n + 8)
        if struct.unpack_from("<II", table) != (SEEK, 12 * n + 9):
            raise ValueError("the seek table's header is damaged")
        sizes = np.frombuffer(table, "<u4", 3 * n, 8).reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes[:, 0])))
        self.sizes = sizes
        index = self._read(int(self.starts[n - 1]), int(sizes[n - 1, 0]))[8:]
        if self.hash(index) & 0xFFFFFFFF != sizes[n - 1, 2]:
            raise ValueError("the index is damaged")
        self.index = list(struct.iter_unpack(_ENTRY, index))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        raw = self.unpack(self._read(int(self.starts[k]), int(self.sizes[k, 0])))
        if len(raw) != self.sizes[k, 1] or self.hash(raw) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        n, width = struct.unpack_from("<II", raw)
        docs, nulls, counts = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 8 * n), np.frombuffer(raw, "<u4", n, 8 + 9 * n)
        ids = np.frombuffer(raw, f"<u{width}", -1, 8 + 13 * n).astype("<u4", copy=False)
        ends = np.cumsum(counts, dtype=np.int64)
        return [(None if nulls[i] else int(docs[i]), ids[ends[i] - counts[i] : ends[i]]) for i in range(n)]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that doc_id; only frames whose range holds it are decompressed."""
        hit = (k for k, (least, most, has_null, _, _) in enumerate(self.index) if (has_null if doc_id is None else least <= doc_id <= most))
        return [ids for k in hit for d, ids in self.frame(k) if d == doc_id]


# --- tables ---------------------------------------------------------------------------------------------------


def write(df: DataFrame, path: str, end_id: int = 0, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, append end_id and write in ascending doc_id order. Returns the manifest, a row for each file in order."""
    spark = df.sparkSession
    bounded_batches(spark)
    folder = make_dirs(spark, folder or scratch(spark, "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = per_process(f"pieces:{path}", lambda: PieceEncoder(path))
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        writer = sink = None
        where = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if writer is None and batch.num_rows:
                fs, at = filesystem(where)
                sink = fs.open_output_stream(at, compression=None)
                writer = FileWriter(sink, id_bytes)
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, encoder.encode(batch.column(1).to_pylist())):
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            row = [[shard], [where], [writer.first], [writer.docs], [writer.tokens], [writer.bytes]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))], names=["shard", "path", "first_doc", "docs", "tokens", "bytes"])

    dealt = df.select(named(key).cast("long").alias("doc_id"), text_of(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, from the files of a manifest."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", "bytes", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                fs, at = filesystem(file["path"])
                with fs.open_input_file(at) as source:
                    held, start = TokenFile(source, file["bytes"]), file["base"]
                    for k in range(len(held.index)):
                        docs = held.frame(k)
                        counts = np.array([len(ids) for _, ids in docs], np.int64)
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        raw = [ids.tobytes() for _, ids in docs]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in docs], pa.int64()), pa.array(starts), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
