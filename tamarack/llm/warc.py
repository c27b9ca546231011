"""WARC archives of pages: a gzip member per record, revisits for repeated payloads, and a salvage reader.

Writing: payload digests are aggregated map-side to the largest page_id of each payload; that small table is
joined back by digest, digests of very many pages by broadcast (there are at most HOT_DIGESTS of them) and the rest
by shuffle, so no digest is collected in a task; each task appends records to a file of its own. Reading: each
file is parsed from its start; after a failed check the reader looks for the next member or version line that
begins a valid record, goes on there, and logs the bytes between as quarantined; it does so inside a member as
well, also one that is cut off or that zlib finds wrong.

A record's block is checked by its digests, where it has them; this writer's records have a digest of their header
as well, in its last line.

Defined results: null html is an empty payload; empty payloads count as equal payloads; null page_ids give
records without the page's header and read back as null; rows that repeat a page_id and its payload are each
a response when that page_id is the largest; extra columns aren't stored.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, make_dirs, scratch, stored

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # of capture; a parameter of the archive, so that reruns write the same bytes
MAGIC = b"\x1f\x8b\x08"
FIELD = re.compile(rb"([!-9;-~]+):([\t -~\x80-\xff]*)")
FILE_BYTES = 64 << 20
HOT_DIGESTS = 10_000  # a digest of more than one in so many pages is hot; so there are never more of them
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
GAPS = "path string, start long, end long, reason string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


# --- records --------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, revisit: bool, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{revisit}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, revisit, digest)}", f"WARC-Date: {DATE}",
        f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, False, digest)}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    told = VERSION + b"\r\n" + "\r\n".join(head).encode()
    return told + f"\r\nX-Header-Digest: sha1:{base32_sha1(told)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member; its header has no time, so equal records have equal bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Damaged(ValueError):
    pass


def _differs(told: str | None, data: bytes) -> bool:
    """Whether a digest is there, of a kind that can be checked, and another than that of data."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return False
    return value.upper() != base32_sha1(data) and value.lower() != hashlib.sha1(data, usedforsecurity=False).hexdigest()


def _number(x: str | bytes | None) -> int | None:
    try:
        value = int(x) if x is not None else None
    except ValueError as e:
        raise Damaged("a number that is none") from e
    if value is not None and not -(2**63) <= value < 2**63:
        raise Damaged("a number beyond 64 bits")
    return value


def parse(data: bytes, at: int = 0) -> tuple[dict, int, bool]:
    """The record that begins at a version line, checked; the offset behind it; and whether its block has a digest that was checked."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without an end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        if not (field := FIELD.fullmatch(line)):
            raise Damaged("header line that is none")
        fields[field[1].lower().decode()] = field[2].strip().decode("utf-8", "replace")
    if not (length := fields.get("content-length", "")).isdecimal() or len(length) > 15:
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end where its length says")
    block, told = data[start:stop], fields.get("warc-block-digest")
    if _differs(told, block):
        raise Damaged("block digest differs")
    kind = fields.get("warc-type")
    http, payload, sizes = b"", block, []
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest")
    if kind != "revisit" and b"\ntransfer-encoding:" not in http.lower() and _differs(digest, payload):
        raise Damaged("payload digest differs")
    digest = digest.partition(":")[2] if digest else base32_sha1(payload)
    page_id, seal = _number(fields.get("x-page-id")), fields.get("x-header-digest")
    if _differs(seal, data[at:end].rpartition(b"\r\n")[0]) or (page_id is not None and not seal):
        raise Damaged("header digest differs")
    return {
        "page_id": page_id, "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": _number(sizes[0]) if sizes else len(payload), "payload_digest": digest,
        "refers_to": _number(fields.get("x-refers-to-page-id")), "payload": None if kind == "revisit" else payload,
    }, stop + 4, (told or "").lower().startswith("sha1:")


STEP = 1 << 16


def _member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What a member holds, the offset behind it, and what is wrong with it; then the bytes are those before the fault."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        if at >= len(data):
            return b"".join(out), at, "gzip: member is cut off"
        part, before = data[at : at + STEP], unpack.copy()
        try:
            out.append(unpack.decompress(part))
        except zlib.error as e:
            for k in range(len(part)):  # what can be had of this step before the fault
                try:
                    out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at, f"gzip: {e}"
        at += len(part)
    return b"".join(out), at - len(unpack.unused_data), None


def _inside(raw: bytes, sound: bool) -> tuple[list[dict], str | None]:
    """The valid records of decompressed bytes, and what is wrong with the first that isn't. Where the member isn't
    sound, a record has to have a block digest."""
    found, at, wrong = [], 0, None
    while 0 <= at < len(raw):
        try:
            one, behind, checked = parse(raw, at)
            if not (sound or checked):
                raise Damaged("no digest in a damaged member")
            found.append(one)
            at = behind
        except Damaged as e:
            wrong, at = wrong or str(e), raw.find(b"WARC/1.", at + 1)
    return found, wrong


def _one(data: bytes, view: memoryview, at: int) -> tuple[list[dict], int, str | None, bool]:
    """The records of the member, or the plain record, that begins at an offset; the offset behind; what is wrong
    with some of them; whether the offset behind is sure."""
    if not data.startswith(MAGIC, at):
        found, at, _ = parse(data, at)
        return [found], at, None, True
    if at + 3 >= len(data) or data[at + 3] & 0xE0:
        raise Damaged("gzip: no member's header")
    raw, end, fault = _member(view, at)
    found, wrong = _inside(raw, fault is None)
    if (fault or wrong) and not found:
        raise Damaged(fault or wrong)
    return found, end, fault or wrong, fault is None


def salvage(data: bytes) -> Iterator[dict | tuple[int, int, str]]:
    """Records of an archive, and (start, end, reason) of each gap that was skipped. A record is only given if it
    passes all checks. A gap may be a member that some records were recovered from."""
    view, at, size = memoryview(data), 0, len(data)
    start, reason = None, ""
    had: list[dict] = []  # records of faulty members, which the raw bytes before `until` may show again
    until = 0
    while at < size:
        try:
            found, behind, wrong, sure = _one(data, view, at)
        except Damaged as e:
            found, behind, wrong, sure = [], at, str(e), False
        if wrong is None:
            if start is not None:
                yield start, at, reason
                start = None
            if at < until and not data.startswith(MAGIC, at) and found[0] in had:
                had.remove(found[0])
                found = []
            yield from found
            at = behind
            continue
        if start is None:
            start, reason = at, wrong
        yield from found
        if sure:
            yield start, behind, reason
            start, at = None, behind
            continue
        if found:
            had, until = had + found, max(until, behind + STEP)
        at = min((x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0), default=size)
    if start is not None:
        yield start, size, reason


# --- tables ---------------------------------------------------------------------------------------------------


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html). Payloads of at least `least` bytes are stored once. Returns the
    manifest: path, bytes, records."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = make_dirs(spark, folder or scratch(spark, "warc"))
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    keepers = stored(rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "warc-keepers")
    many = (keepers.agg(F.sum("copies")).first()[0] or 0) // HOT_DIGESTS
    hot = F.broadcast(keepers.where(F.col("copies") > F.greatest(F.lit(many), F.lit(HOT_DIGESTS))).select("digest", F.col("keeper").alias("hot")))  # HOT_DIGESTS rows at most
    met = rows.join(hot, "digest", "left")
    alone = F.sha1(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))  # a key that no digest is, so that rows that are settled already spread
    keyed = met.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), alone)))
    told = keyed.join(keepers.select(F.col("digest").alias("key"), "keeper"), "key", "left").withColumn("keeper", F.coalesce("hot", "keeper"))
    told = told.select("page_id", "url", "payload", "keeper", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink = None
        part = written = count = 0
        done: list[tuple[str, int, int]] = []

        def close():
            sink.close()
            done.append((where, written, count))

        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    where = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{part:04d}-{uuid.uuid4().hex}.warc.gz"
                    fs, at = filesystem(where)
                    sink, part, written, count = fs.open_output_stream(at, compression=None), part + 1, 0, 0
                packed = member(record(r["page_id"], r["url"], r["payload"], r["keeper"], r["revisit"]))
                sink.write(packed)
                written, count = written + len(packed), count + 1
                if written >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return stored(told.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def _files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    return manifest.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records that can be recovered from a manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                for found in salvage(_bytes(path)):
                    if isinstance(found, dict):
                        held.append(found)
                        size += len(found["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return _files(spark, manifest).mapInArrow(run, RECORDS)


def quarantine(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The byte gaps that read() skips: path, start, end (exclusive) and what failed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                gaps = [x for x in salvage(_bytes(path)) if isinstance(x, tuple)]
                yield pa.RecordBatch.from_pylist([{"path": path, "start": s, "end": e, "reason": why} for s, e, why in gaps], schema)

    return _files(spark, manifest).mapInArrow(run, GAPS)


def _bytes(path: str) -> bytes:
    """A whole file; the writer closes files at FILE_BYTES, so its size is bounded."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        return f.read()

