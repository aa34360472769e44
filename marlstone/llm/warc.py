"""WARC archives with a Zstandard dictionary.

Layout of an archive (``.warc.zst``): a skippable frame that holds the
dictionary, then one frame per record, each compressed on its own with that
dictionary, so a reader can fetch single records.  The dictionary is trained
from the records of the archive itself; at most ``TRAIN_BYTES`` of them.

Records with equal payloads are written once: the one with the largest id is a
``response``, the others ``revisit`` it.

Archives are files in a folder that all executors share.  A task gives each file
a name of its own and the manifest of names is written by Spark, which commits
one attempt of a task; files of lost attempts are never read.

A record's id holds the page's id and bits of the payload's digest, so rows of one
page with different payloads are different records.

Defined results: a null payload counts as empty; repeated rows with the largest
id are all responses, and rows that repeat with id and payload are one capture,
written as often under one record id; a null id is smaller than any id; payloads
below ``min_bytes`` are always responses; an empty table gives no archives; a null
``url``, or none, leaves out the target; other columns are ignored; long payloads
are one record, whole, in an archive that is as large as they need.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch
from .common import materialise, ship, small

#: Payload bytes in an archive, about; each is read whole.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES, TRAIN_BYTES, LEVEL = 64 << 10, 4 << 20, 3
#: Skippable frame of the dictionary (fixed value of the .warc.zst format).
DICT_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_uri(record: int, digest: bytes) -> str:
    """A version 8 UUID that holds a 64-bit id and 58 bits of a digest."""
    bits = record & (1 << 64) - 1
    high, middle, low = bits >> 16, bits >> 4 & 0xFFF, bits & 0xF
    rest = int.from_bytes(digest[:8], "big") >> 6
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low << 58 | rest)}>"


def record_number(uri: str) -> int:
    """The 64-bit id in a record's UUID."""
    n = uuid.UUID(uri.removeprefix("<urn:uuid:").removesuffix(">")).int
    bits = (n >> 80) << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 0xF
    return bits - (1 << 64) if bits >> 63 else bits


def block_of(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit that keeps the HTTP headers only."""
    sha1 = hashlib.sha1(payload).digest()
    digest = "sha1:" + base64.b32encode(sha1).decode()
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = record_uri(page, sha1) if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}{digest}')}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest)]
    if url is not None:
        headers.append(("WARC-Target-URI", target))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_uri(refers_to, sha1))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return block_of(headers, http if refers_to is not None else http + payload)


def pack(records: list[bytes]) -> bytes:
    """An archive of whole records."""
    import zstandard as zstd

    samples, size = [], 0
    for r in records:
        if size < TRAIN_BYTES:
            samples.append(r[: TRAIN_BYTES - size])
            size += len(samples[-1])
    try:
        trained = zstd.train_dictionary(DICT_BYTES, samples) if len(samples) >= 8 else None
    except zstd.ZstdError:  # too few samples, or too much alike
        trained = None
    raw = trained.as_bytes() if trained else b"".join(samples)[: DICT_BYTES // 8]
    codec = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(raw))
    return b"".join([struct.pack("<II", DICT_MAGIC, len(raw)), raw, *map(codec.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    import zstandard as zstd

    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    codec = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(archive[8 : 8 + size]))
    rest = memoryview(archive)[8 + size :]
    while rest:
        one = codec.decompressobj()
        record = one.decompress(rest)
        if not one.eof:
            raise ValueError("the last record is cut off")
        rest = rest[len(rest) - len(one.unused_data) :]
        yield record


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, of its HTTP message, and the message's body."""
    head, _, block = record.partition(b"\r\n\r\n")
    split = lambda text: dict(x.split(": ", 1) for x in text.decode().split("\r\n")[1:])
    warc = split(head)
    block = block[: int(warc["Content-Length"])]
    if warc["WARC-Type"] == "warcinfo":
        return warc, {}, block
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, split(http), body


def responses(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and the id a revisit refers to, or null.

    Ids are aggregated per digest before the shuffle, so a payload that a third
    of all pages share sends a row a task.  Digests of several pages are written,
    so that in the join back Spark knows both sides' sizes and splits a hot one.
    """
    url = F.col("`url`").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = keyed.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(shared.select("digest", "newest"), "warc-shared")
    return keyed.join(first, "digest", "left").select("page_id", "url", "payload", F.when(F.col("newest").isNull() | F.col("page_id").eqNullSafe(F.col("newest")), F.lit(None)).otherwise(F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives to ``folder``; the manifest: ``path``, ``n_records``, ``n_bytes``."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal records, size
            info = block_of([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            data, name = pack([info, *records]), f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:  # the name would make pyarrow compress it again
                f.write(data)
            out = pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": len(records), "n_bytes": len(data)}])
            records, size = [], 0
            return out

        for batch in small(batches, 2):
            for page, url, payload, refers_to in zip(*(c for c in map(pa.Array.to_pylist, batch.columns)), strict=True):
                records.append(make_record(page, url, payload, refers_to))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return materialise(responses(pages, id_col, payload_col, min_bytes).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest names, with its payload if asked for.
    Raises if a response's payload doesn't have its digest."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as f:
                    archive = f.read()
                rows = []
                for record in unpack(archive):
                    warc, http, body = parse(record)
                    if warc["WARC-Type"] == "warcinfo":
                        continue
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{path}: a payload doesn't have its digest")
                    uri = warc["WARC-Record-ID"]
                    page = record_number(uri) if uuid.UUID(uri[10:-1]).version == 8 else None
                    to = warc.get("WARC-Refers-To")
                    rows.append((page, warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, warc["WARC-Type"], record_number(to) if to else None, body if warc["WARC-Type"] == "response" else None))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                n = 7 if payloads else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names=names[:n])

    return manifest.select("path").mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives that all executors share."""
    return scratch(spark, "warc")
