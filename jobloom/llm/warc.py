"""Archives of web pages: WARC records in Zstandard frames that share a dictionary.

An archive is one row (path, content), as Spark's ``binaryFile`` source reads it: the
dictionary in a leading skippable frame, then one frame per record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.spread import join_per_key
from jobloom.session import written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_FROM = 1000
ARCHIVE_BYTES = 16 << 20
DICTIONARY_SAMPLES = 256
DICTIONARY_BYTES = 32 << 10

ARCHIVE = "path string, content binary"
RECORD = (
    "path string, frame long, error string, record_type string, page_id long, url string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))


def with_targets(rows: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Adds ``target``: the largest page of an equal payload, for payloads long enough."""
    long = rows.filter(F.col("size") >= revisit_from)
    last = long.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    last = last.filter("n > 1").drop("n")
    return join_per_key(rows, "digest", ["page_id"], last)


def dictionary(pages: DataFrame, samples: int = DICTIONARY_SAMPLES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on at most ``samples`` payloads, those of the smallest digests.

    Only the digests are ranked, so a task sends the driver no payloads but the ones picked,
    each cut to 16 KB: 4 MB in all. The archives hold all bytes. Empty if there are too few
    pages to train on.
    """
    rows = payloads(pages).filter("size > 0")
    picked = [r.digest for r in rows.select("digest").distinct().orderBy("digest").limit(samples).collect()]
    one = rows.filter(F.col("digest").isin(picked)).dropDuplicates(["digest"])
    texts = [bytes(r.p) for r in one.orderBy("digest").select(F.substring("payload", 1, 16 << 10).alias("p")).collect()]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(row: dict, date: str) -> bytes:
    """One whole record. Line ends in the address are percent-encoded."""
    page, target, payload = row["page_id"], row["target"], row["payload"]
    revisit = target is not None and page is not None and page != target
    name = "" if page is None else page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{target}>")]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, shared: bytes, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archives of all rows of ``pages`` (page_id, url, html).

    A null html is an empty payload, a null url an empty address, a null page id an empty
    record id that is never a revisit. Repeated rows each get their record; of equal
    payloads all rows with the largest page id are responses. Other columns are left out.
    """
    rows = with_targets(payloads(pages)).select("page_id", "url", "payload", "digest", "target")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(shared) if shared else None
        press = zstandard.ZstdCompressor(level=6, dict_data=held, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(shared)) + shared if shared else b""
        frames, size, n, part = [lead], 0, 0, TaskContext.get().partitionId()

        def archive() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{n:06d}.warc.zst"
            return pa.RecordBatch.from_pydict({"path": [name], "content": [b"".join(frames)]})

        for batch in batches:
            for i in range(batch.num_rows):
                frames.append(press.compress(record({c: batch.column(c)[i].as_py() for c in batch.schema.names}, date)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield archive()
                    frames, size, n = [lead], 0, n + 1
        if size:
            yield archive()

    return rows.mapInArrow(pack, ARCHIVE)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share, and its path there."""
    uri = re.sub("^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each row of ``archives`` as a file of ``folder``; (path, bytes) of the files.

    A task writes a file under a name of its own below ``_tried``. The names that finished tasks
    have returned are stored, and only those files are then moved to their archives' names, which a second
    run of a move finds done. So what a lost task left is never taken for an archive. Null contents
    give no file; archives of one name are an error.
    """
    tried = f"{folder}/_tried"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(tried)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                own, data = uuid.uuid4().hex, content.as_buffer()
                with system.open_output_stream(f"{at}/{own}") as out:
                    out.write(data)
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "own": [own], "bytes": [data.size]})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        for batch in batches:
            for path, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{at}/_tried/{own}").type == fs.FileType.File:
                    system.move(f"{at}/_tried/{own}", f"{at}/{path}")
            yield batch.select([0, 2])

    names = written(archives.select("path", "content").mapInArrow(write, "path string, own string, bytes long"), "archive-names")
    twice = names.groupBy("path").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"two archives are named {twice.first()[0]}")
    return written(names.mapInArrow(move, "path string, bytes long"), "archive-files")


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archive files of a folder, as ``read_archives`` takes them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)


def frames(content: bytes, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, data, error) of each frame after the dictionary. A broken frame ends the archive."""
    view, at, held = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        shared = bytes(view[8 : 8 + size])
        if len(shared) < size:
            yield 0, None, "dictionary cut short"
            return
        try:
            if shared[:4] == ZSTD_MAGIC:  # the format lets writers compress it
                shared = zstandard.ZstdDecompressor().decompressobj().decompress(shared)
            held = zstandard.ZstdCompressionDict(shared, dict_type=zstandard.DICT_TYPE_FULLDICT)
            held.precompute_compress(level=3)  # raises on bytes that are no dictionary
        except zstandard.ZstdError:
            yield 0, None, "dictionary can't be read"
            return
        at = 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts, pos = decoder.decompressobj(), [], at
        try:
            while not one.eof and pos < len(view):
                parts.append(one.decompress(view[pos : pos + chunk]))
                pos += chunk
        except zstandard.ZstdError:
            yield at, None, "frame can't be decoded"
            return
        if not one.eof:
            yield at, None, "frame cut short"
            return
        yield at, b"".join(parts), None
        at = min(pos, len(view)) - len(one.unused_data)


def parsed(data: bytes) -> dict:
    """Fields of the one record that a frame holds; ``error`` says what is wrong with it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        return {"error": "no record header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return {"error": "header line without colon"}
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]
    if missing:
        return {"error": f"header lacks {missing[0]}"}
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        return {"error": "length differs from header"}
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest}
    out |= {"page_id": page(fields["warc-record-id"]), "refers_to": page(fields.get("warc-refers-to", ""))}
    if kind == "revisit":
        size = fields.get("x-payload-length", "")
        return out | {"payload_bytes": int(size) if size.isdigit() else None}
    out |= {"payload": payload, "payload_bytes": len(payload)}
    if digest and digest != hashlib.sha1(payload).hexdigest():
        out["error"] = "payload differs from digest"
    return out


def page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per frame of ``archives`` (path, content; other columns are left out).

    Faulty frames give a row that says so in ``error``; null contents give no row. An
    archive may lack the dictionary. Memory is one archive and one record at a time.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"frame": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for at, data, error in frames(content or b""):
                    row = {"error": error} if error else parsed(data)
                    rows.append({"path": path, "frame": at} | row)
                    size += len(data or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "content").mapInArrow(unpack, RECORD)
