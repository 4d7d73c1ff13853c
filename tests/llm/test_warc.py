"""Archives written and read back; faulty archives give errors, not crashes."""

import hashlib
import os
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from jobloom.llm import warc
from jobloom.session import scratch

PAGES = "page_id long, url string, html string, payload string, digest string, size long, target long"


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", 1, 2) for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/", "a" * 1500), (9, "http://b/", "a" * 1500), (4, "http://c/", "a" * 1500), (2, "u", "b" * 999), (3, "u", "b" * 999),
    (5, None, None), (6, "", ""), (7, "http://x/\r\nWARC-Type: metadata", "é" * 2000), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 400),
    (11, "u", "q" * 1000), (11, "u", "q" * 1000), (10, "u", "q" * 1000), (None, "u", "n" * 1200), (12, "u", "z" * 3_000_000),
]


def test_round_trip(spark):
    pages = make(spark, ROWS).repartition(3)
    for shared in (warc.dictionary(make(spark, [(i, "u", f"<p>page {i} of many</p>" * (i + 3)) for i in range(60)])), b""):
        rows = warc.read_archives(warc.write_archives(pages, shared, archive_bytes=2000)).collect()
        assert len(rows) == len(ROWS) and not [r for r in rows if r.error]
        by = {}
        for r in rows:
            by.setdefault(r.page_id, []).append(r)
        for i, url, html in ROWS:
            data = (html or "").encode()
            for r in by[i]:
                assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
                assert r.record_type == "revisit" or bytes(r.payload) == data
        kinds = {i: {(r.record_type, r.refers_to) for r in rs} for i, rs in by.items()}
        assert kinds[1] == kinds[4] == {("revisit", 9)} and kinds[9] == {("response", None)}
        assert kinds[10] == {("revisit", 11)} and kinds[11] == {("response", None)}
        assert kinds[2] == kinds[3] == kinds[None] == kinds[5] == kinds[6] == {("response", None)}


def test_no_pages(spark):
    none = make(spark, [])
    assert warc.dictionary(none) == b"" and warc.write_archives(none, b"").count() == 0


def archive(*records, shared=b"", lead=b""):
    held = zstandard.ZstdCompressionDict(shared) if shared else None
    press = zstandard.ZstdCompressor(dict_data=held)
    return lead + b"".join(press.compress(r) for r in records)


def good(payload=b"hello"):
    row = {"page_id": 1, "target": None, "payload": payload, "url": "u", "digest": hashlib.sha1(payload).hexdigest()}
    return warc.record(row, "2026-01-01T00:00:00Z")


def read(spark, content):
    df = spark.createDataFrame([("a", bytearray(content), 5)], "path string, content binary, error int")
    return warc.read_archives(df).collect()


LENGTH = int(re.search(rb"Content-Length: (\d+)", good())[1])
LONGER = good().replace(b"Content-Length: %d" % LENGTH, b"Content-Length: %d" % (LENGTH + 1))
FAULTS = [
    (good().replace(b"hello", b"jello"), "digest"), (LONGER, "length"),
    (good().replace(b"WARC/1.1", b"WARC/9.9"), "header"), (good().replace(b"WARC-Date: ", b"X-Date: "), "warc-date"),
    (good()[:-4], "length"), (b"", "header"), (good().replace(b"WARC-Type: response", b"WARC-Type response"), "colon"),
]


@pytest.mark.parametrize("data,error", FAULTS)
def test_faulty_records(spark, data, error):
    assert data != good()
    rows = read(spark, archive(good(), data, good(b"later")))
    assert rows[0].error is None and error in rows[1].error.lower() and rows[2].error is None


def test_faulty_frames_and_dictionaries(spark):
    whole = archive(good(), good(b"x"))
    assert [r.error for r in read(spark, whole[:-3])] == [None, "frame cut short"]
    assert [r.error for r in read(spark, archive(good()) + b"garbage")] == [None, "frame can't be decoded"]
    cut = struct.pack("<II", warc.DICTIONARY_FRAME, 500) + b"short"
    assert [r.error for r in read(spark, cut)] == ["dictionary cut short"]
    none = struct.pack("<II", warc.DICTIONARY_FRAME, 5) + b"nodic"
    assert [r.error for r in read(spark, none + whole)] == ["dictionary can't be read"]
    assert read(spark, b"") == []


def test_compressed_dictionary(spark):
    samples = [f"<p>sample {i} of a page</p>".encode() * 20 for i in range(100)]
    shared = zstandard.train_dictionary(4096, samples).as_bytes()
    packed = zstandard.ZstdCompressor().compress(shared)
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed
    rows = read(spark, archive(good(), good(b"y"), shared=shared, lead=lead))
    assert [bytes(r.payload) for r in rows] == [b"hello", b"y"]


def test_binary_files_are_read(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive(good()))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files).filter(F.col("error").isNull()).count() == 1


def test_archives_are_files(spark):
    """What finished tasks wrote lands as files; what a lost one left does not."""
    folder = scratch(spark, "archives")
    local = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(f"{local}/_tried")
    with open(f"{local}/_tried/left-by-a-lost-task", "wb") as left:
        left.write(archive(good(b"never read")))
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(40)], "page_id long, url string, html string").repartition(3)
    files = warc.save_archives(warc.write_archives(pages, b"", archive_bytes=300), folder)
    names = sorted(r.path for r in files.collect())
    assert len(names) > 3 and names == sorted(n for n in os.listdir(local) if n.endswith(".warc.zst"))
    with open(f"{local}/{names[0]}", "rb") as one:  # any reader can open it
        assert zstandard.ZstdDecompressor().decompressobj().decompress(one.read()).startswith(b"WARC/1.1")
    rows = warc.read_archives(warc.open_archives(spark, folder)).collect()
    assert sorted(r.page_id for r in rows) == list(range(40)) and not any(r.error for r in rows)
    with pytest.raises(ValueError, match="are named a"):
        warc.save_archives(spark.createDataFrame([("a", b"x"), ("a", b"y")], "path string, content binary"), scratch(spark, "twice"))
