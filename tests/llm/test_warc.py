import base64
import hashlib
import struct

import zstandard

from marlstone.llm import queries, warc


def test_ids_survive_as_uris():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        uris = {warc.record_uri(n, hashlib.sha1(x).digest()) for x in (b"", b"a", b"b")}
        assert len(uris) == 3 and {warc.record_number(u) for u in uris} == {n}


def test_archive_layout():
    records = [warc.make_record(k, "http://x/", f"<p>{k} some payload that repeats</p>".encode() * 20, None) for k in range(50)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and list(warc.unpack(data)) == records
    first = data[8 + size :]
    frame = zstandard.get_frame_parameters(first)
    assert frame.content_size == len(records[0])  # each record is a frame of its own
    assert list(warc.unpack(warc.pack(records[:1]))) == records[:1] and list(warc.unpack(warc.pack([]))) == []


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    newest = {}
    for r in rows:
        newest[r["html"]] = max(newest.get(r["html"], -1), r["page_id"])
    got = {r["page_id"]: r for r in queries.op3_warc(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw, g = r["html"].encode(), got[r["page_id"]]
        first = newest[r["html"]] == r["page_id"]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (g["record_type"], g["refers_to"]) == (("response", None) if first else ("revisit", newest[r["html"]]))


def test_nulls_ties_clashes_and_whole_payloads(spark):
    pages = spark.createDataFrame([(1, None, "u 1"), (2, "", None), (3, "same", "u"), (5, "same", "u"), (5, "same", "u"), (None, "same", "u"), (None, "alone", "é"), (9, "x" * 300_000, "u")], "page_id long, html string, url string")
    pages = pages.selectExpr("*", "1 AS digest")
    manifest = warc.write(pages, warc.archive_folder(spark), archive_bytes=1000)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(manifest).collect()), key=str)
    want = [(-1, 4, "revisit", 5), (-1, 5, "response", None), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (9, 300_000, "response", None)]
    assert got == sorted(want, key=str)
    bodies = {bytes(r["payload"]) for r in warc.read(manifest, payloads=True).where("record_type = 'response'").collect()}
    assert bodies == {b"", b"same", b"alone", b"x" * 300_000}
    assert warc.read(warc.write(pages.limit(0), warc.archive_folder(spark))).collect() == []
    small = warc.write(pages, warc.archive_folder(spark), min_bytes=5)
    assert warc.read(small).where("record_type = 'revisit'").count() == 0


def test_rows_of_a_page_with_different_payloads_are_different_records(spark):
    pages = spark.createDataFrame([(1, "a", "u"), (1, "b", "u"), (0, "b", "u")], "page_id long, html string, url string")
    manifest = warc.write(pages, warc.archive_folder(spark))
    uris, referred = [], []
    for r in manifest.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            for record in warc.unpack(f.read()):
                head = warc.parse(record)[0]
                uris.append(head["WARC-Record-ID"])
                referred += [head["WARC-Refers-To"]] if "WARC-Refers-To" in head else []
    assert len(set(uris)) == len(uris) and len(referred) == 1 and referred[0] in uris
