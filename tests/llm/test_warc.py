import base64
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import warc
from voxframe.llm.common import job_folder, put_file

PAGES = "page_id long, url string, html string, payload string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], PAGES)


def wanted(data):
    ids = {}
    for page_id, _, html in data:
        if page_id is not None:
            body = (html or "").encode()
            ids[body] = min(ids.get(body, page_id), page_id)
    out = []
    for page_id, _, html in data:
        body = (html or "").encode()
        first = ids.get(body)
        again = first is not None and page_id != first
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    out = df.collect()
    assert all(r.error is None for r in out), [r.error for r in out if r.error]
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)


def test_round_trip(spark):
    long = "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") for i in range(50_000))
    data = [(1, "http://a/ b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", long), (9, "u", long),
            (6, "u", "WARC/1.1\r\n\r\n" * 900), (None, "u", "x"), (None, "u", "only"), (7, "u", "same"), (7, "u", "same"), (8, "u", "0\r\n\r\n" * 3000)]
    for options in ({}, {"segment_bytes": 700, "chunk_bytes": 90, "archive_bytes": 5000}):
        df = warc.round_trip(rows(spark, data), **options)
        assert got(df) == wanted(data)
        bodies = {r.page_id: r.payload for r in df.collect() if r.record_type == "response" and r.page_id}
        assert bytes(bodies[5]).decode() == long
    assert warc.round_trip(rows(spark, [])).count() == 0


def test_smaller_payloads_stay_responses(spark):
    df = warc.round_trip(rows(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), min_bytes=3)
    assert [r.record_type for r in df.orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


def test_reassembly_faults(spark):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 6\r\n\r\nabcdef"
    fields = lambda n, total=None, origin="urn:o": [
        ("WARC-Segment-Number", str(n)), *([("WARC-Segment-Origin-ID", f"<{origin}>")] if n > 1 else []),
        *([("WARC-Segment-Total-Length", str(total))] if total else [])]
    def two(o, n2=2, total=len(body)):
        return [warc.record("response", o, body[:10], fields(1)), warc.record("continuation", o + ":2", body[10:], fields(n2, total, o))]
    good = two("urn:good")
    data = [*good[::-1], *two("urn:gap", n2=3), *two("urn:len", total=99), *two("urn:open", total=None), two("urn:nofirst")[1],
            warc.record("response", "urn:chunk", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", [])]
    folder = job_folder(spark, "warc-test")
    put_file(folder, "a.warc.gz", [warc.member(x) for x in data])
    put_file(folder, "b.warc", b"".join(good).replace(b"urn:good", b"urn:plain")[:-30])
    out = {r.record_id: r.error for r in warc.reassemble(warc.read_records(spark, folder)).collect()}
    assert out.pop("urn:good") is None
    assert out.pop("urn:plain")  # its continuation is cut off
    assert out.pop(None) == "record is cut off"
    assert set(out) == {"urn:gap", "urn:len", "urn:open", "urn:nofirst", "urn:chunk"} and all(out.values())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_and_members(data, size):
    assert warc.unchunk(warc.chunked(data, size)) == data
    packed = warc.member(data) + warc.member(data[::-1]) + warc.member(b"")
    assert list(warc.members(packed)) == [data, data[::-1], b""]


def test_broken_bytes():
    for bad in (b"", b"5\r\nabc", b"zz\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(bad)
    with pytest.raises(ValueError):
        list(warc.members(warc.member(b"x" * 100)[:-9]))
    assert warc.base32_sha1(b"").isupper() and zlib.crc32(b"") == 0


def test_references_name_a_response(spark):
    data = [(i, f"http://h/{i}", f"body {i % 4}") for i in range(20)] + [(50, "u", "twice"), (50, "u", "twice"), (51, "u", "twice"), (None, "u", "body 1")]
    ids = []
    for _ in range(2):
        folder = job_folder(spark, "warc-test")
        warc.write_archives(rows(spark, data), folder, segment_bytes=60).count()
        records = []
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).collect():
            records += [f for m in warc.members(bytes(r.content)) for f, _ in warc.parse(m)]
        own = [f["warc-record-id"] for f in records]
        assert len(own) == len(set(own))
        ids += own
        by = {f["warc-record-id"]: f for f in records}
        revisits = [f for f in records if f["warc-type"] == "revisit"]
        assert len(revisits) == 18 and sum("warc-refers-to" in f for f in revisits) == 17
        for f in revisits:
            if "warc-refers-to" in f:
                to = by[f["warc-refers-to"]]
                assert to["warc-type"] == "response" and to["x-page-id"] == f["x-refers-to-page-id"]
                assert to["warc-payload-digest"] == f["warc-payload-digest"]
    assert len(ids) == len(set(ids))


def test_reading_goes_on_behind_a_broken_record(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    good = lambda n: warc.record("response", f"urn:{n}", body, [])
    broken = [good(1).replace(b"Content-Length", b"Content-Width"), warc.record("response", "urn:x", body, [("WARC-Segment-Number", "two")]), b"noise\r\n\r\n"]
    folder = job_folder(spark, "warc-test")
    put_file(folder, "plain.warc", b"".join([good(2), broken[0], good(3), broken[1], good(4), broken[2], good(5)]))
    put_file(folder, "packed.warc.gz", [warc.member(x) for x in (good(6), broken[0], good(7), broken[1], good(8))])
    out = warc.read_records(spark, folder).collect()
    assert {r.record_id for r in out if r.error is None} == {f"urn:{n}" for n in range(2, 9)}
    assert sum(r.error is not None for r in out) == 5
