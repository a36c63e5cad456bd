"""Archives: round trip, types and look-ups."""

import base64
import glob
import hashlib
import re
import zlib

import pytest

from tidemark.llm import captures as module
from tidemark.llm.captures import Lookup, checked, look_up, parse_record, read_archives, surt, write_archives

SCHEMA = "page_id long, url string, html string, payload_digest string, file string"


def pages():
    big, other = "<p>é" * 400, "x" * 1000
    rows = [(i, f"http://www.example.org:80/{i % 7}?Q={i % 3}", f"page {i} " * (i % 9), None, None) for i in range(60)]
    rows += [(100 + i, f"https://host{i}.example.com/same", big, "", "") for i in range(5)]
    rows += [(200, None, other, None, None), (201, "", other, None, None), (201, "http://a/", other, None, None), (202, "::bad::[", None, None, None), (203, "http://b/", "", None, None), (204, "http://c/", "short", None, None), (205, "http://d/", "short", None, None), (None, "http://e/", other, None, None)]
    return rows


def expected(rows):
    last = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        again = i is not None and h in last and i < last[h]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_LINES", 7)
    monkeypatch.setattr(module, "ARCHIVE_BYTES", 2000)
    rows = pages()
    capture = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = read_archives(spark, capture)
    assert sorted(((r.capture, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(rows)
    bodies = {r.capture: r.body for r in got.where("record_type = 'response' and capture is not null").collect()}
    assert bodies[200 + 3] == "" and bodies[104] == "<p>é" * 400 and bodies[5] == "page 5 " * 5
    frame = spark.createDataFrame(rows, SCHEMA)
    searched = checked(look_up(capture, frame))
    assert sorted(((r.capture, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in searched.collect()), key=str) == expected(rows)
    assert sorted(((r.capture, r.url, r.body) for r in searched.collect()), key=str) == sorted(((r.capture, r.url, r.body) for r in got.collect()), key=str)
    assert {(i, u or None) for i, u, *_ in rows} == {(r.capture, r.url or None) for r in got.collect()}
    some = look_up(capture, frame.where("page_id in (3, 103)"), bodies=False).collect()
    assert sorted(r.capture for r in some) == sorted([*(i for i in range(60) if i % 7 == 3 and i % 3 == 0), 103]) and {r.body for r in some} == {None}
    look = Lookup(capture)
    assert sorted(int(x["fields"]["WARC-Capture-Number"]) for x in look.find("https://www.example.org/3?q=0")) == [i for i in range(60) if i % 7 == 3 and i % 3 == 0]
    assert [x["fields"]["WARC-Type"] for x in look.find("http://host0.example.com/same")] == ["revisit"]
    assert look.find("http://nowhere.example/") == []


def members(path):
    """The records of an archive, as any reader finds them: gzip members one after another."""
    with open(path, "rb") as f:
        data = f.read()
    while data:
        unpack = zlib.decompressobj(31)
        record = unpack.decompress(data)
        data = unpack.unused_data
        yield record


def test_archives_are_valid(spark):
    """warcinfo first, the mandatory fields, HTTP messages whose payloads have the stated digests, revisits of records that are there."""
    capture = write_archives(spark.createDataFrame(pages(), SCHEMA))
    ids, refers, total = {}, [], 0
    for path in glob.glob(f"{capture.folder.removeprefix('file:')}/*.warc.gz"):
        for k, record in enumerate(members(path)):
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            assert (fields["WARC-Type"] == "warcinfo") == (k == 0)
            if not k:
                continue
            total += 1
            assert re.fullmatch("[A-Za-z][A-Za-z0-9+.-]*:[!-~]+", fields["WARC-Target-URI"]) and fields["Content-Type"] == "application/http;msgtype=response"
            status, _, payload = rest[:-4].partition(b"\r\n\r\n")
            assert status.startswith(b"HTTP/1.1 200 OK\r\n")
            if fields["WARC-Type"] == "revisit":
                assert payload == b"" and fields["WARC-Profile"].endswith("identical-payload-digest")
                refers.append((fields["WARC-Refers-To"], fields["WARC-Payload-Digest"]))
            else:
                digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                assert digest == fields["WARC-Payload-Digest"] and f"Content-Length: {len(payload)}".encode() in status
                ids[fields["WARC-Record-ID"]] = digest
    assert total == len(pages()) and len(refers) == 5 and all(ids[i] == d for i, d in refers)


def test_revisits_are_checked(spark):
    rows = [(1, "u", "response", None, "aa", 1000, None), (2, "u", "revisit", 1, "aa", 1000, None)]
    schema = "capture long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, body string"
    assert checked(spark.createDataFrame(rows, schema)).count() == 2
    for wrong in ((2, "u", "revisit", 3, "aa", 1000, None), (2, "u", "revisit", 1, "bb", 1000, None)):
        with pytest.raises(Exception, match="revisit 2 refers to no response"):
            checked(spark.createDataFrame([rows[0], wrong], schema)).collect()


def test_one_url_with_most_captures_and_a_long_body(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_LINES", 5)
    rows = [(i, "http://hot/", f"{i}" + "x" * (i % 3) * 1000, "", "") for i in range(200)] + [(500, "http://other/", "ä" * 3_000_000, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    capture = write_archives(frame)
    got = look_up(capture, frame)
    assert sorted((r.capture, r.payload_bytes) for r in got.select("capture", "payload_bytes").collect()) == sorted((i, len(h.encode())) for i, _, h, *_ in rows)
    assert [r.n for r in got.where("capture = 500").selectExpr("length(body) n").collect()] == [3_000_000]


def test_empty_and_keys(spark):
    capture = write_archives(spark.createDataFrame([], SCHEMA))
    assert read_archives(spark, capture).count() == 0 and look_up(capture, spark.createDataFrame([("http://x/",)], "url string")).count() == 0 and Lookup(capture).find("http://x/") == []
    assert surt("HTTPS://User@WWW.Example.org:443/Path?B=1#frag") == "org,example,www)/path?b=1"
    assert surt("http://h:8080") == "h:8080)/" and surt(None) == ")/"
    try:
        parse_record(b"nothing")
    except ValueError:
        pass
    else:
        raise AssertionError
