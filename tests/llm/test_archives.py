import gzip
import hashlib

import pytest

from loomql.llm import archives as ar

SCHEMA = "page_id long, url string, html string, sha1 string, bytes string, record_id int"


def plain(rows):
    last = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(last.get(data, -1), -1 if key is None else key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and (-1 if key is None else key) < last[data]
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[data] if again else None))
    return out


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ar, "ARCHIVE", 3000)
    long = "é" * 499 + "ab"
    bodies = [None, "", "short", "short", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, long, long, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 60, "big " * 300_000, "\r\n\r\n", "no\x00nul"]
    rows = [(i * 5 % 17, f"http://a.example/{i} x\n", b) for i, b in enumerate(bodies)] + [(3, None, "y" * 1000), (3, None, "y" * 1000), (None, "u", "y" * 1000), (None, "", None)]
    for n in (1, 3):
        got = ar.converted(spark.createDataFrame([(*r, "s", "b", 1) for r in rows], SCHEMA).repartition(n), str(tmp_path / f"w{n}")).drop("record_id").collect()
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    files = list((tmp_path / "w1").glob("part-*"))
    everything = [x for f in files for x in ar.warc_records(f.read_bytes())]
    records = [x for x in everything if x[0]["WARC-Type"] != "warcinfo"]
    assert len(everything) == len(records) + len(files) and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") for f in files)
    assert len(records) == len(rows) and all(int(f["Content-Length"]) == len(b) for f, b in records)
    assert gzip.decompress(files[0].read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    again = [f for f, b in records if f["WARC-Type"] == "revisit"]
    assert all(f["WARC-Refers-To"] in {g["WARC-Record-ID"] for g, _ in records if g["WARC-Type"] == "response"} for f in again)


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    data = ar.arc_bytes("a.arc", version, [("http://x/", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n"), ("http://y/ z", b""), ("", b"raw")])
    got = list(ar.arc_captures(data))
    assert [(f["URL"], c, e) for f, c, e in got] == [("http://x/", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n", ""), ("http://y/%20z", b"", ""), ("-", b"raw", "")]
    assert ("Checksum" in got[0][0]) == (version == 2)
    assert list(ar.arc_captures(data[:-3]))[-1][2].startswith("content at byte") and [e for *_, e in ar.arc_captures(data + b"junk\n")][-1].startswith("no header line")
    assert list(ar.arc_captures(b"")) == []
    assert ar.iso_date("20030201040506") == "2003-02-01T04:05:06Z" and ar.iso_date("2003") == "2003-01-01T00:00:00Z" and ar.iso_date("x") == "1970-01-01T00:00:00Z"


def test_broken_archives(spark, tmp_path):
    good = ar.arc_bytes("a.arc", 2, [("http://x/", b"plain"), ("http://y/", b"HTTP/1.1 200 OK\r\n\r\nz")])
    frame = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-2])), ("c", bytearray(b"\xff\xfe")), ("d", None)], "name string, content binary")
    rows = ar.arc_records(frame).collect()
    assert sum(r.error is None for r in rows) == 3 and sum(r.error is not None for r in rows) == 2
    failed = ar.write_warc(ar.arc_records(frame), str(tmp_path / "w"))
    assert sorted(r.archive for r in failed.collect()) == ["b", "c"]
    assert sorted(r.record_type for r in ar.read_warc(spark, str(tmp_path / "w")).collect()) == ["resource", "resource", "response"]


def test_identifiers_of_any_size(spark, tmp_path):
    keys = [5, 1234567890123456789, 1234567890123456790, (1 << 63) - 1, -(1 << 63), -7]
    rows = [(k, f"http://a/{k}", f"{k % 2}" * 1500) for k in keys] + [(k, f"http://b/{k}", "") for k in keys]
    got = ar.converted(spark.createDataFrame([(*r, "s", "b", 1) for r in rows], SCHEMA), str(tmp_path / "w")).drop("record_id").collect()
    want = {(k, max(j for j in keys if j % 2 == k % 2)) for k in keys}
    assert {(r.page_id, r.refers_to or r.page_id) for r in got if r.payload_bytes} == want and len(got) == 12
    for mark in ("9223372036854775808", "-9223372036854775809", "1" * 40, "x", "", "\u0661", None):
        assert ar.page_number(mark) is None
    assert ar.page_number("-9223372036854775808") == -(1 << 63)


#: As crawlers wrote them, by hand: an address with a blank, a header line that ends in CR LF, a checksum, a body with line ends.
FOREIGN_1 = (
    b"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://www.dryswamp.edu:80/index page.html 127.10.100.2 19961104142103 text/html 40\r\n"
    b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<html>\n</html>\n\n"
)
FOREIGN_2 = (
    b"filedesc://x.arc 0.0.0.0 20030101000000 text/plain 200 - - 0 x.arc 118\n2 0 Some Crawler\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    b"http://a.example/ 10.0.0.1 20030102030405 text/html 200 sha1:ABC - 200 x.arc 30\nHTTP/1.1 200 OK\r\n\r\nhello world\n"
    b"dns:a.example 10.0.0.1 20030102030406 text/dns 200 - - 300 x.arc 9\n1.2.3.4\n\n\n"
)


def test_foreign_archives():
    size = lambda data: data.replace(b" 76\n", b" %d\n" % len(data.split(b"\n", 1)[1].split(b"\n\n")[0] + b"\n"), 1)
    one = list(ar.arc_captures(size(FOREIGN_1)))
    assert [(f["URL"], f["Archive-date"], e) for f, _, e in one] == [("http://www.dryswamp.edu:80/index page.html", "19961104142103", "")]
    assert ar.http_parts(one[0][1]) == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"<html>\n</html>\n")
    two = list(ar.arc_captures(FOREIGN_2.replace(b" 118\n", b" %d\n" % len(b"2 0 Some Crawler\n" + ar.FIELDS[2] + b"\n"), 1)))
    assert [(f["URL"], f["Checksum"], c) for f, c, _ in two] == [("http://a.example/", "sha1:ABC", b"HTTP/1.1 200 OK\r\n\r\nhello world"), ("dns:a.example", "-", b"1.2.3.4\n\n")]


def test_small_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"{i} " * 400) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    ar.write_warc(ar.arc_records(ar.pages_to_arc(pages)), str(tmp_path / "w"), size=2000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3 and ar.read_warc(spark, str(tmp_path / "w")).count() == 40


def test_no_rows(spark, tmp_path):
    assert ar.converted(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).collect() == []
