"""Legacy ARC archives to WARC: parse, convert, write, and read back.

An ARC file opens with a version block that says how many fields its header lines have: five in version
1, ten in version 2, the last being the length of what follows. Conversion keeps the captured bytes and
synthesises what ARC lacks: record identifiers, ISO timestamps, record types and SHA-1 digests. Payloads
that repeat become revisits. Each task makes whole WARC files of bounded size, a warcinfo record first and every record a gzip member
of its own; Spark's text writer puts each into a file, so they can go to any file system that Spark writes to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

#: Payloads from this many bytes on become revisits when they repeat.
REVISIT = 1000
#: Bytes of an archive made from pages; of a WARC file, which one record may take over it.
ARCHIVE, FILE = 4 << 20, 32 << 20
#: Of gzip: the records are compressed by Python, where higher levels cost more than all else.
LEVEL = 1
CAPTURED = "20240101000000"
#: Fields of a header line in each version: fixed by the format.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of nothing, which the text writer puts at a file's end.
NOTHING = bytes.fromhex("1f8b0800000000000003" "03000000000000000000")
#: What can't stand in a field of a header line.
UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


# ARC


def arc_bytes(name: str, version: int, captures: list[tuple[str, bytes]], date: str = CAPTURED) -> bytes:
    """An archive of (address, content), as a crawler of the time wrote it."""
    block = b"%d 0 loomql\n%s\n" % (version, FIELDS[version])

    def line(url: bytes, mime: bytes, at: int, size: int) -> bytes:
        more = b" 200 - - %d %s" % (at, name.encode()) if version == 2 else b""
        return b"%s 0.0.0.0 %s %s%s %d\n" % (url, date.encode(), mime, more, size)

    out = [line(b"filedesc://" + name.encode(), b"text/plain", 0, len(block)), block, b"\n"]
    at = sum(map(len, out))
    for url, content in captures:
        safe = UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()) or b"-"
        out += [line(safe, b"text/html", at, len(content)), content, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def arc_captures(data: bytes) -> Iterator[tuple[dict | None, bytes, str]]:
    """(fields, content, error) of each capture. What can't be parsed ends the archive with one row that has only an error."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        opening = line.startswith(b"filedesc://")
        if opening:  # its own version stands in its block
            seen = data[end + 1 : end + 3] if end >= 0 else b""
            version = int(seen[:1]) if seen[:1] in (b"1", b"2") and seen[1:] == b" " else 0
        parts = line.rsplit(b" ", FIELDS[version].count(b" ")) if version else []
        if end < 0 or len(parts) != (len(FIELDS[version].split()) if version else -1) or not parts[-1].isdigit():
            yield None, b"", f"no header line at byte {at}"
            return
        size = int(parts[-1])
        if end + 1 + size > len(data):
            yield None, b"", f"content at byte {end + 1} ends after {len(data) - end - 1} of {size} bytes"
            return
        if not opening:
            names = FIELDS[version].decode().split()
            yield dict(zip(names, (p.decode("utf-8", "replace") for p in parts), strict=True)), data[end + 1 : end + 1 + size], ""
        at = end + 1 + size


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response with its blank line, empty if it is none, and the payload."""
    if content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", content


def header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name), head)
    return found[1].decode("utf-8", "replace") if found else None


def page_number(mark: str | None) -> int | None:
    """The identifier in a capture's head, if it is one that fits a long."""
    n = int(mark) if mark and re.fullmatch(r"-?[0-9]{1,19}", mark) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def iso_date(digits: str) -> str:
    """The 14 digits of ARC as WARC has them; fewer are filled up with the earliest time, junk becomes the epoch."""
    d = (digits + "00000101000000"[len(digits) :])[:14] if digits.isdigit() and len(digits) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(name, content): pages as ARC archives of both versions in turn. A capture's HTTP head carries the identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, version = [], 0, 1
        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                payload = html.as_py() or b""
                mark = b"" if key is None else b"X-Page-Id: %d\r\n" % key
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (mark, len(payload))
                held.append((url or "", head + payload))
                size += len(payload)
                if size >= ARCHIVE:
                    name = f"{uuid.uuid4().hex}.arc"
                    yield pa.RecordBatch.from_pydict({"name": [name], "content": [arc_bytes(name, version, held)]})
                    held, size, version = [], 0, 3 - version
        if held:
            name = f"{uuid.uuid4().hex}.arc"
            yield pa.RecordBatch.from_pydict({"name": [name], "content": [arc_bytes(name, version, held)]})

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "name string, content binary")


RECORD = "archive string, record_id string, page_id long, url string, date string, mime string, head binary, payload binary, sha1 string, bytes long, second long, error string"


def arc_records(archives: DataFrame) -> DataFrame:
    """A row for each capture of (name, content) archives, with the WARC fields that its ARC header and content determine.

    The identifier is a function of address, date, page and payload, so a task that runs again gives the same.
    Archives that end badly give their good captures, then a row with the archive's name and an error. ``second`` is another digest of the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.binary() if c in ("head", "payload") else pa.int64() if c in ("page_id", "bytes", "second") else pa.string() for c in names]
        for batch in batches:
            for archive, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for fields, content, error in arc_captures(blob.as_py() or b""):
                    if fields is None:
                        rows.append((archive,) + (None,) * 10 + (error,))
                        continue
                    head, payload = http_parts(content)
                    sha1 = hashlib.sha1(payload).hexdigest()
                    mark = header(head, b"X-Page-Id")
                    key = page_number(mark)
                    date = iso_date(fields["Archive-date"])
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {date} {key} {sha1}")
                    second = xxhash.xxh64_intdigest(payload) - (1 << 63)
                    rows.append((archive, str(name), key, fields["URL"], date, fields["Content-type"], head, payload, sha1, len(payload), second, None))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return archives.select("name", "content").mapInArrow(run, RECORD)


# WARC


def revisits(records: DataFrame, least: int = REVISIT) -> DataFrame:
    """(record_id, refers_to_id) of the records whose payload of at least ``least`` bytes the record with the largest page_id repeats.

    Payloads are equal if two digests and the length are. Only these and identifiers are shuffled, and each payload's largest is found
    with map-side combining.
    """
    payload = ["sha1", "bytes", "second"]
    index = written(records.filter(F.col("error").isNull() & (F.col("bytes") >= least)).select("record_id", "page_id", *payload), "captures")
    last = index.groupBy(*payload).agg(F.max(F.struct("page_id", "record_id")).alias("last"), F.count("*").alias("n")).filter("n > 1")
    return index.join(last.select(*payload, "last"), payload).filter(~F.col("page_id").eqNullSafe(F.col("last.page_id"))).select("record_id", F.col("last.record_id").alias("refers_to_id")).distinct()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    top = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", len(block))])
    return b"".join([made.compress(b"WARC/1.1\r\n" + top.encode() + b"\r\n"), made.compress(block), made.compress(b"\r\n\r\n"), made.flush()])


def warcinfo(date: str) -> bytes:
    block = b"software: loomql\r\nformat: WARC File Format 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def write_warc(records: DataFrame, path: str, least: int = REVISIT, size: int = FILE) -> DataFrame:
    """Write WARC 1.1 files of about ``size`` bytes: responses, resources where there is no HTTP head, and revisits without payload.

    Returns the (archive, error) of what couldn't be converted, which is in no file.
    """
    columns = ["record_id", "url", "date", "mime", "head", "payload", "sha1", "refers_to_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], size
        for batch in batches:
            for name, url, date, mime, head, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "revisit" if refers else "response" if head else "resource"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url)]
                if refers:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers}>")]
                fields += [("Content-Type", "application/http;msgtype=response" if head else mime), ("WARC-Payload-Digest", f"sha1:{sha1}")]
                held = held or [warcinfo(date)]
                held.append(warc_record(fields, head if refers else head + payload))
                room -= len(held[-1])
                if room <= 0:
                    yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})
                    held, room = [], size
        if held:
            yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})

    rows = records.filter(F.col("error").isNull()).join(revisits(records, least), "record_id", "left").select(*columns)
    files = rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))  # the writer takes the bytes as they are
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    return records.filter(F.col("error").isNotNull()).select("archive", "error")


def inflated(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The parts of a gzip file of one or more members. What a member leaves of a step is copied, so steps are short."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            part = data[at : at + step]
            if not part:
                raise ValueError("a gzip member ends early")
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzipped WARC file, by the declared lengths."""
    held = bytearray()
    parts = inflated(data)

    def more(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not more(len(held) + 1):
                if bytes(held).strip():
                    raise ValueError("a WARC record ends early")
                return
            end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if not more(stop + 4) or not lines[0].startswith("WARC/") or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{lines[0]}: wrong length")
        yield fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record but warcinfo: record_id, page_id, record_type, payload_bytes, payload_digest, refers_to_id; the digests of blocks and payloads are checked."""
    names = ["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for fields, block in warc_records(blob.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    again = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Block-Digest"].removeprefix("sha1:") != hashlib.sha1(block).hexdigest() or not again and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: wrong digest")
                    mark = header(head, b"X-Page-Id")
                    size = int(header(head, b"Content-Length") or 0) if again else len(payload)
                    rows.append((fields["WARC-Record-ID"][10:-1], page_number(mark), fields["WARC-Type"], size, digest, fields["WARC-Refers-To"][10:-1] if again else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for c, n in zip(cols, names, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string")


def converted(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages to ARC, ARC to WARC files at ``path``, and these read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null address "-". Rows that repeat a page each have a record; if theirs is the payload's largest
    page_id, all are responses. A null page_id counts as smaller than any other. Other columns play no part. No rows give no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(arc_records(pages_to_arc(pages)), path)
    found = written(read_warc(spark, path), "records")
    own = found.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    return found.join(own, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
