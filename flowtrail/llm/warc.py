"""Legacy web archives: ARC files are parsed by their version's header line and declared lengths and
rewritten as WARC, with identifiers, timestamps, types and digests made for the records.

ARC 1 records start with `URL IP-address Archive-date Content-type Archive-length`, ARC 2 records have
`Result-code Checksum Location Offset Filename` before the length. Archives are written through
Spark's file writer, one gzip member for each record, so any store that Spark writes to will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Bytes of records after which an archive ends; one of any size may follow them.
ARCHIVE_BYTES = 4 << 20
DATE = "20240101000000"
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: A gzip member without content. An archive ends with it, but for its last byte, which the file writer adds.
_EMPTY = gzip.compress(b"", mtime=0)
_TAIL = "\x00"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{TITLES[version]}\n".encode()
    first = {1: f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return first.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, body: bytes, name: str, offset: int, mime: str = "text/html") -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "unknown:"
    head = f"{url} 0.0.0.0 {DATE} {mime} " + (f"{len(body)}" if version == 1 else f"200 {sha1(body)} - {offset} {name} {len(body)}")
    return head.encode() + b"\n" + body + b"\n"


def pack_arc(pages: DataFrame) -> DataFrame:
    """name and content of ARC archives of some ARCHIVE_BYTES with an HTTP response for each row of page_id, url, html.

    Versions alternate by archive. A null html is an empty body, a null url `unknown:`.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, content = TaskContext.get().partitionId(), 0, b""
        rows = (row for b in batches for row in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist()))
        name, chunks, size = "", [], 0
        for page_id, url, html in rows:
            version = 1 + k % 2
            if not chunks:
                name = f"part-{part:05d}-{k:05d}.arc"
                chunks = [arc_version_block(version, name)]
                size = len(chunks[0])
            body = (html or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
            head += f"X-Page-Id: {quote(str(page_id), safe='')}\r\n\r\n" if page_id is not None else "\r\n"
            chunks.append(arc_record(version, url or "", head.encode() + body, name, size))
            size += len(chunks[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.record_batch({"name": pa.array([name]), "content": pa.array([b"".join(chunks)], pa.binary())})
                chunks, k = [], k + 1
        if chunks:
            yield pa.record_batch({"name": pa.array([name]), "content": pa.array([b"".join(chunks)], pa.binary())})

    return pages.select("page_id", "url", "html").mapInArrow(task, "name string, content binary")


def _unpacked(data: bytes) -> bytes:
    """An archive without its compression: gzip members, one for each record or one for all, or plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    chunks = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            chunks.append(d.decompress(data) + d.flush())
        except zlib.error as e:
            raise ValueError(f"member {len(chunks)}: {e}") from None
        if not d.eof:
            break  # cut off: what there is of it counts, and its record's length tells
        data = d.unused_data
    return b"".join(chunks)


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of each record after the version block, by declared length; of compressed archives the offset is that in the plain one.

    Raises ValueError where a header line or a length is not as the version has it.
    """
    content = _unpacked(content)
    end = content.find(b"\n")
    first = content[:end].decode("utf-8", "replace").split(" ")
    if end < 0 or not first[0].startswith("filedesc:"):
        raise ValueError("no version block")
    at = end + 1 + int(first[-1])
    version = int(content[end + 1 : at].split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"version {version}")
    names = FIELDS[version]
    while at < len(content):
        if content[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = content.find(b"\n", at)
        values = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").split(" ")
        if end < 0 or len(values) != len(names) or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(content):
            raise ValueError(f"record at {at}")
        body = content[end + 1 : end + 1 + int(values[-1])]
        yield at, dict(zip(names, values)), body
        at = end + 1 + len(body)


# WARC


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _urn(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(of))}>"


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response, with the empty line, and what follows; no head if it isn't one."""
    cut = body.find(b"\r\n\r\n")
    return (body[: cut + 4], body[cut + 4 :]) if body.startswith(b"HTTP/") and cut >= 0 else (b"", body)


def _page(head: bytes) -> str | None:
    """The X-Page-Id of an HTTP head."""
    found = re.search(rb"\r\nX-Page-Id: ([^\r\n]*)\r\n", head)
    return unquote(found[1].decode()) if found else None


CONVERTED = "seq string, id string, uri string, date string, type string, payload_bytes long, digest string, head binary, member binary, error string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """name and content of the ARC files under path, compressed or not, for convert()."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def convert(archives: DataFrame, ids: str = "bigint") -> DataFrame:
    """The WARC records that ARC archives (name, content) make, each with its gzip member.

    The identifier is made from archive, offset, address, date and content, so a rerun gives the same and
    another archive of the same name does not; the timestamp is the
    archive date in W3C form; the type is response for HTTP responses, resource for others; the digests
    are SHA-1 in base32. seq: the X-Page-Id of the response as the type `ids`, null if there is none. An archive that
    breaks off gives its records up to there and one row that has only the error.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in CONVERTED.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for b in batches:
            for name, content in zip(b["name"].to_pylist(), b["content"].to_pylist()):
                rows = []
                try:
                    for at, f, body in parse_arc(content or b""):
                        rows.append(_converted(name or "", at, f, body))
                except ValueError as e:
                    rows.append((*[None] * (len(names) - 1), f"{name}: {e}"))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, types[t.split(" ")[1]]) for c, t in zip(columns, CONVERTED.split(", "))], names=names)

    return archives.select("name", "content").mapInArrow(task, CONVERTED).withColumn("seq", F.col("seq").try_cast(ids))


def _converted(name: str, at: int, f: dict[str, str], body: bytes) -> tuple:
    head, payload = _split_http(body)
    d = f["date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    kind, digest, ident = "response" if head else "resource", sha1(payload), _urn(name, str(at), f["url"], f["date"], sha1(body))
    headers = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", f["url"]), ("WARC-IP-Address", f["ip"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(body)}")]
    member = _record([*headers, ("Content-Type", "application/http; msgtype=response" if head else f["type"])], body)
    return (_page(head), ident, f["url"], date, kind, len(payload), digest, head, member, None)


def _revisit(ident: str, uri: str, date: str, digest: str, head: bytes, first: dict) -> bytes:
    headers = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", first["id"]), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"]), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, head)


def resolve(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds `first`, the record that each record revisits, null if it is kept in full.

    Of responses with equal payloads of at least min_bytes bytes that with the smallest seq (null last,
    then by identifier) is kept. records must be a written table: the groups are made into one too, so
    that Spark can split a digest with very many records.
    """
    order = F.struct(F.col("seq").isNull().alias("none"), "seq", "id", "uri", "date")
    whole = (F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)
    firsts = table(records.where(whole).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-firsts")
    again: Column = (records["type"] == "response") & (records["payload_bytes"] >= min_bytes)
    joined = records.join(firsts, records["digest"] == firsts["digest"], "left")
    return joined.select(*[records[c] for c in records.columns], F.when(again & (firsts["first"]["id"] != records["id"]), firsts["first"]).alias("first"))


def write(resolved: DataFrame, path: str) -> None:
    """WARC archives of some ARCHIVE_BYTES under path, with a warcinfo record first. Rows that have only an error are not written.

    Each row of the frame that is written is one archive, so a file is one row and the writer's row
    separator is the archive's last byte.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, chunks, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for row in b.to_pylist():
                if not chunks:
                    info = b"software: flowtrail\r\nformat: WARC File Format 1.1\r\n"
                    chunks = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(path, str(part), str(k))), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)]
                chunks.append(row["member"] if row["first"] is None else _revisit(row["id"], row["uri"], row["date"], row["digest"], row["head"], row["first"]))
                size += len(chunks[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch({"content": pa.array([b"".join([*chunks, _EMPTY[:-1]])], pa.binary())})
                    k, chunks, size = k + 1, [], 0
        if chunks:
            yield pa.record_batch({"content": pa.array([b"".join([*chunks, _EMPTY[:-1]])], pa.binary())})

    rows = resolved.where("error is null").select("id", "uri", "date", "digest", "head", "first", F.when(F.col("first").isNull(), F.col("member")).alias("member"))
    archives = rows.mapInArrow(task, "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("lineSep", _TAIL).option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC archive, gzip members or plain, by declared length."""
    data = _unpacked(data)
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        lines = data[at : max(cut, at)].decode("utf-8", "replace").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = data[cut + 4 : cut + 4 + n]
        if len(block) != n:
            raise ValueError(f"short block at {at}")
        yield headers, block
        at = cut + 4 + n + 4


READ = "id string, type string, uri string, date string, refers_to_id string, seq string, payload_bytes long, digest string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True, ids: str = "bigint") -> DataFrame:
    """The records of the WARC archives under path, without warcinfo.

    A response's digest is computed from its payload; where it isn't the declared one, reading fails. A
    revisit has the declared digest and the length that its HTTP head declares, and no payload.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ") for x in READ.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for b in batches:
            for content in b["content"]:
                rows = [_read(h, block, payloads) for h, block in parse_warc(content.as_py()) if h["warc-type"] != "warcinfo"]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, READ).withColumn("seq", F.col("seq").try_cast(ids))


def _read(h: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, payload = _split_http(block)
    declared = h["warc-payload-digest"].removeprefix("sha1:")
    n = len(payload)
    if h["warc-type"] == "revisit":
        n, payload = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1]), None
    elif (digest := sha1(payload)) != declared:
        raise ValueError(f"{h['warc-record-id']}: digest {digest}, declared {declared}")
    return (h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], h.get("warc-refers-to"), _page(head), n, declared, payload if payloads else None)


def through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC files in the shared folder, and the records read back: seq, payload_bytes,
    digest, type and refers_to (the seq of the record that is revisited). Ids keep their type; strings go by code point. Rows that repeat an id give a
    record each. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    ids = pages.schema["page_id"].dataType.simpleString()
    records = table(convert(pack_arc(pages), ids), "warc-records")
    broken = records.where("error is not null").limit(1).collect()
    if broken:
        raise ValueError(broken[0].error)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(resolve(records, min_bytes), path)
    back = table(read(spark, path, payloads=False, ids=ids).drop("payload"), "warc-read")
    kept = back.where("type <> 'revisit'").select(F.col("id").alias("kept_id"), F.col("seq").alias("refers_to"))
    return back.join(kept, F.col("refers_to_id") == F.col("kept_id"), "left").select("seq", "payload_bytes", "digest", "type", "refers_to")
