"""ARC to WARC: round trips through real files, both versions, revisits, broken archives."""

import base64
import gzip
import hashlib

import pytest

from flowtrail.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/", "<p>same</p>"), (2, "http://b.example/x y", "<p>same</p>"), (3, None, "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (4, "http://c.example", None), (5, "http://d.example", ""),
    (None, "http://e.example", "<p>same</p>"), (0, "http://f.example", "x" * 6_000_000), (7, "http://f.example", "\n0\n\n"), (7, "http://f.example", "\n0\n\n"), (-9, "http://g.example", "\x00\x1f"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes):
    first = {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(rows, key=order):
        first.setdefault(r[2] or "", r)
    out, seen = [], set()
    for r in sorted(rows, key=order):
        text = r[2] or ""
        whole = len(text.encode()) < min_bytes or text not in seen
        seen.add(text)
        out.append((r[0], len(text.encode()), digest(text), "response" if whole else "revisit", None if whole else first[text][0]))
    return out


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_pages_through_archives(spark, min_bytes):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, PAGES).withColumns({"id": F.lit("clash"), "digest": F.lit("clash"), "first": F.lit(1)})
    got = [tuple(r) for r in warc.through_archives(df.repartition(3), min_bytes).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected(ROWS, min_bytes), key=key)


def test_empty_table(spark):
    assert warc.through_archives(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_plain_gzip_warc_and_read_whole(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES)
    records = warc.table(warc.convert(warc.pack_arc(df)), "t")
    warc.write(warc.resolve(records), f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("part-*"))
    assert files
    seen = 0
    for f in files:
        plain = gzip.decompress(f.read_bytes())
        parsed = list(warc.parse_warc(f.read_bytes()))
        assert parsed == list(warc.parse_warc(plain)) and parsed[0][0]["warc-type"] == "warcinfo"
        for h, block in parsed[1:]:
            assert h["warc-date"] == "2024-01-01T00:00:00Z" and h["warc-record-id"].startswith("<urn:uuid:")
            assert len(block) == int(h["content-length"])
            seen += 1
    assert seen == len(ROWS)
    back = {r.payload.decode() for r in warc.read(spark, f"file://{tmp_path}/w").where("type = 'response'").collect()}
    assert back == {r[2] or "" for r in ROWS}
    again = warc.table(warc.convert(warc.pack_arc(df)), "t")
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in records.collect())


def test_other_content_and_versions(spark):
    body = b"GIF89a\n\nnot http"
    for version in (1, 2):
        arc = warc.arc_version_block(version, "x.arc") + warc.arc_record(version, "dns:a b", body, "x.arc", 0, "image/gif") + b"\n\n" + warc.arc_record(version, "http://x", b"", "x.arc", 0)
        df = spark.createDataFrame([("x.arc", bytearray(arc))], "name string, content binary")
        a, b = warc.convert(df).collect()
        assert (a.type, a.uri, a.payload_bytes, a.date, a.error) == ("resource", "dns:a%20b", len(body), "2024-01-01T00:00:00Z", None)
        (h, block), = warc.parse_warc(bytes(a.member))
        assert block == body and h["content-type"] == "image/gif" and h["warc-block-digest"] == f"sha1:{warc.sha1(body)}"
        assert b.payload_bytes == 0 and b.digest == digest("")


@pytest.mark.parametrize("cut, records", [(-3, 1), (-40, 1)])
def test_broken_archives_give_what_comes_before(spark, cut, records):
    arc = warc.arc_version_block(1, "x") + warc.arc_record(1, "http://a", b"HTTP/1.0 200 OK\r\n\r\nbody", "x", 0) + warc.arc_record(1, "http://b", b"b" * 50, "x", 0)
    rows = warc.convert(spark.createDataFrame([("x", bytearray(arc[:cut])), ("y", bytearray(b"nothing")), ("z", None)], "name string, content binary")).collect()
    assert sum(r.error is None for r in rows) == records and sum(r.error is not None for r in rows) == 3


def test_wrong_digest_is_noticed():
    with pytest.raises(ValueError):
        warc._read({"warc-type": "response", "warc-payload-digest": "sha1:XX", "warc-record-id": "r", "warc-target-uri": "", "warc-date": ""}, b"x", True)


def test_compressed_archives_and_ids(spark, tmp_path):
    """Members for each record, or one for all, give what the plain archive gives; other content gives other ids."""
    parts = [warc.arc_version_block(1, "x"), warc.arc_record(1, "http://a", b"HTTP/1.0 200 OK\r\n\r\nbody", "x", 0), warc.arc_record(1, "http://b", b"b" * 50, "x", 0)]
    other = [parts[0], warc.arc_record(1, "http://a", b"HTTP/1.0 200 OK\r\n\r\nBODY", "x", 0), parts[2]]
    for k, data in enumerate((b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)), b"".join(other))):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "same.arc.gz").write_bytes(data)
    plain, members, one, changed = ([(r.id, r.uri, r.digest, r.error) for r in warc.convert(warc.read_arc(spark, f"file://{tmp_path}/{k}")).collect()] for k in range(4))
    assert plain == members == one and len(plain) == 2 and plain[0][0] != changed[0][0] and plain[1][0] == changed[1][0]
    assert warc.convert(spark.createDataFrame([("z", bytearray(b"\x1f\x8bnothing"))], "name string, content binary")).first().error
