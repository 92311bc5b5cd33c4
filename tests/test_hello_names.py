"""Server names of client hellos, with many extensions before them and in damaged hellos."""

import time

import pytest
from pyspark.sql import functions as F

from flowtrail import item_queries
from flowtrail.operators import sniff
from flowtrail.session import prepare


def hello(name: bytes, before: int, end: bytes = b"") -> bytes:
    sni = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    extensions = b"\x00\xff\x00\x00" * before + sni + end
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + len(extensions).to_bytes(2, "big") + extensions
    return b"\x01" + len(body).to_bytes(3, "big") + body


def record(data: bytes) -> bytes:
    return b"\x16\x03\x01" + len(data).to_bytes(2, "big") + data


@pytest.mark.parametrize("cut", range(1, 80, 6))
def test_damaged(cut):
    whole = hello(b"a.test", 3)
    assert sniff.hello_name(whole) == "a.test"
    assert sniff.hello_name(whole[:-cut]) in (None, "", *("a.test"[:k] for k in range(7)))


def test_no_name():
    assert sniff.hello_name(b"") is None
    assert sniff.hello_name(hello(b"", 0)) == ""
    assert sniff.hello_name(hello(b"\xff.test", 0)) == "�.test"


def test_many_extensions(spark):
    """Time goes with the extensions, not with many evaluations of the lengths for each of them."""
    payload = record(hello(b"Sni.Test", 500))
    df = spark.range(20_000, numPartitions=4).select("id", F.concat(F.lit(payload), F.col("id").cast("string").cast("binary")).alias("payload"))
    sniff.classify(df.limit(10)).collect()  # code and workers are ready
    began = time.perf_counter()
    assert {tuple(r) for r in sniff.classify(df).select("protocol", "domain").distinct().collect()} == {("tls", "sni.test")}
    assert time.perf_counter() - began < 40


def test_long_code_is_compiled(spark):
    """The JVM leaves methods above this size to its interpreter."""
    assert int(prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_pieces_are_dealt_by_stream(spark):
    """Not by their places in the streams, of which there are three, whatever the number of streams; and numbers of a few bytes are longs."""
    plan = item_queries.sniff_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "hashpartitioning(id#" in exchanges[0]
    data = spark.createDataFrame([(bytearray(b"\xff" * 9),), (bytearray(b"\x01"),)], "p binary")
    got = data.select(*[sniff._at(F.col("p"), 1, n).alias(f"n{n}") for n in (1, 4, 7, 8)])
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "decimal(20,0)"]
    assert [tuple(r) for r in got.collect()] == [(0xFF, (1 << 32) - 1, (1 << 56) - 1, (1 << 64) - 1), (None,) * 4]
