"""Scalar helpers whose results must agree with the rules' own definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round2(x: Column) -> Column:
    """To two decimals, halves away from zero, on the binary value (1.005 gives 1.0)."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def human_bytes(n: Column) -> Column:
    """1536 as `1.5 KB`: powers of 1024, one decimal (ties to even), whole bytes plain."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(n >= 1 << 10 * k, F.concat(F.format_string("%.1f", F.bround(n / (1 << 10 * k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def utc_offset_label(seconds: int) -> str:
    sign = "-" if seconds < 0 else "+"
    return f"UTC{sign}{abs(seconds) // 3600:02d}:{abs(seconds) % 3600 // 60:02d}"


def fnv64a(entries: Column, seed: Column) -> Column:
    """The 64-bit FNV-1a hash, as 16 hexadecimal digits, of strings that each end in a zero byte and of an unsigned number's 8 bytes.

    Both halves of the state are kept apart, so that no product passes a LONG.
    """
    text = F.concat(F.array_join(F.transform(entries, lambda x: F.concat(F.hex(x.cast("binary")), F.lit("00"))), ""), F.lpad(F.hex(seed), 16, "0"))
    low = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(0xCBF29CE4).alias("hi"), F.lit(0x84222325).alias("lo"))

    def step(a: Column, byte: Column) -> Column:
        lo = a["lo"].bitwiseXOR(byte)
        product = lo * 0x1B3
        hi = (a["hi"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(lo, 8)).bitwiseAND(low)
        return F.struct(hi.alias("hi"), product.bitwiseAND(low).alias("lo"))

    start = F.struct(start["hi"].cast("long").alias("hi"), start["lo"].cast("long").alias("lo"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 2).cast("int") - 1), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    out = F.aggregate(bytes_, start, step)
    return F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))


def zone_label(seconds: Column, offset_s: int = 0) -> Column:
    """Epoch seconds as local time with its offset: `2024-01-01 02:00:00 UTC+02:00`. The session's zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds + offset_s), "yyyy-MM-dd HH:mm:ss"), F.lit(" " + utc_offset_label(offset_s)))
