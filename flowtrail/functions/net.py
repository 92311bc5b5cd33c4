"""Network addresses as sortable keys, in Python for literals and as Columns for data.

A key is the address in lower-case hexadecimal: 8 digits for IPv4, 32 for IPv6. Keys of one family
sort as the addresses do, so a prefix is a range of keys. Tables that only hold IPv4 may use LONG.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that are not public: fixed values, pinned here because their definition is not part of the survey's sources.
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/127", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32",
)


def key(address: str) -> str:
    a = ipaddress.ip_address(address)
    return f"{int(a):0{8 if a.version == 4 else 32}x}"


def prefix_range(prefix: str) -> tuple[int, int, int]:
    """(version, lowest, highest) of a prefix or a single address; host bits are ignored."""
    net = ipaddress.ip_network(prefix, strict=False)
    return net.version, int(net.network_address), int(net.broadcast_address)


def merged(prefixes: Iterable[str]) -> list[tuple[int, int, int]]:
    """Disjoint sorted ranges that cover the prefixes."""
    out: list[tuple[int, int, int]] = []
    for v, lo, hi in sorted(map(prefix_range, prefixes)):
        if out and out[-1][0] == v and lo <= out[-1][2] + 1:
            out[-1] = (v, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((v, lo, hi))
    return out


def contains(ranges: Iterable[tuple[int, int, int]], address: Column, is_long: bool) -> Column:
    """Whether an address lies in one of the ranges; null where the address is null."""
    out = F.when(address.isNotNull(), F.lit(False))
    for v, lo, hi in ranges:
        if is_long:
            if v == 4:
                out = out | address.between(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
        else:
            n = 8 if v == 4 else 32
            out = out | ((F.length(address) == n) & address.between(F.lit(f"{lo:0{n}x}"), F.lit(f"{hi:0{n}x}")))
    return out


def is_v6(address: Column, is_long: bool) -> Column:
    return F.when(address.isNotNull(), F.lit(False)) if is_long else F.length(address) == 32


def not_public(address: Column, is_long: bool) -> Column:
    return contains(merged(NOT_PUBLIC), address, is_long)


def v4_long(text: Column) -> Column:
    """A dotted quad as LONG; null if it isn't one."""
    parts = F.split(text, r"\.")
    ok = F.regexp(text, F.lit(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\z"))
    return F.when(ok, F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def v4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def to_key(text: Column) -> Column:
    """The key of an address in text form, IPv4 or IPv6 with one `::` at most; null if it is neither."""
    halves = F.split(F.lower(text), "::", -1)
    groups = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    fill = F.lit(8) - F.size(left) - F.size(right)
    short = F.when(F.size(halves) == 2, fill >= 1).otherwise((F.size(halves) == 1) & (fill == 0))
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), right)
    v6 = F.when(short & F.regexp(F.lower(text), F.lit(r"^[0-9a-f:]+\z")) & F.forall(every, lambda x: F.length(x) <= 4), F.array_join(F.transform(every, lambda x: F.lpad(x, 4, "0")), ""))
    v4 = v4_long(text)
    return F.coalesce(F.lower(F.lpad(F.hex(v4), 8, "0")), F.when(F.contains(text, F.lit(":")), v6))


def after(key: Column) -> Column:
    """The key of the next address of its family, null after the last one."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(key) / 8).cast("int") - 1), lambda i: F.substring(key, F.length(key) - 8 * i - 7, F.lit(8)))  # from the right
    start = F.struct(F.lit(1).cast("long").alias("carry"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.conv(x, 16, 10).cast("long") + a["carry"]
        return F.struct(F.shiftright(n, 32).alias("carry"), F.concat(F.lower(F.lpad(F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), a["out"]).alias("out"))

    made = F.aggregate(parts, start, step)
    return F.when(made["carry"] == 0, made["out"])


def last_of(key: Column, bits: Column) -> Column:
    """The key of the last address of a prefix: an address of it and its length in bits. Of an IPv4 prefix it is the broadcast address."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    ones = F.element_at(F.array(*[F.lit(x) for x in (15, 7, 3, 1)]), rest + 1)
    part = F.when((rest > 0) & (whole < F.length(key)), F.lower(F.hex(digit.bitwiseOR(ones)))).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole), part), F.length(key), F.lit("f"))


def first_of(key: Column, bits: int, digits: int) -> Column:
    """The key of the first address of the prefix of so many bits around an address, whose key has so many digits."""
    whole, rest = divmod(bits, 4)
    kept = F.substring(key, 1, whole)
    if rest:
        kept = F.concat(kept, F.lower(F.hex(F.conv(F.substring(key, whole + 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(16 - (1 << 4 - rest))))))
    return F.rpad(kept, digits, "0")
