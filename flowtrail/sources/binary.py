"""Binary rule sets and category files: small codecs, applied to whole files in parallel.

A rule set is the magic, a version byte and a zlib stream of rules; a rule is a list of typed items. The
layout of the domain set inside belongs to a module that the survey could not see: it is written here as
the succinct trie of public implementations, and is tested by round trip only.
"""

from __future__ import annotations

import ipaddress
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.net import merged
from ..plans.rules import CURRENT_VERSION, MAX_DEPTH, Default, Logical, RuleError, RuleSet, rule_set_json

MAGIC = b"SRS"
#: Item types: fixed values of the format.
ITEMS = {
    "query_type": 0, "network": 1, "domain": 2, "domain_keyword": 3, "domain_regex": 4, "source_ip_cidr": 5, "ip_cidr": 6, "source_port": 7, "source_port_range": 8, "port": 9, "port_range": 10,
    "process_name": 11, "process_path": 12, "package_name": 13, "wifi_ssid": 14, "wifi_bssid": 15, "adguard_domain": 16, "process_path_regex": 17, "network_type": 18, "network_is_expensive": 19,
    "network_is_constrained": 20, "network_interface_address": 21, "default_interface_address": 22, "package_name_regex": 23,
}
FINAL = 0xFF
INTERFACES = ("wifi", "cellular", "ethernet", "other")
NUMBERS = ("query_type", "source_port", "port")
SUBDOMAIN, DOMAIN_AND_SUB = "\r", "\n"


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise RuleError("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def uvarint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7
            if shift > 63:
                raise RuleError("number too long")

    def string(self) -> str:
        return self.take(self.uvarint()).decode()

    def numbers(self, size: int) -> list[int]:
        n = self.uvarint()
        return list(struct.unpack(f">{n}{ {1: 'B', 2: 'H', 8: 'Q'}[size] }".replace(" ", ""), self.take(n * size)))


def _string(s: str) -> bytes:
    data = s.encode()
    return uvarint(len(data)) + data


def _numbers(values: list[int], size: int) -> bytes:
    return uvarint(len(values)) + struct.pack(f">{len(values)}" + {1: "B", 2: "H", 8: "Q"}[size], *values)


def _prefixes(prefixes: list[str]) -> bytes:
    ranges = merged(prefixes)
    out = b"\x01" + struct.pack(">Q", len(ranges))
    for v, lo, hi in ranges:
        n = 4 if v == 4 else 16
        out += uvarint(n) + lo.to_bytes(n, "big") + uvarint(n) + hi.to_bytes(n, "big")
    return out


def _read_prefixes(r: Reader) -> list[str]:
    if r.byte() != 1:
        raise RuleError("unknown address set version")
    out = []
    for _ in range(struct.unpack(">Q", r.take(8))[0]):
        lo, hi = (ipaddress.ip_address(r.take(_address_size(r))) for _ in range(2))
        out += [str(n) for n in ipaddress.summarize_address_range(lo, hi)]
    return out


def _address_size(r: Reader) -> int:
    n = r.uvarint()
    if n not in (4, 16):
        raise RuleError("bad address length")
    return n


def _plain_prefixes(prefixes: list[str]) -> bytes:
    out = uvarint(len(prefixes))
    for p in prefixes:
        net = ipaddress.ip_interface(p)
        out += uvarint(len(net.ip.packed)) + net.ip.packed + bytes([net.network.prefixlen])
    return out


def _read_plain_prefixes(r: Reader) -> list[str]:
    return [f"{ipaddress.ip_address(r.take(_address_size(r)))}/{r.byte()}" for _ in range(r.uvarint())]


def _domains(domains: list[str], suffixes: list[str]) -> bytes:
    """A level-order trie over reversed names: leaf bits, label bits (0 a label, 1 the end of a node) and labels."""
    keys = sorted({d[::-1] for d in domains} | {(SUBDOMAIN + s if s.startswith(".") else DOMAIN_AND_SUB + s)[::-1] for s in suffixes})
    data = [k.encode() for k in keys]
    data.sort()
    leaves, bits, labels, queue, node, bit = [], [], bytearray(), [(0, len(data), 0)], 0, 0

    def put(where: list[int], i: int, value: int) -> None:
        while len(where) <= i >> 6:
            where.append(0)
        where[i >> 6] |= value << (i & 63)

    while node < len(queue):
        lo, hi, col = queue[node]
        if lo < hi and col == len(data[lo]):
            lo += 1
            put(leaves, node, 1)
        while lo < hi:
            end = lo
            while end < hi and data[end][col] == data[lo][col]:
                end += 1
            queue.append((lo, end, col + 1))
            labels.append(data[lo][col])
            put(bits, bit, 0)
            bit, lo = bit + 1, end
        put(bits, bit, 1)
        bit, node = bit + 1, node + 1
    return b"\x00" + _numbers(leaves, 8) + _numbers(bits, 8) + _numbers(list(labels), 1)


def _read_domains(r: Reader) -> tuple[list[str], list[str]]:
    r.byte()
    leaves, bits, labels = r.numbers(8), r.numbers(8), bytes(r.numbers(1))
    on = lambda where, i: i >> 6 < len(where) and where[i >> 6] >> (i & 63) & 1
    domains, suffixes, words, bit, node, child = [], [], [b""], 0, 0, 0
    while node < len(words):
        word = words[node]
        if on(leaves, node):
            name = word.decode()[::-1]
            (suffixes if name[:1] in (SUBDOMAIN, DOMAIN_AND_SUB) else domains).append(name.removeprefix(SUBDOMAIN).removeprefix(DOMAIN_AND_SUB))
        while bit < 64 * len(bits) and not on(bits, bit):
            if child >= len(labels):
                raise RuleError("bad domain set")
            words.append(word + labels[child : child + 1])
            child, bit = child + 1, bit + 1
        bit, node = bit + 1, node + 1
    return domains, suffixes


def _write_rule(rule, out: bytearray, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise RuleError("logical rule nested too deep")
    if isinstance(rule, Logical):
        out += bytes([1, 0 if rule.mode == "and" else 1]) + uvarint(len(rule.rules))
        for r in rule.rules:
            _write_rule(r, out, depth + 1)
        out += bytes([rule.invert])
        return
    out += b"\x00"
    done = False
    for name, value in rule.fields.items():
        if name in ("domain", "domain_suffix"):
            if not done:
                out += bytes([ITEMS["domain"]]) + _domains(rule.get("domain"), rule.get("domain_suffix"))
            done = True
            continue
        if name == "adguard_domain":
            raise RuleError("filter lines have no binary form here")
        out += bytes([ITEMS[name]])
        if value is True:
            continue
        if name in NUMBERS:
            out += _numbers(value, 2)
        elif name in ("source_ip_cidr", "ip_cidr"):
            out += _prefixes(value)
        elif name == "network_type":
            out += _numbers([INTERFACES.index(v) for v in value], 1)
        elif name == "network_interface_address":
            out += uvarint(len(value))
            for kind, prefixes in value.items():
                out += bytes([INTERFACES.index(kind)]) + _plain_prefixes(prefixes if isinstance(prefixes, list) else [prefixes])
        elif name == "default_interface_address":
            out += _plain_prefixes(value)
        else:
            out += uvarint(len(value)) + b"".join(map(_string, value))
    out += bytes([FINAL, rule.invert])


def _read_rule(r: Reader, depth: int = 0):
    if depth > MAX_DEPTH:
        raise RuleError("logical rule nested too deep")
    kind = r.byte()
    if kind == 1:
        mode = r.byte()
        if mode > 1:
            raise RuleError(f"unknown logical mode: {mode}")
        rules = tuple(_read_rule(r, depth + 1) for _ in range(r.uvarint()))
        return Logical(("and", "or")[mode], rules, bool(r.byte()))
    if kind != 0:
        raise RuleError(f"unknown rule type: {kind}")
    names, fields = {v: k for k, v in ITEMS.items()}, {}
    while (item := r.byte()) != FINAL:
        name = names.get(item)
        if name is None or name == "adguard_domain":
            raise RuleError(f"unknown rule item type: {item}")
        if name == "domain":
            domains, suffixes = _read_domains(r)
            fields |= {k: v for k, v in (("domain", domains), ("domain_suffix", suffixes)) if v}
        elif name in ("network_is_expensive", "network_is_constrained"):
            fields[name] = True
        elif name in NUMBERS:
            fields[name] = r.numbers(2)
        elif name in ("source_ip_cidr", "ip_cidr"):
            fields[name] = _read_prefixes(r)
        elif name == "network_type":
            fields[name] = [INTERFACES[i] for i in r.numbers(1)]
        elif name == "network_interface_address":
            fields[name] = {INTERFACES[r.byte()]: _read_plain_prefixes(r) for _ in range(r.uvarint())}
        elif name == "default_interface_address":
            fields[name] = _read_plain_prefixes(r)
        else:
            fields[name] = [r.string() for _ in range(r.uvarint())]
    return Default(fields, bool(r.byte()))


def write_rule_set(rule_set: RuleSet) -> bytes:
    out = bytearray(uvarint(len(rule_set.rules)))
    for rule in rule_set.rules:
        _write_rule(rule, out)
    return MAGIC + bytes([rule_set.version]) + zlib.compress(bytes(out), 9)


def read_rule_set(data: bytes) -> RuleSet:
    if data[:3] != MAGIC:
        raise RuleError("not a binary rule set")
    if len(data) < 4 or data[3] > CURRENT_VERSION:
        raise RuleError("unsupported version")
    try:
        r = Reader(zlib.decompress(data[4:]))
    except zlib.error as e:
        raise RuleError(str(e)) from None
    return RuleSet(data[3], tuple(_read_rule(r) for _ in range(r.uvarint())))


def write_categories(items: dict[str, list[tuple[int, str]]]) -> bytes:
    """A category file: version 0, an index of codes in order, then (type, value) items."""
    head, body = bytearray(b"\x00" + uvarint(len(items))), bytearray()
    for code in sorted(items):
        head += _string(code) + uvarint(len(body)) + uvarint(len(items[code]))
        for kind, value in items[code]:
            body += bytes([kind]) + _string(value)
    return bytes(head + body)


def read_categories(data: bytes) -> Iterator[tuple[str, int, str]]:
    r = Reader(data)
    if r.byte() != 0:
        raise RuleError("unknown version")
    index = [(r.string(), r.uvarint(), r.uvarint()) for _ in range(r.uvarint())]
    start = r.at
    for code, offset, n in index:
        r.at = start + offset
        for _ in range(n):
            yield code, r.byte(), r.string()


def rules_of_files(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, version and rule (JSON) for every rule of every binary rule set under path; files are read in parallel."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                s = read_rule_set(content)
                rules = [json.dumps(x) for x in rule_set_json(s)["rules"]]
                yield pa.record_batch({"path": pa.array([name] * len(rules), pa.string()), "idx": pa.array(range(len(rules)), pa.int32()), "version": pa.array([s.version] * len(rules), pa.int32()), "rule": pa.array(rules, pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, "path string, idx int, version int, rule string")


def categories_of_files(spark: SparkSession, path: str) -> DataFrame:
    """code, type and value for every item of every category file under path."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                rows = list(read_categories(content))
                yield pa.record_batch({"code": pa.array([x[0] for x in rows], pa.string()), "type": pa.array([x[1] for x in rows], pa.int32()), "value": pa.array([x[2] for x in rows], pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, "code string, type int, value string")
