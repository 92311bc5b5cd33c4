"""Lookups as joins: suffixes, address ranges, time-valid mappings, chains of names."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from ipaddress import ip_address, summarize_address_range

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from ..session import BROADCAST_ROWS, small, written
from .patterns import matches, quoted
from .slices import running

def label_suffixes(host: Column) -> Column:
    """`a.b.c` as [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suffix_join(df: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """df joined to suffixes (suffix, and its own columns): every suffix that the host has, at label bounds.

    `x` matches x and its subdomains, `.x` only subdomains. A host is exploded into its few label
    suffixes, which are looked up by equality: the cost doesn't grow with the number of suffixes.
    """
    dotted = F.startswith("suffix", F.lit("."))
    table = suffixes.withColumns({"_key": F.lower(F.when(dotted, F.substring("suffix", 2, 1 << 30)).otherwise(F.col("suffix"))), "_sub": dotted})
    keys = df.where(F.col(host) != "").select("*", F.posexplode(label_suffixes(F.lower(F.col(host)))).alias("_at", "_key"))
    return keys.join(small(table), "_key").where(~F.col("_sub") | (F.col("_at") > 0)).drop("_key", "_at", "_sub")


def first_suffix(df: DataFrame, suffixes: DataFrame, row_id: str, host: str = "host") -> DataFrame:
    """row_id and the least idx of its suffixes."""
    return suffix_join(df.select(row_id, host), suffixes, host).groupBy(row_id).agg(F.min("idx").alias("idx"))


def disjoint(ranges: DataFrame) -> DataFrame:
    """Ranges (lo, hi, code) of IPv4 prefixes, nested or not, as disjoint ranges in which the narrowest prefix holds.

    A table of up to BROADCAST_ROWS ranges, which is counted, is swept on the driver; a larger one by joins.
    """
    some = ranges.select("lo", "hi", "code").limit(BROADCAST_ROWS + 1).collect()
    if len(some) <= BROADCAST_ROWS:
        return ranges.sparkSession.createDataFrame(_swept(some), ranges.select("lo", "hi", "code").schema)
    points = ranges.select(F.col("lo").alias("p")).unionByName(ranges.select((F.col("hi") + 1).alias("p"))).distinct()
    keyed = _level(points.withColumn("_x", F.col("p")), "_x")
    owner = keyed.join(_buckets(ranges), ["level", "bucket"]).where(F.col("p").between(F.col("lo"), F.col("hi"))).groupBy("p").agg(F.min_by("code", F.struct(F.col("hi") - F.col("lo"), "code")).alias("code"))
    # The end of each piece is the next point; points and pieces are dealt by their upper bits.
    return _with_next(points).join(owner, "p").select(F.col("p").alias("lo"), (F.col("next") - 1).alias("hi"), "code")


def _swept(ranges) -> list[tuple]:
    """disjoint() in one pass over the ranges' ends; the heap's top is the narrowest range that is still open."""
    starts, points, k, held, out = sorted(ranges, key=lambda r: r.lo), sorted({r.lo for r in ranges} | {r.hi + 1 for r in ranges}), 0, [], []
    for at, nxt in zip(points, points[1:]):
        while k < len(starts) and starts[k].lo <= at:
            heapq.heappush(held, (starts[k].hi - starts[k].lo, starts[k].code, starts[k].hi))
            k += 1
        while held and held[0][2] < at:
            heapq.heappop(held)
        if held:
            out.append((at, nxt - 1, held[0][1]))
    return out


def _with_next(points: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.shiftright("p", 20)).orderBy("p")
    firsts = points.groupBy(F.shiftright("p", 20).alias("part")).agg(F.min("p").alias("first"))
    after = firsts.withColumn("following", F.lead("first").over(Window.orderBy("part"))).select("part", "following")  # at most 4,096 rows
    return points.withColumns({"part": F.shiftright("p", 20), "_n": F.lead("p").over(w)}).join(F.broadcast(after), "part").select("p", F.coalesce("_n", "following", F.lit(1 << 32)).alias("next"))


def _level(df: DataFrame, x: str) -> DataFrame:
    return df.select("*", F.explode(F.array(F.struct(F.lit(16).alias("level"), F.shiftright(x, 16).alias("bucket")), F.struct(F.lit(24).alias("level"), F.shiftright(x, 24).alias("bucket")))).alias("_b")).select(*df.columns, "_b.*")


def _buckets(ranges: DataFrame) -> DataFrame:
    """A row for each bucket that a range touches: of 2^16 addresses, or of 2^24 where that were over 256."""
    level = F.when(F.shiftright("hi", 16) - F.shiftright("lo", 16) < 256, 16).otherwise(24)
    r = ranges.withColumn("level", level)
    return r.select("*", F.explode(F.when(F.col("level") == 16, F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).otherwise(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24)))).alias("bucket"))


def range_lookup(df: DataFrame, ranges: DataFrame, address: str, default: str | None = None) -> DataFrame:
    """df with code of the range (disjoint; lo, hi, code) that holds its IPv4 address; `default` if none does.

    Two equi-joins on the address's upper bits, each with a range condition, in place of a nested loop.
    """
    b, out, codes = _buckets(ranges), df, []
    for level in (16, 24):
        part = small(b.where(F.col("level") == level).select(F.col("bucket").alias(f"_b{level}"), F.col("lo").alias(f"_lo{level}"), F.col("hi").alias(f"_hi{level}"), F.col("code").alias(f"_c{level}")))
        on = (F.shiftright(out[address], level) == part[f"_b{level}"]) & out[address].between(part[f"_lo{level}"], part[f"_hi{level}"])
        out = out.join(part, on, "left")
        codes.append(F.col(f"_c{level}"))
    return out.select(*df.columns, F.coalesce(*codes, F.lit(default)).alias("code"))


def range_join(df: DataFrame, ranges: DataFrame, address: str) -> DataFrame:
    """Every (row, range) with the IPv4 address in [lo, hi]; ranges may overlap."""
    keyed = _level(df, address)
    return keyed.join(small(_buckets(ranges)), ["level", "bucket"]).where(F.col(address).between(F.col("lo"), F.col("hi"))).drop("level", "bucket")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes that make up each range, as family and length, and the bits that they fix."""
    for batch in batches:
        rows, prefixes = [], []
        for i, (lo, hi) in enumerate(zip(batch["lo"].to_pylist(), batch["hi"].to_pylist())):
            if lo is None or hi is None or len(lo) != len(hi) or lo > hi:
                continue  # no address is in it
            first, last = (ip_address(bytes.fromhex(x)) for x in (lo, hi))
            for n in summarize_address_range(first, last):
                rows.append(i)
                prefixes.append(f"{n.version}:{n.prefixlen}:{n.network_address.packed.hex()}")
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(prefixes, pa.string())], [*batch.schema.names, "_prefix"])


def key_range_join(df: DataFrame, ranges: DataFrame, address: str) -> DataFrame:
    """Every (row, range) with the address's key (functions/net.py: IPv4 and IPv6) in [lo, hi] of its family.

    A range is cut into the few prefixes that make it up, and an address is in one of them if its first bits are the
    prefix's: it asks for one prefix of each length that the table has. So this is an equi-join, no bucket is
    shared by ranges that are apart, and a row meets a range once.
    """
    cut = written(ranges.mapInArrow(_prefixes, T.StructType(ranges.schema.fields + [T.StructField("_prefix", T.StringType())])), "range-prefixes")
    lengths = [r.n for r in cut.select(F.substring_index("_prefix", ":", 2).alias("n")).distinct().collect()]  # 33 and 129 at most

    def asked(length: str) -> Column:
        family, bits = map(int, length.split(":"))
        digits = 8 if family == 4 else 32
        return F.when(F.length(address) == digits, F.concat(F.lit(f"{length}:"), net.first_of(F.col(address), bits, digits)))

    keyed = df.where(F.col(address).isNotNull()).select("*", F.explode(F.array_compact(F.array(*map(asked, sorted(lengths)))) if lengths else F.array().cast("array<string>")).alias("_prefix"))
    return keyed.join(small(cut), "_prefix").drop("_prefix")


def country_of(df: DataFrame, ranges: DataFrame, row_id: str, address: str, default: str = "unknown") -> DataFrame:
    """row_id and code of the narrowest prefix (lo, hi keys, code) that holds the address of either family; `default` if none does."""
    hits = key_range_join(df.select(row_id, address), ranges, address)
    # Of prefixes around one address the narrowest begins last; of those that begin together it is the first to end.
    best = hits.groupBy(row_id).agg(F.max_by("code", F.struct("lo", F.translate("hi", "0123456789abcdef", "fedcba9876543210").alias("end"), "code")).alias("code"))
    return df.select(row_id).join(best, row_id, "left").select(row_id, F.coalesce("code", F.lit(default)).alias("code"))


def networks_by_country(networks: DataFrame) -> DataFrame:
    """code and its prefixes, sorted, as a rule of a rule set has them (prefix, code)."""
    return networks.groupBy("code").agg(F.sort_array(F.collect_set("prefix")).alias("ip_cidr"))


def asof_join(df: DataFrame, mapping: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """df with value: the latest mapping (key, at, value, ttl_s) of its key at or before its time, null once that has expired.

    Mappings and rows are ordered together in slices of time, and the last mapping seen is carried on, also
    over the bounds of slices (operators/slices.py), so a key with very many rows is in many tasks. Of mappings at one
    time the largest value counts. Rows without a key or a time pass by: they have no value.
    """
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    rows = df.where(known).select(F.col(key).alias("_k"), time(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(mapping.schema["value"].dataType).alias("_v"), F.struct(*df.columns).alias("_row"))
    maps = mapping.where(known).select(F.col(key).alias("_k"), time(at).alias("_t"), F.lit(0).alias("_side"), F.col("value").alias("_v"), F.struct(time(at).alias("since"), "value", "ttl_s").alias("_map"))
    both = running(maps.unionByName(rows, allowMissingColumns=True), ["_k"], "_t", ["_side", "_v"], "_map", "_last").where("_side = 1")
    alive = F.col("_t") < F.col("_last.since") + F.col("_last.ttl_s").cast("long") * 1_000_000
    found = both.select("_row.*", F.when(alive, F.col("_last.value")).alias("value"))
    return found.unionByName(df.where(~known).withColumn("value", F.lit(None).cast(mapping.schema["value"].dataType)))


def resolve_chain(groups: DataFrame) -> DataFrame:
    """tag, leaf, chain (the tags passed, from tag to leaf) and cycle for every group (tag, now; tag unique).

    Each step doubles the distance. A path to a leaf has a group at every distance below its own, so once a step
    brings no further group to its leaf, what still stands on a group leads into a cycle and has neither leaf nor chain.
    Chains are put together for the other groups only, so none is longer than what is returned. Each step is a
    written table, so the plan stays as long as one step.
    """
    tags = groups.select(F.col("tag").alias("now"), F.lit(True).alias("_open"))
    cur = written(groups.select("tag", "now").join(small(tags), "now", "left").select("tag", F.col("now").alias("leaf"), F.coalesce("_open", F.lit(False)).alias("open")), "leaf")
    start, n, before = cur, cur.where("open").count(), None
    while n and n != before:
        cur = _further(cur, [])
        before, n = n, cur.where("open").count()
    none = F.lit(None)
    cycles = cur.where("open").select("tag", none.cast(start.schema["leaf"].dataType).alias("leaf"), none.cast(T.ArrayType(start.schema["leaf"].dataType)).alias("chain"), F.lit(True).alias("cycle"))
    cur = start.join(cur.where("not open").select("tag"), "tag", "left_semi").withColumn("chain", F.array("tag", "leaf"))
    while cur.where("open").limit(1).count():
        cur = _further(cur, ["chain"])
    return cur.select("tag", "leaf", "chain", F.lit(False).alias("cycle")).unionByName(cycles)


def _further(cur: DataFrame, chain: list[str]) -> DataFrame:
    """cur (tag, leaf, open, and chain if it is named) with the open rows at the leaf of their leaf; chains are too wide to be broadcast by their number of rows."""
    nxt = cur.select(F.col("tag").alias("leaf"), F.col("leaf").alias("_leaf"), F.col("open").alias("_open"), *[F.slice("chain", 2, 1 << 30).alias("_chain") for _ in chain])
    moved = cur.where("open").drop("open").join(nxt if chain else small(nxt), "leaf")
    moved = moved.select("tag", F.col("_leaf").alias("leaf"), F.col("_open").alias("open"), *[F.concat("chain", "_chain").alias("chain") for _ in chain])
    return written(cur.where("not open").unionByName(moved), "chain")


def hosts_lookup(df: DataFrame, hosts: DataFrame, name: str = "host") -> DataFrame:
    """df with addresses from hosts (source_idx, name, address, line): those of the first source that has the name, in order of line."""
    per = hosts.groupBy(F.lower("name").alias("_n"), "source_idx").agg(F.sort_array(F.collect_list(F.struct("line", "address"))).alias("a"))
    best = per.groupBy("_n").agg(F.min_by("a", "source_idx").alias("a")).select("_n", F.transform("a", lambda x: x["address"]).alias("addresses"))
    return df.join(small(best), F.lower(df[name]) == best["_n"], "left").drop("_n")


#: Kinds of category items, in order of lookup.
DOMAIN, SUFFIX, KEYWORD, REGEX = range(4)


def category_lookup(hosts: DataFrame, items: DataFrame) -> DataFrame:
    """host, code and type: for each category the first kind of item that the host has; hosts are distinct.

    items: code, type, value. A suffix is a plain string suffix here. Domains and suffixes are looked up
    by equality, keywords and patterns by the trigrams that they need. A pattern without a meaning is
    passed over.
    """
    h = hosts.select("host").where("host <> ''").distinct()
    longest = h.agg(F.max(F.length("host"))).first()[0] or 0
    lengths = [r.n for r in items.where(F.col("type") == SUFFIX).select(F.length("value").alias("n")).where(F.col("n") <= longest).distinct().collect()]
    exact = h.join(small(items.where(F.col("type") == DOMAIN)), F.col("host") == F.col("value")).select("host", "code", "type")
    tails = h.select("host", F.explode(F.array(*[F.when(F.length("host") >= n, F.substring("host", -n, n)) for n in sorted(lengths)] or [F.lit(None).cast("string")])).alias("tail"))
    suffix = tails.join(small(items.where(F.col("type") == SUFFIX)), F.col("tail") == F.col("value")).select("host", "code", "type")
    searched = items.where(F.col("type") >= KEYWORD).select(F.when(F.col("type") == KEYWORD, quoted(F.col("value"))).otherwise(F.col("value")).alias("pattern"), "code", "type")
    return exact.unionByName(suffix).unionByName(matches(h, searched)).groupBy("host", "code").agg(F.min("type").alias("type"))


def category_counts(items: DataFrame) -> DataFrame:
    """Items of each category, ascending, ties by code."""
    return items.groupBy("code").agg(F.count("*").alias("n")).orderBy("n", "code")


def category_rule(items: DataFrame) -> DataFrame:
    """The four value lists of each category, as a rule has them."""
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("value"))))
    return items.groupBy("code").agg(of(DOMAIN).alias("domain"), of(SUFFIX).alias("domain_suffix"), of(KEYWORD).alias("domain_keyword"), of(REGEX).alias("domain_regex"))
