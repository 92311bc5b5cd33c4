"""Choices and keyed state over recorded histories: latency picks, caches, synthetic addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .slices import chain, running

TOLERANCE_MS = 50
OPT, SOA, A, AAAA = 41, 6, 1, 28


def latest(history: DataFrame, now=None, fresh_s: float | None = None) -> DataFrame:
    """tag and delay of each tag's latest measurement; a failed one (null delay) deletes the history, an old one counts as none."""
    h = history.groupBy("tag").agg(F.max_by("delay", "ts").alias("delay"), F.max("ts").alias("ts")).where(F.col("delay").isNotNull())
    return h if now is None else h.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) < fresh_s)


def latency_pick(groups: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """The member that each group picks: group, pick, measured.

    groups: group, current (null: none), members ARRAY<STRUCT<ordinal, tag, delay (null: none), capable>>.
    Members are gone through in order from the current pick's delay; another takes over only if it is
    better by more than the tolerance. That sum is an unsigned 16-bit number and wraps. Without any
    history the first capable member is picked, unmeasured.
    """
    members = F.sort_array(F.filter("members", lambda m: m["capable"]))
    held = F.get(F.filter(members, lambda m: (m["tag"] == F.col("current")) & m["delay"].isNotNull()), F.lit(0))
    start = F.struct(F.coalesce(held["delay"].cast("int"), F.lit(0)).alias("min"), held["tag"].alias("pick"))

    def step(a: Column, m: Column) -> Column:
        better = m["delay"].isNotNull() & ((a["min"] == 0) | (a["min"] > (m["delay"] + tolerance) % 65536))
        return F.struct(F.when(better, m["delay"].cast("int")).otherwise(a["min"]).alias("min"), F.when(better, m["tag"]).otherwise(a["pick"]).alias("pick"))

    g = groups.select("group", F.aggregate(members, start, step)["pick"].alias("pick"), F.get(members, F.lit(0))["tag"].alias("first"))
    return g.select("group", F.coalesce("pick", "first").alias("pick"), F.col("pick").isNotNull().alias("measured"))


def min_ttl(answer: Column, ns: Column, extra: Column) -> Column:
    """A response's time to live: without answers the smaller of the SOA's TTL and minimum, else the least over all records but OPT.

    A first TTL of 0 is taken and replaced by the next record's, as it would be by a fold from 0.
    """
    soa = F.get(F.filter(ns, lambda r: r["type"] == SOA), F.lit(0))
    every = F.filter(F.concat(answer, ns, extra), lambda r: r["type"] != OPT)
    fold = F.aggregate(F.transform(every, lambda r: r["ttl"].cast("long")), F.lit(0).cast("long"), lambda a, t: F.when((a == 0) | (t > 0) & (t < a), t).otherwise(a))
    return F.when((F.size(answer) == 0) & soa.isNotNull(), F.least(soa["ttl"], soa["minttl"]).cast("long")).otherwise(fold)


def with_ttl(records: Column, ttl: Column) -> Column:
    """Every record but OPT with one TTL."""
    return F.transform(records, lambda r: F.when(r["type"] == OPT, r).otherwise(r.withField("ttl", ttl.cast("int"))))


def freshness(entries: DataFrame, now: Column, optimistic_s: float = 0, disable_expire: bool = False) -> DataFrame:
    """Adds state (hit, stale, expired) and ttl of cache entries with expire_at; a stale answer has TTL 1 while the allowance lasts."""
    left = F.unix_millis(F.col("expire_at").cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    stale = (left < 0) & (left + int(optimistic_s * 1000) > 0)
    state = F.lit("hit") if disable_expire else F.when(left >= 0, "hit").when(stale & F.lit(optimistic_s > 0), "stale").otherwise("expired")
    ttl = F.lit(0) if disable_expire else F.when(left >= 0, F.floor(left / 1000)).when(stale & F.lit(optimistic_s > 0), 1)
    return entries.withColumns({"state": state, "ttl": ttl.cast("long")})


def cacheable(rcode: Column, ttl: Column, simple: Column) -> Column:
    """Simple requests that ended in no error or no such name, with a TTL."""
    return F.coalesce(rcode.isin(0, 3) & simple & (ttl > 0), F.lit(False))


def short_circuit(qtype: Column, strategy: Column) -> Column:
    """Whether an address query gets an empty success because the strategy wants the other family only."""
    return F.coalesce((qtype == A) & (strategy == "ipv6_only") | (qtype == AAAA) & (strategy == "ipv4_only"), F.lit(False))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def swept(entries: DataFrame, now: Column, allowance_s: float = 0) -> DataFrame:
    """Entries that an expiry sweep leaves."""
    return entries.where(F.unix_millis(now.cast("timestamp")) <= F.unix_millis(F.col("expire_at").cast("timestamp")) + int(allowance_s * 1000))


def address_order(addresses: Column, prefer_v6: bool = False) -> Column:
    """IPv4 keys first, or IPv6 first, each family in its order."""
    four, six = F.filter(addresses, lambda a: F.length(a) == 8), F.filter(addresses, lambda a: F.length(a) == 32)
    return F.concat(six, four) if prefer_v6 else F.concat(four, six)


def reverse_map(answers: DataFrame) -> DataFrame:
    """address, ts, value (the question's name) and ttl_s from answers (qname, ts, answer records): A and AAAA only."""
    return answers.select("ts", F.col("qname").alias("value"), F.explode("answer").alias("r")).where(F.col("r.type").isin(A, AAAA)).select(F.col("r.rdata").alias("address"), "ts", "value", F.col("r.ttl").alias("ttl_s"))


def synthetic_addresses(requests: DataFrame, base: int, size: int) -> DataFrame:
    """domain and the address it holds in the end, from requests (domain, seq), in a range of `size` from base.

    Addresses are issued in order of first request from base + 2; the broadcast address is skipped. Up
    to size - 3 domains the n-th gets the n-th address. Beyond that addresses are issued again and their
    old domains lose them, which only the order of all requests can tell: allocated() then passes over them.
    """
    first = requests.groupBy("domain").agg(F.min("seq").alias("first"))
    if first.limit(size - 2).count() > size - 3:
        return allocated(requests.select(F.lit(0).alias("pool"), "domain", "seq"), base, size).select("domain", "address")
    parts = first.withColumn("part", F.floor(F.col("first") / 100_000))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.row_number().over(Window.partitionBy("part").orderBy("first", "domain"))
    return parts.withColumn("k", k).join(counts, "part").select("domain", (F.lit(base + 1).cast("long") + F.col("before") + F.col("k")).alias("address"))


def allocated(requests: DataFrame, base: int, size: int, key: str = "pool", held: DataFrame | None = None) -> DataFrame:
    """pool, domain, address and turn after requests (pool, domain, seq), the range of each pool being issued over and over.

    A domain that has an address keeps it; the next address in turn is taken from whoever has it. turn: how many
    addresses were issued before this one, so the newest has the highest. held: an earlier result, from which the pool goes on:
    requests that are passed in two parts end as if passed at once. Ties in seq go by domain.

    One ordered pass over a pool's requests, which come in batches: a task holds the size - 3 addresses of
    a pool and one batch. Pools are dealt out; requests of one pool depend on each other in their order.
    """
    ring, kind = size - 3, requests.schema[key].dataType.simpleString()

    def out(pool, last: int, owner: dict[int, str]) -> pa.RecordBatch:
        turns = sorted(last - (last - slot) % ring for slot in owner)
        return pa.record_batch([pa.array([pool] * len(turns), kinds), pa.array([owner[t % ring] for t in turns]), pa.array([base + 2 + t % ring for t in turns], pa.int64()), pa.array(turns, pa.int64())], names=[key, "domain", "address", "turn"])

    kinds = to_arrow_type(requests.schema[key].dataType)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, owner, slot_of = object(), -1, {}, {}
        for batch in batches:
            for pool, domain, turn in zip(*(batch[c].to_pylist() for c in (key, "domain", "turn"))):
                if pool != now:
                    if owner:
                        yield out(now, last, owner)
                    now, last, owner, slot_of = pool, -1, {}, {}
                if turn is None and domain in slot_of:
                    continue
                last = last + 1 if turn is None else turn
                slot = last % ring
                slot_of.pop(owner.get(slot), None)
                owner[slot], slot_of[domain] = domain, slot
        if owner:
            yield out(now, last, owner)

    rows = requests.where("domain is not null").select(key, "domain", "seq", F.lit(None).cast("long").alias("turn"))
    if held is not None:
        rows = rows.unionByName(held.select(key, "domain", F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), "turn"))
    ordered = rows.repartition(key).sortWithinPartitions(F.col(key), F.asc_nulls_last("turn"), "seq", "domain")
    return ordered.mapInArrow(go_on, f"{key} {kind}, domain string, address long, turn long")


def coalesced(requests: DataFrame) -> DataFrame:
    """requests (key, id, at_ms, took_ms) with leader: the request whose exchange answers this one, itself if it starts one.

    The first request for a key starts an exchange; those that come before it ended wait for it and start none, and
    the next one starts again: a chain of leaders (operators/slices.py). Of requests at one time the one with
    the smallest id is first. An exchange takes 1 ms at least.
    """
    first = requests.groupBy("key", "at_ms").agg(F.min(F.struct("id", F.greatest("took_ms", F.lit(1)).alias("took"))).alias("f"))
    on = chain(first.withColumn("until", F.col("at_ms") + F.col("f.took")), "key", "at_ms", "until")
    moments = on.select("key", "at_ms", F.struct(F.coalesce("key", F.lit("0").cast(on.schema["key"].dataType)).alias("of"), F.col("key").isNull().alias("none")).alias("k"), F.when(F.col("counts"), F.col("f.id")).alias("leads"))
    led = running(moments, ["k"], "at_ms", [], "leads", "leader").select("k", F.col("at_ms").alias("_at"), "leader")
    k = F.struct(F.coalesce("key", F.lit("0").cast(requests.schema["key"].dataType)).alias("of"), F.col("key").isNull().alias("none"))
    return requests.withColumn("k", k).join(led.withColumnRenamed("_at", "at_ms"), ["k", "at_ms"]).select(*requests.columns, "leader")
