"""Operators beyond the registered queries: traps, lookups, time series, selection, classifiers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowtrail.functions.regex import translate
from flowtrail.functions.scalar import human_bytes, round2, utc_offset_label
from flowtrail.operators import accounting, lookup, selection, sniff, timeseries, usage


def one(df, *cols):
    return df.select(*cols).first()


def test_round2_is_on_the_binary_value(spark):
    xs = [1.005, 1.015, -1.005, 2.675, 0.125, -0.125, 0.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(round2(F.col("x")).alias("v")).collect()]
    want = [math.copysign(math.floor(abs(x) * 100 + 0.5) / 100, x) if x else 0.0 for x in xs]
    assert got == want


def test_regex_end_is_the_end_of_the_text(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",)], "t string")
    assert [r.m for r in df.select(F.regexp("t", F.lit(translate("c$"))).alias("m")).collect()] == [True, False]
    for t, hit in (("$a$", True), ("xa$", False)):
        assert spark.createDataFrame([(t,)], "t string").select(F.regexp("t", F.lit(translate("[$]a\\$"))).alias("m")).first().m == hit


def test_small_helpers(spark):
    df = spark.createDataFrame([(10,), (1536,), (5 << 20,)], "n long")
    assert [r.v for r in df.select(human_bytes(F.col("n")).alias("v")).collect()] == ["10 B", "1.5 KB", "5.0 MB"]
    assert utc_offset_label(-19800) == "UTC-05:30"


def test_disjoint_ranges_and_lookup(spark):
    rng = random.Random(1)
    ranges = []
    for _ in range(80):
        bits = rng.randint(2, 30)
        lo = rng.getrandbits(32) >> (32 - bits) << (32 - bits)
        ranges.append((lo, lo + (1 << 32 - bits) - 1, f"c{len(ranges)}"))
    ranges = list({(lo, hi): (lo, hi, c) for lo, hi, c in ranges}.values())
    points = [rng.getrandbits(32) for _ in range(400)] + [r[0] for r in ranges] + [r[1] for r in ranges] + [0, (1 << 32) - 1]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i long, ip long")
    table = spark.createDataFrame(ranges, "lo long, hi long, code string")
    best = lambda p: min(((hi - lo, c) for lo, hi, c in ranges if lo <= p <= hi), default=(0, "unknown"))[1]
    got = {r.i: r.code for r in lookup.range_lookup(df, lookup.disjoint(table), "ip", "unknown").collect()}
    assert got == {i: best(p) for i, p in enumerate(points)}
    every = {(r.i, r.code) for r in lookup.range_join(df, table, "ip").collect()}
    assert every == {(i, c) for i, p in enumerate(points) for lo, hi, c in ranges if lo <= p <= hi}


def test_plans_have_no_nested_loops(spark):
    df = spark.createDataFrame([(1, 5, "a.b")], "i long, ip long, host string")
    table = spark.createDataFrame([(0, 9, "x")], "lo long, hi long, code string")
    suffixes = spark.createDataFrame([("b", 1)], "suffix string, idx int")
    for d in (lookup.range_join(df, table, "ip"), lookup.range_lookup(df, table, "ip"), lookup.suffix_join(df, suffixes)):
        assert "NestedLoop" not in d._jdf.queryExecution().toString() and "Cartesian" not in d._jdf.queryExecution().toString()


def test_change_events(spark):
    samples = [("a", t, u, d) for t, (u, d) in enumerate([(0, 0), (5, 1), (5, 1), (5, 1), (9, 1), (3, 0), (3, 0), (4, 0)])]
    got = [(r.ts, r.up_delta, r.down_delta) for r in accounting.change_events(spark.createDataFrame(samples, "id string, ts long, upload long, download long")).orderBy("ts").collect()]
    assert got == [(1, 5, 1), (2, 0, 0), (4, 4, 0), (5, 0, 0), (7, 1, 0)]


def brute_gaps(times, gap, ignore):
    out, last = [], None
    for t in sorted(set(times)):
        if last is not None and t - last < ignore:
            continue
        if last is not None and t - last >= gap:
            out.append((t, t - last))
        last = t
    return out


def test_idle_gaps_with_ignored_touches(spark):
    rng, rows = random.Random(3), []
    for key in "abc":
        t = 0
        for _ in range(200):
            t += rng.choice([100, 400, 900, 1000, 3000, 4500, 5000, 5500, 6000, 20_000])
            rows.append((key, t))
    df = spark.createDataFrame(rows, "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    got = sorted((r.key, r.at_ms, r.idle_ms) for r in accounting.idle_gaps(df, "k").collect())
    assert got == sorted((k, *g) for k in "abc" for g in brute_gaps([t for x, t in rows if x == k], 5000, 1000))


def test_lists(spark):
    df = spark.createDataFrame([("a", 1, None, "dns"), ("b", 2, 5, "proxy"), ("c", 3, 4, None)], "id string, created long, closed_at long, outbound_type string")
    assert [r.id for r in accounting.in_state(df, "closed").orderBy("id").collect()] == ["b", "c"]
    assert [r.id for r in accounting.without_dns(df).orderBy("id").collect()] == ["b", "c"]
    assert accounting.listed(df, ("id", "created")).columns == ["id", "created"]
    for bad in (lambda: accounting.listed(df, ("nothing",)), lambda: accounting.top(df, "nothing"), lambda: accounting.in_state(df, "nothing")):
        with pytest.raises(ValueError):
            bad()
    log = spark.createDataFrame([(i, "info" if i % 2 else "warn") for i in range(10)], "seq long, level string")
    assert [r.seq for r in accounting.last_lines(log, 2, "info").collect()] == [9, 7]
    proxies = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "tag string, ordinal int")
    assert [r.tag for r in accounting.default_first(proxies, "y").collect()] == ["y", "x", "z"]


def test_apply_changes_evicts_and_ignores_unknown(spark):
    ev = [("a", 1, "NEW", 0, 1, 1), ("a", 2, "UPDATE", 1, 5, 6), ("a", 3, "CLOSED", 10, 0, 0), ("b", 4, "UPDATE", 0, 9, 9), ("c", 5, "NEW", 0, 0, 0), ("c", 6, "UPDATE", 0, 2, 2), ("c", 7, "NEW", 9, 3, 3)]
    df = spark.createDataFrame(ev, "id string, seq long, type string, ts_ms long, up_delta long, down_delta long")
    got = {r.id: (r.uplink_total, r.uplink, r.closed_ms) for r in accounting.apply_changes(df).collect()}
    assert got == {"a": (6, 0, 10), "c": (3, 0, None)}
    assert {r.id for r in accounting.apply_changes(df, now_ms=10 + 300_001).collect()} == {"c"}


def test_counters_without_tags(spark):
    df = spark.createDataFrame([("in", "u", 1, 2)], "inbound string, auth_user string, upload long, download long")
    assert accounting.counters(df).count() == 0
    named = accounting.counters(df, inbounds=["in"], users=["", "x"])
    assert {(r.name, r.value) for r in named.collect()} == {("inbound>>>in>>>traffic>>>uplink", 1), ("inbound>>>in>>>traffic>>>downlink", 2)}
    assert accounting.query_counters(named, ["^inbound", "link$"], regex=True).count() == 4


def test_total_is_not_the_sum_over_users(spark):
    cells = [("m", 1, 604800, u, 1, 4_000, 0, 0, 0, 0, 0) for u in ("a", "b", "")]
    df = spark.createDataFrame(cells, "model string, context_window int, week_start long, user string, requests long, input_tokens long, output_tokens long, cache_read_tokens long, cache_5m_tokens long, cache_1h_tokens long, cache_total_tokens long")
    price = {"input": 1.0, "output": 1.0, "cache_read": 1.0, "cache_5m": 1.0, "cache_1h": 1.0}
    got = {(r.view, r.user): r.cost for r in usage.summary(df, lambda: usage.cost(usage.price(F.col("model"), [], price))).collect()}
    assert got == {("total", None): 0.01, ("user", "a"): 0.0, ("user", "b"): 0.0, ("week", None): 0.01, ("user_week", "a"): 0.0, ("user_week", "b"): 0.0}


def test_week_start(spark):
    df = spark.createDataFrame([(1_000_000, 60), (None, 60), (1_000_000, 0), (1_000_000, None)], "r long, m long")
    assert [r.w for r in df.select(usage.week_start(F.col("r"), F.col("m")).alias("w")).collect()] == [996_400, 0, 0, 0]


def test_array_means_match_plain_python(spark):
    rng = random.Random(8)
    for n in (1, 5, 19, 20, 41):
        xs = [rng.random() * 100 for _ in range(n)]
        cut = n * 5 // 100
        keep = sorted(xs)[: n - cut] if 0 < cut < n else sorted(xs)
        r = one(spark.createDataFrame([(xs,)], "x array<double>"), timeseries.ordered_mean(timeseries.trimmed(F.col("x"))).alias("m"))
        assert math.isclose(r.m, sum(keep) / len(keep))


def test_responsiveness_without_samples(spark):
    df = spark.createDataFrame([("a", 10.0, 0.0, 20.0, 30.0), ("b", 10.0, 1.0, 1.0, None), ("c", 0.0, 0.0, 0.0, 5.0)], "k string, tcp double, tls double, http_first double, http_loaded double")
    assert {r.k: r.rpm for r in timeseries.responsiveness(df, "k").collect()} == {"a": 3000, "b": 0, "c": 0}


def test_ranks_of_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 9 + ["b", None]), rnd.choice([None, rnd.randrange(40), rnd.randrange(10**6)])) for _ in range(6000)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(8)
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    kept = {k: sorted(v)[: len(v) - len(v) * 5 // 100] for k, v in held.items()}
    got = {r.k: r["mean"] for r in timeseries.upper_trimmed_mean(df, "k", "v").collect()}
    assert got.keys() == kept.keys() and all(math.isclose(got[k], sum(v) / len(v)) for k, v in kept.items())
    assert {r.k: r.median for r in timeseries.upper_median(df, "k", "v").collect()} == {k: sorted(v)[len(v) // 2] for k, v in held.items()}
    assert timeseries.upper_median(df.limit(0), "k", "v").collect() == []


def test_ewma_in_blocks_is_the_recursion(spark):
    rnd = random.Random(5)
    rows = [(k, i, None if rnd.random() < 0.01 else 0.0 if i < zeros or rnd.random() < 0.1 else rnd.uniform(0, 1000)) for k, n, zeros in (("hot", 5000, 0), ("late", 2000, 1100), ("few", 3, 0), (None, 600, 1), ("zero", 520, 520)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(8)
    want = {}
    for k, _, x in rows:
        if x is not None:
            a, n = want.get(k, (0.0, 0))
            want[k] = (x if a == 0 else 0.3 * x + 0.7 * a, n + 1)
    got = {r.k: (r.ewma, r.n) for r in timeseries.ewma(df, "k", ["i"], "x").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == n and math.isclose(got[k][0], a, rel_tol=1e-12) for k, (a, n) in want.items())


def test_moving_stability_passes_over_bad_values(spark):
    xs = [5.0, -1.0, float("nan"), float("inf"), 0.0, 5.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, i long, x double")
    assert [(r.i, r.confidence) for r in timeseries.moving_stability(df, "k", "i", "x").orderBy("i").collect()] == [(0, "low"), (5, "low"), (6, "low"), (7, "high"), (8, "high")]


def test_latency_pick_wraps_and_falls_back(spark):
    member = "array<struct<ordinal:int,tag:string,delay:int,capable:boolean>>"
    groups = [
        ("keep", "b", [(0, "a", 60, True), (1, "b", 100, True)]), ("switch", "b", [(0, "a", 40, True), (1, "b", 100, True)]), ("wrap", "b", [(0, "b", 100, True), (1, "a", 65_500, True)]), ("wrap, then back", "b", [(0, "a", 65_500, True), (1, "b", 100, True)]),
        ("none", None, [(0, "a", None, False), (1, "b", None, True)]), ("order", None, [(0, "a", 100, True), (1, "b", 55, True), (2, "c", 10, True)]), ("empty", None, []),
    ]
    df = spark.createDataFrame(groups, f"group string, current string, members {member}")
    got = {r.group: (r.pick, r.measured) for r in selection.latency_pick(df).collect()}
    assert got == {"keep": ("b", True), "switch": ("a", True), "wrap": ("a", True), "wrap, then back": ("b", True), "none": ("b", False), "order": ("c", True), "empty": (None, False)}


def test_min_ttl_fold(spark):
    rec = "array<struct<type:int,ttl:long,minttl:long>>"
    rows = [([(1, 0, 0), (1, 30, 0)], [], [(41, 5, 0)], 30), ([(1, 30, 0), (1, 0, 0), (1, 20, 0)], [], [], 20), ([], [(6, 100, 60)], [], 60), ([], [(2, 9, 0)], [(1, 4, 0)], 4), ([], [], [], 0)]
    df = spark.createDataFrame(rows, f"a {rec}, n {rec}, e {rec}, want long")
    assert all(r.got == r.want for r in df.select("want", selection.min_ttl(F.col("a"), F.col("n"), F.col("e")).alias("got")).collect())
    r = one(df.limit(1), selection.with_ttl(F.col("e"), F.lit(7)).alias("e"))
    assert r.e[0].ttl == 5


def test_cache_helpers(spark):
    df = spark.createDataFrame([(0, 5, True), (3, 5, True), (2, 5, True), (0, 0, True), (0, 5, False), (None, 5, True)], "rcode int, ttl long, simple boolean")
    assert [r.c for r in df.select(selection.cacheable(F.col("rcode"), F.col("ttl"), F.col("simple")).alias("c")).collect()] == [True, True, False, False, False, False]
    q = spark.createDataFrame([(1, "ipv6_only"), (28, "ipv4_only"), (1, "ipv4_only"), (1, None)], "t int, s string")
    assert [r.c for r in q.select(selection.short_circuit(F.col("t"), F.col("s")).alias("c")).collect()] == [True, True, False, False]


def test_history_and_reverse_map(spark):
    h = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("b", 3, None)], "tag string, t long, delay int").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r.tag, r.delay) for r in selection.latest(h).collect()} == {("a", 20)}
    a = spark.createDataFrame([(1, "x.example", [(1, "1.1.1.1", 60), (16, "t", 1)])], "ts long, qname string, answer array<struct<type:int,rdata:string,ttl:int>>")
    assert [tuple(r) for r in selection.reverse_map(a).collect()] == [("1.1.1.1", 1, "x.example", 60)]


def issued(requests, base, size):
    held, owner, last = {}, {}, base + 1
    for d in requests:
        if d not in held:
            last = base + 2 if last + 1 >= base + size - 1 else last + 1
            held.pop(owner.get(last), None)
            held[d], owner[last] = last, d
    return held


def test_synthetic_addresses_are_issued_again(spark):
    """Random requests of several pools, one of them null, and the same in two parts."""
    import random

    rng = random.Random(2)
    req = [(rng.choice(["p", "q", None]), rng.choice("abcdefghij"), i) for i in range(300)] + [("p", None, 7)]
    df = spark.createDataFrame(req, "pool string, domain string, seq long").repartition(5)
    for size in (4, 6, 13, 100):
        want = {(p, d, a) for p in ("p", "q", None) for d, a in issued([d for x, d, _ in req if x == p and d], 100, size).items()}
        assert {(r.pool, r.domain, r.address) for r in selection.allocated(df, 100, size).collect()} == want
        half = selection.allocated(df.where("seq < 150"), 100, size)
        assert {(r.pool, r.domain, r.address) for r in selection.allocated(df.where("seq >= 150"), 100, size, held=half).collect()} == want
        one_pool = df.where("pool = 'p'").drop("pool")
        assert {r.domain: r.address for r in selection.synthetic_addresses(one_pool.where("domain is not null"), 100, size).collect()} == issued([d for x, d, _ in req if x == "p" and d], 100, size)


PACKETS = [
    ("1b0006" + "00" * 45, "ntp"), ("40" + "00" * 47, None), ("0001000c2112a442" + "00" * 24, "stun"), ("0001000c2112a442" + "00" * 12, None), ("16fefd" + "00" * 10, "dtls"), ("16fefe" + "00" * 10, None),
    ("00000417271019800000000001020304", "bittorrent"), ("4100" + "00" * 18, "bittorrent"), ("4101" + "00" * 18 + "0002aabb", "bittorrent"), ("4101" + "00" * 18 + "05", None), ("5100" + "00" * 18, None),
    ("12340100000100000000000003777777076578616d706c6503636f6d0000010001", "dns"), ("12348100000100000000000003777777076578616d706c6503636f6d0000010001", None), ("", None),
]


def test_packets(spark):
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, (h, _) in enumerate(PACKETS)], "i int, payload binary")
    assert {r.i: r.protocol for r in sniff.classify(df, packet=True).collect()} == {i: p for i, (_, p) in enumerate(PACKETS)}


def client_hello(name: bytes) -> bytes:
    sni = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    extensions = b"\x00\x17\x00\x00" + b"\x00\x0a\x00\x04\x00\x02\x00\x1d" + sni
    body = b"\x03\x03" + bytes(32) + b"\x20" + bytes(32) + b"\x00\x04\x13\x01\x13\x02" + b"\x01\x00" + len(extensions).to_bytes(2, "big") + extensions
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(hello).to_bytes(2, "big") + hello


def test_streams(spark):
    dns = bytes.fromhex("12340100000100000000000003777777076578616d706c6503636f6d0000010001")
    streams = [
        (b"SSH-2.0-dropbear\r\nxyz", ("ssh", None, "dropbear", False)), (b"SSH-2.0", (None, None, None, True)), (b"\x03\x00\x00\x13\x0e\xe0\x00\x00\x00\x00\x00\x01\x00\x08\x00\x03\x00\x00\x00", ("rdp", None, None, False)),
        (b"GET /x HTTP/1.1\r\nA: b\r\nHost: Www.Example.com:8080\r\n\r\n", ("http", "www.example.com", None, False)), (b"\x13BitTorrent protocol0000", ("bittorrent", None, None, False)), (b"\x13BitTor", (None, None, None, True)),
        (len(dns).to_bytes(2, "big") + dns, ("dns", None, None, False)), (len(dns).to_bytes(2, "big") + dns[:20], (None, None, None, True)), (client_hello(b"Sni.Example.org"), ("tls", "sni.example.org", None, False)), (client_hello(b"a.b")[:40], (None, None, None, True)),
    ]
    df = spark.createDataFrame([(i, bytearray(p), 443) for i, (p, _) in enumerate(streams)], "i int, payload binary, port int")
    for r in sniff.classify(df, port="port").collect():
        assert (r.protocol, r.domain, r.client, r.need_more) == streams[r.i][1], r.i
    assert {r.protocol for r in sniff.classify(df.withColumn("port", F.lit(25)), port="port").collect()} == {None}


def test_ja3(spark):
    df = spark.createDataFrame([(771, [2570, 4865], [0, 6682, 11], [29], [0])], "version int, ciphers array<int>, extensions array<int>, groups array<int>, formats array<int>")
    assert one(sniff.ja3(df), "ja3").ja3 == "771,4865,0-11,29,0"
    assert one(sniff.ja3(df, standard=False), "ja3").ja3 == "771,2570,6682,,0"


def test_addresses_after_and_around(spark):
    from ipaddress import ip_address, ip_network

    from flowtrail.functions import net

    texts = ["0.0.0.0", "10.0.255.255", "255.255.255.255", "192.0.2.77", "::", "2001:db8::ffff:ffff", "2001:db8:0:1:ffff:ffff:ffff:ffff", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    key = lambda a: a.packed.hex()
    rows = [(key(ip_address(t)), bits) for t in texts for bits in ((0, 1, 8, 13, 31, 32) if "." in t else (0, 3, 32, 61, 64, 127, 128))]
    df = spark.createDataFrame(rows, "k string, bits int")
    for r in df.select("k", "bits", net.after(F.col("k")).alias("next"), net.last_of(F.col("k"), F.col("bits")).alias("last")).collect():
        a = ip_address(bytes.fromhex(r.k))
        whole = ip_network((a, r.bits), strict=False)
        assert r.next == (None if int(a) == 2**a.max_prefixlen - 1 else key(a + 1))
        assert r.last == key(whole[-1])
        digits = len(r.k)
        assert df.where(F.col("k") == r.k).select(net.first_of(F.col("k"), r.bits, digits).alias("f")).first().f == key(whole[0])


def test_one_counter(spark):
    counted = spark.createDataFrame([("a", 3), ("b", 4)], "name string, value long")
    assert [tuple(r) for r in accounting.one_counter(counted, "b").collect()] == [("b", 4)]
    with pytest.raises(Exception, match="no such counter"):
        accounting.one_counter(counted, "c").collect()
