"""Running values in slices of time and greedy chains, against plain loops; a key with a third of the rows is in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from flowtrail.operators import accounting, lookup, selection, slices


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "b", "c"]), rng.choice([rng.randint(0, 60), rng.randint(0, 3000)]), rng.choice([None, rng.randint(0, 9)])) for i in range(n)]


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("itself", [False, True])
def test_running(spark, largest, itself):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "i long, k string, t long, v long").repartition(3)
    want, seen = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before = seen.get(k)
        if v is not None:
            seen[k] = max(v, before if before is not None else v) if largest else v
        want[i] = seen.get(k) if itself else before
    got = slices.running(df, ["k"], "t", ["i"], "v", "out", largest=largest, itself=itself)
    assert {r.i: r.out for r in got.collect()} == want
    assert slices.running(df.where("false"), ["k"], "t", ["i"], "v", "out").count() == 0


def test_a_hot_key_is_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    sliced = df.groupBy(slices._sliced(df, "t")).count().collect()
    assert len(sliced) > 50 and max(r["count"] for r in sliced) < 800


def on_chain(rows):
    """rows: (key, at, until)."""
    out = set()
    for key in {r[0] for r in rows}:
        reached = None
        for _, at, until in sorted(r for r in rows if r[0] == key):
            if reached is None or at >= reached:
                out.add((key, at))
                reached = until
    return out


@pytest.mark.parametrize("longest", [2, 40, 500])
def test_chain(spark, longest):
    rng = random.Random(longest)
    made = {(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 1500)) for _ in range(500)}
    rows = [(k, at, at + rng.randint(1, longest)) for k, at in made]
    plain = [(k or "", at, until) for k, at, until in rows]
    got = slices.chain(spark.createDataFrame(rows, "k string, at long, until long"), "k", "at", "until")
    assert {(r.k or "", r.at) for r in got.where("counts").collect()} == on_chain(plain)
    assert got.count() == len(rows)
    assert slices.chain(got.drop("counts").where("false"), "k", "at", "until").count() == 0


def test_idle_gaps(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([rng.randint(0, 100), rng.randint(0, 5000)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    for gap, ignore in ((0.02, 0.01), (0.005, 0.03), (0.03, 0)):
        want = []
        for key in {k for k, _ in rows}:
            last = None
            for ms in sorted({ms for k, ms in rows if k == key}):
                if last is not None and ms - last < ignore * 1000:
                    continue
                if last is not None and ms - last >= gap * 1000:
                    want.append((key, ms, ms - last))
                last = ms
        got = accounting.idle_gaps(df, "k", gap_s=gap, ignore_s=ignore).collect()
        assert sorted(map(str, ((r.key, r.at_ms, r.idle_ms) for r in got))) == sorted(map(str, want))


def test_coalesced_requests(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["q", "q", "r", None]), i, rng.randint(0, 600), rng.choice([0, 5, 40])) for i in range(300)]
    want = {}
    for key in {r[0] for r in rows}:
        leader, busy = None, -1
        for _, i, at, took in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if at >= busy:
                leader, busy = i, at + max(took, 1)
            want[i] = leader
    got = selection.coalesced(spark.createDataFrame(rows, "key string, id long, at_ms long, took_ms long")).collect()
    assert {r.id: r.leader for r in got} == want and len(got) == len(rows)


def test_asof_join_with_keys_and_times_that_are_null(spark):
    rng = random.Random(8)
    maps = [(rng.choice(["hot", "x", None]), rng.randint(0, 900), f"v{rng.randint(0, 5)}", rng.choice([1, 50, 1000, None])) for _ in range(200)]
    rows = [(i, rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, rng.randint(0, 1000)])) for i in range(300)]
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("ts"))
    got = lookup.asof_join(at(spark.createDataFrame(rows, "i long, k string, ts long")), at(spark.createDataFrame(maps, "k string, ts long, value string, ttl_s long")), "k").collect()
    want = {}
    for i, k, t in rows:
        seen = [(s, v, ttl) for q, s, v, ttl in maps if q == k and k is not None and t is not None and s <= t]
        top = max(seen, key=lambda x: x[:2], default=None)
        ties = {ttl for s, v, ttl in seen if (s, v) == top[:2]} if top else set()
        want[i] = {top[1] if ttl is not None and t < top[0] + ttl else None for ttl in ties} or {None}
    assert len(got) == len(rows) and all(r.value in want[r.i] for r in got)


def test_ranges_of_any_shape(spark):
    """Ranges whose ends share no digit, single addresses, whole families, and ranges that are none."""
    rng = random.Random(3)
    key = lambda n, digits=8: f"{n:0{digits}x}"
    ranges = [(key(0x0AFF0000), key(0x0B00FFFF), "a"), (key(0), key(0xFFFFFFFF), "all"), (key(5), key(5), "one"), (key(9), key(3), "none"), (None, key(3), "none"), (key(0x20010DB8 << 96, 32), key((0x20010DB9 << 96) + 7, 32), "six"), (key(1), key(1, 32), "none")]
    for k in range(40):
        lo = rng.randrange(1 << 32)
        ranges.append((key(lo), key(min(lo + rng.randrange(1 << rng.randrange(1, 32)), (1 << 32) - 1)), f"r{k}"))
    rows = [key(rng.randrange(1 << 32)) for _ in range(300)] + [r[i] for r in ranges for i in (0, 1) if r[i]] + [key((0x20010DB8 << 96) + rng.randrange(1 << 97), 32) for _ in range(20)] + [None]
    got = lookup.key_range_join(spark.createDataFrame(list(enumerate(rows)), "i int, ip string"), spark.createDataFrame(ranges, "lo string, hi string, code string"), "ip").collect()
    want = {(i, c) for i, ip in enumerate(rows) for lo, hi, c in ranges if ip and lo and len(ip) == len(lo) == len(hi) and lo <= ip <= hi}
    assert {(r.i, r.code) for r in got} == want and len(got) == len(want)
    assert lookup.key_range_join(spark.createDataFrame([("00000001",)], "ip string"), spark.createDataFrame([], "lo string, hi string, code string"), "ip").count() == 0
