"""Operators over documents, each held against a brute-force version on rows with every edge case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from flowtrail.llm import bpe, exact, licenses, linking, mixing, quality, shards, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# Quality


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + o for places in at.values() if len(places) > 1 for i in places for o in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_quality_ledger(request, rows, table):
    ledger = quality.ledger(request.getfixturevalue(table))
    got = ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines").collect()
    same(got, [(r[0], *measured(r[1])) for r in rows])
    for r in quality.apply_policy(ledger, "v1").collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.n_symbols <= r.n_words)


def test_quality_ablation_and_keep(docs, none, clashing):
    ledger = quality.ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    mask = quality.mask("v2")
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(ledger, "v2").collect()}
    for k, (name, _) in enumerate(quality.RULES):
        assert got[name] == (sum(b >> k & 1 for b in bits), sum(b & mask == 1 << k for b in bits))
    kept = quality.keep(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(b & mask == 0 for b in bits)
    assert quality.ledger(none).count() == quality.keep(none).count() == 0


def test_stored_ledger_answers_policies(docs, monkeypatch):
    import uuid

    ledger = quality.store(quality.ledger(docs), uuid.uuid4().hex)
    for policy in quality.POLICIES:
        same([(r.doc_id, r.kept, r.policy) for r in quality.apply_policy(ledger, policy).collect()], [(r.doc_id, r.kept, policy) for r in quality.apply_policy(quality.ledger(docs), policy).collect()])
    monkeypatch.setattr(quality, "RULES", (*quality.RULES, ("new", lambda m: m("n_words") > 5)))
    monkeypatch.setitem(quality.POLICIES, "v3", ("new",))
    with pytest.raises(Exception, match="older than policy v3"):
        quality.apply_policy(ledger, "v3").collect()


# Exact


def test_exact_verdicts(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact.verdicts(docs).collect()
    same([(r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got], [(r[0], keep[lower(r[1])], len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows])
    assert sum(r.kept for r in got) == len(groups)
    assert exact.verdicts(none).count() == 0


def test_exact_keeps_one_row_of_each_text(clashing, rows):
    out = exact.distinct_texts(clashing)
    assert out.columns == clashing.columns
    assert Counter(lower(r.text) for r in out.collect()) == Counter({lower(r[1]): 1 for r in rows})


def test_exact_verdicts_of_string_ids_and_clashing_names(clashing, rows):
    name = lambda i: None if i is None else f"d{i}"
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(name(r[0]))
    got = exact.verdicts(clashing.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))).collect()
    same([(r.doc_id, r.keep_id, r.group_size) for r in got], [(name(r[0]), max((i for i in groups[lower(r[1])] if i), default=None), len(groups[lower(r[1])])) for r in rows])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_ids_above_doubles(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a"), (big - 1, "A"), (None, "a")], "doc_id long, text string")
    assert {(r.keep_id, r.group_size) for r in exact.verdicts(df).collect()} == {(big, 3)}


def test_exact_keeps_the_text_where_it_is(spark, clashing, monkeypatch):
    """Broadcast or not, and with names of the helper columns of a run before, one row of each text stays."""
    from flowtrail.llm import common

    want = exact.distinct_texts(clashing).count()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert exact.distinct_texts(clashing).count() == want


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, keys = exact.DigestIndex(), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.add(k, i, i, 1)
        index.add(k, i + 10_000, i, 2)
    assert index.resizes > 0 and len(index.content) == 5000 and not index.stash
    assert all(index.find(k) == [i + 10_000, i, 3] for i, k in enumerate(keys))
    for k in keys[:2500]:
        assert index.remove(k, None, 3)
    assert not index.remove(keys[0], None)
    assert all(index.find(k) is None for k in keys[:2500]) and all(index.find(k) for k in keys[2500:])
    assert index.false_hits < 50


@pytest.mark.parametrize("n", [6, 40])
def test_cuckoo_index_with_colliding_keys_and_fingerprints(n):
    """One fingerprint, one pair of bins: more keys than the bins hold are stashed, and all can go again."""
    index = exact.DigestIndex()
    keys = [b"\x01\x02" + b"\x00" * 6 + bytes([i]) * 24 for i in range(n)]
    for i, k in enumerate(keys):
        index.add(k, i, i, 1)
    assert len(index.content) == n and index.false_hits >= 5 and len(index.stash) == max(0, n - 8) and index.resizes < 9
    assert index.find(b"\x01\x02" + b"\x00" * 6 + b"\xff" * 24) is None
    for k in keys[::2]:
        assert index.remove(k, None)
    assert [index.find(k) is not None for k in keys] == [i % 2 == 1 for i in range(n)]


def test_index_changes(spark, docs):
    rows = exact.table(exact.keyed(docs).where("doc_id is not null"), "t")
    content = exact.build(rows, 80)
    gone = rows.where("doc_id in (6, 79, 3)")
    left = rows.where("doc_id not in (6, 79, 3)")
    new = spark.createDataFrame([(100, "one")], "doc_id long, text string")
    added = exact.keyed(new)
    after = exact.change(content, 1, added, gone, left.unionByName(added))
    want = left.unionByName(added).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    pick = lambda d: sorted((bytes(r.digest), r.keep_id, r.group_size) for r in d.collect())
    assert pick(after) == pick(want)
    ids = spark.createDataFrame([(6,), (79,), (3,), (None,)], "doc_id long")
    assert pick(exact.changed_groups(docs.where("doc_id is not null").select("doc_id", "text"), new, ids)) == pick(want)


# SimHash


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_roots(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_groups(docs, rows, none):
    fps = [fingerprint(r[1]) for r in rows]
    roots = component_roots(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], r[0]), r[0])
    got = simhash.groups(docs).collect()
    same([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got], [(r[0], f, least.get(roots[f])) for r, f in zip(rows, fps)])
    assert simhash.groups(none).count() == 0


def test_simhash_links_lose_nothing(spark):
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps |= {0, (1 << 64) - 1, 1, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for wide in (False, True):
        got = [(r.a, r.b) for r in simhash.links(df, wide).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    roots = component_roots(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    want_groups = {g for g in groups({signed(k): v for k, v in roots.items()}) if len(g) > 1}
    for wide in (False, True):
        for got in ({r.node: r.root for r in linking.components(simhash.links(df, wide)).collect()}, {r.node: r.root for r in simhash.connected(df, wide).collect()}):
            assert groups(got) == want_groups
            assert all(min(g) == got[min(g)] for g in want_groups)


def test_dense_groups_link_without_all_pairs(spark):
    """A centre and over 400 fingerprints near it: a small part of all linking pairs is ever made."""
    import itertools

    base = 0x1234_5678_9ABC_DEF0
    fps = [base, *(base ^ 1 << i for i in range(63)), *(base ^ 1 << i ^ 1 << j for i, j in itertools.islice(itertools.combinations(range(63), 2), 400))]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    made = []
    index = simhash._stored(df, simhash._exact, False)
    fits = lambda x, y: simhash._near(x("fp"), y("fp"), x("start"))

    def links(pairs):
        made.append(pairs.count())
        return pairs

    got = {r.node: r.root for r in linking.linked(index, ["start", "key"], "fp", ["fp"], fits, links).collect()}
    assert set(got) == set(fps) and set(got.values()) == {min(fps)}
    assert sum(made) < simhash.links(df).count() / 5


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_simhash_groups_of_string_ids_and_clashing_names(clashing, rows):
    fps = [fingerprint(r[1]) for r in rows]
    roots, least = component_roots(set(fps)), {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], f"d{r[0]}"), f"d{r[0]}")
    got = simhash.groups(clashing.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))).collect()
    same([(r.doc_id, r.component_id) for r in got], [(r[0] if r[0] is None else f"d{r[0]}", least.get(roots[f])) for r, f in zip(rows, fps)])


# Mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        capped |= over


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_mixing(request, rows, none, table):
    docs = request.getfixturevalue(table)
    mix = mixing.curriculum(docs).withColumn("taken", mixing.taken()).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = brute_targets(dict(sizes))
    taken = Counter()
    for r in mix:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size and len(r.passes) <= 2 and all(0 <= p.time <= 1 and 0 < p.words <= r.size for p in r.passes)
    assert all(taken[s] == math.floor(goal[s] + 1e-9) for s in sizes)
    same([(r.doc_id, r.size) for r in mix], [(r[0], len(WORD.findall(r[1] or ""))) for r in rows])
    again = mixing.curriculum(docs.repartition(7)).withColumn("taken", mixing.taken()).collect()
    same([(r.doc_id, r.taken) for r in mix], [(r.doc_id, r.taken) for r in again])
    assert mixing.curriculum(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_follows_the_integral_over_time(docs, rows):
    """By time t a source has given its schedule's integral up to t of its target, whatever t is."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = brute_targets(dict(sizes))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    for t in (0.0, 0.3, 0.5, 0.9, 1.0):
        got = Counter()
        for r in mixing.curriculum(docs, until=t).withColumn("taken", mixing.taken()).collect():
            got[r.source] += r.taken
            assert all(p.time <= t + 1e-9 for p in r.passes)
        for k, s in enumerate(names):
            knots, steps = mixing.SCHEDULES[k % 3], 20_000
            weight = lambda x: next(f0 + (f1 - f0) * (x - a) / (b - a) for (a, f0), (b, f1) in zip(knots, knots[1:]) if a <= x <= b)  # noqa: B023, E731
            area = [weight((i + 0.5) / steps) for i in range(steps)]
            assert abs(got[s] - goal[s] * sum(area[: round(t * steps)]) / sum(area)) <= 2


def test_positions_invert_the_schedules(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("y"))
    for k, knots in enumerate(mixing.SCHEDULES):
        _, area = mixing._segments(knots)

        def share(t):
            out = 0.0
            for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
                x = min(max(t, t0), t1)
                out += (x - t0) * (f0 + f0 + (f1 - f0) * (x - t0) / (t1 - t0)) / 2
            return out / area

        for r in df.select("y", mixing.position(F.col("y"), F.lit(k)).alias("t")).collect():
            assert math.isclose(share(r.t), r.y, abs_tol=1e-9)


def test_mixed_takes_what_the_mix_takes(clashing, rows):
    """Every row, also those without an id and with equal ids: copies and words are the curriculum's, and texts begin as they were."""
    out = mixing.mixed(clashing.withColumns({n: F.lit("clash") for n in ("_i", "_s", "_n", "_p", "_at", "_size", "md5", "passes", "at")}))
    got = out.collect()
    mix = mixing.curriculum(clashing).withColumn("taken", mixing.taken()).collect()
    assert Counter(r.doc_id for r in got) == +Counter({i: sum(len(r.passes) for r in mix if r.doc_id == i) for i in {r.doc_id for r in mix}})
    words_of = Counter()
    for r in got:
        words_of[r.source] += len(WORD.findall(r.text))
        assert r.size == "clash" and r._at == "clash"
    want = Counter()
    for r in mix:
        want[r.source] += r.taken
    assert words_of == +want
    texts = [r[1] for r in rows if r[1]]
    assert sum(r.text not in texts for r in got) <= len(want) and all(any(t.startswith(r.text) for t in texts) for r in got)


def test_first_words(spark):
    t = " a  b\n\tc d "
    df = spark.range(1, 6).select("id", mixing.first_words(F.lit(t), F.col("id")).alias("t"))
    assert [r.t for r in df.orderBy("id").collect()] == [" a", " a  b", " a  b\n\tc", " a  b\n\tc d", " a  b\n\tc d"]


# Shards


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_shards(request, rows, none, table):
    """Against a plain greedy fold: slots by the key's digest, largest first to the least loaded."""
    docs = request.getfixturevalue(table)
    records, shard_map, slots = shards.shard(docs, 16)
    got, seen, slot_of, load = records.collect(), Counter(), [], Counter()
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 1
        seen[i, crc, size] += 1
        v = int(hashlib.md5(f"{'' if i is None else i}|{crc}|{size}|{seen[i, crc, size]}".encode()).hexdigest()[:3], 16)
        slot_of.append((i, size, crc, v))
        load[v] += size
    total, where = [0] * 16, {}
    for v in sorted(load, key=lambda v: (-load[v], v)):
        where[v] = total.index(min(total))
        total[where[v]] += load[v]
    same([(r.doc_id, r.size, r.text_crc32, r.vslot, r.shard) for r in got], [(*x, where[x[3]]) for x in slot_of])
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    grown = {r.vslot: r.shard for r in shards.grow(shard_map, slots, 16).collect()}
    old = {r.vslot: r.shard for r in shard_map.collect()}
    assert all(grown[v] in (old[v], 16) for v in old) and {r.version for r in shards.grow(shard_map, slots, 16).collect()} == {2}
    assert shards.shard(none)[0].count() == 0


def test_shards_of_rows_without_ids_and_of_equal_rows(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(3000)] + [(7, "same")] * 2000 + [(None, None)] * 1000, "doc_id long, text string")
    loads = Counter()
    records = shards.shard(df, 4)[0].collect()
    for r in records:
        loads[r.shard] += r.size
    assert len(records) == 6000 and max(loads.values()) <= 1.02 * min(loads.values())


def test_stored_maps_are_edited_and_versioned(spark):
    """A named map is loaded and edited for new sizes; slots that can stay do, and a fitting map stays as it is."""
    import uuid

    name = uuid.uuid4().hex
    text = lambda n: F.repeat(F.lit("x"), (F.col("id") % n).cast("int"))
    first = spark.range(20_000).select(F.col("id").alias("doc_id"), text(50).alias("text"))
    _, one, _ = shards.shard(first, name=name)
    assert {r.version for r in one.collect()} == {1}
    assert {r.version for r in shards.shard(first, name=name)[1].collect()} == {1}
    more = first.unionByName(spark.range(20_000, 26_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), F.when(F.col("id") % 16 == 3, 400).otherwise(1)).alias("text")))
    records, two, _ = shards.shard(more, name=name)
    loads = [r.b for r in records.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert {r.version for r in two.collect()} == {2} and len(loads) == 16 and max(loads) <= 1.02 * min(loads)
    before, after = ({r.vslot: r.shard for r in m.collect()} for m in (one, two))
    assert sum(before[v] == after[v] for v in before) > 0.5 * len(before) and set(before) <= set(after)
    assert {r.vslot: r.shard for r in shards.load(spark, name, 1).collect()} == before


def test_shards_are_near_equal(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    loads = [r.b for r in shards.shard(df)[0].groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) <= 1.005 * min(loads)


# BPE


def encoding(v):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe(docs, rows, none):
    v = bpe.vocabulary(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN)
    enc = encoding(v)
    same([(r.doc_id, r.ids) for r in bpe.encode(docs).collect()], [(r[0], enc.encode_ordinary(r[1] or "")) for r in rows])
    want = [(r[0], len(i := enc.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    same(bpe.encode(docs, bpe.digests, bpe.DIGESTS).collect(), want)
    assert bpe.encode(none).count() == 0


def test_bpe_blocks_and_forgetting_change_nothing(monkeypatch):
    import random

    rng = random.Random(5)
    v = bpe.Vocabulary(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN)
    enc = encoding(v)
    texts = ["".join(rng.choice("aabcdeé st\n1日!") for _ in range(rng.randint(0, 200))) for _ in range(400)] + ["a" * 3000, "ab" * 2000, "ana" * 500]
    want = [enc.encode_ordinary(t) for t in texts]
    assert list(v.encode(texts)) == want
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert [x for t in texts for x in v.encode([t])] == want
    monkeypatch.setattr(bpe, "MANY", 1 << 30)  # one place at a time
    v.known = {}
    assert list(v.encode(texts)) == want
    assert all(v.decode(i) == t.encode() for i, t in zip(want, texts))


# Licences


def test_license_scan(spark, clashing):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    varied = "Copyright (c) 2001 Someone\n" + mit.upper().replace("SUBLICENSE", "sublicence").replace(",", " ;")
    df = spark.createDataFrame([(1, varied), (2, "Before. " + mit), (3, None), (4, ""), (5, "  RELEASED under the MIT licence!!"), (5, "Released under the MIT License."), (6, "© 1999\n")], "doc_id long, text string")
    got = [(r.doc_id, r.license_id) for r in licenses.scan(df).collect()]
    same(got, [(1, "MIT"), (2, None), (3, None), (4, None), (5, "MIT"), (5, "MIT"), (6, None)])
    assert licenses.scan(clashing).count() == clashing.count()


# Toxicity


def test_toxicity_learns_and_ignores_other_columns(spark):
    import random

    rng = random.Random(1)
    bad, good = ["awful", "scumbag", "idiot"], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        w = [rng.choice(good) for _ in range(40)]
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), "x", "y", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.predict(toxicity.score(docs, toxicity.train(docs, marks))).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.predict(toxicity.score(docs.withColumn("source", F.lit("z")), toxicity.train(docs, flipped))).collect()
    same(out, [tuple(r) for r in again])


def test_toxicity_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(None, 1), (5, None), (9, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels.where("false"))).count() == 0


def plain_features(text):
    """Words, their first 4 and 5 characters, neighbours and words with one between, as a set of coordinates."""
    h, top, mix = xxhash.xxh64_intdigest, (1 << 64) - 1, [int(x) for x in toxicity._MIX]
    words = re.findall(r"\w+", (text or "").lower())
    found = {h(w) for w in words} | {h(f"{k}{w[:k]}") for w in words for k in (4, 5)}
    found |= {(h(a) * mix[0] & top) ^ (h(b) * mix[1] & top) for a, b in zip(words, words[1:])}
    found |= {(h(a) * mix[2] & top) ^ (h(b) * mix[3] & top) for a, b in zip(words, words[2:])}
    return {x >> 44 for x in found}


def plain_ftrl(rows, labels, alpha=0.5, beta=1.0, l1=8.0, l2=1.0, epochs=4, positive=2.0):
    """FTRL-proximal one coordinate at a time, None being the bias."""
    import numpy as np

    z, n, order = defaultdict(float), defaultdict(float), np.random.RandomState(0)

    def weight(i):
        rate = (beta + math.sqrt(n[i])) / alpha
        if i is None:
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / (rate + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x = [*rows[k], None]
            w = {i: weight(i) for i in x}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[k]) * (positive if labels[k] else 1.0)
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_toxicity_is_the_plain_ftrl(spark, rows, clashing):
    import random

    rng = random.Random(4)
    bad, good = ["awful", "SCUMBAG", "idiot"], [f"w{i}" for i in range(60)]
    made = [(i, " ".join([*(rng.choice(good) for _ in range(25)), *([rng.choice(bad)] if i % 4 == 0 else [])]), None, None, None) for i in range(1000, 1240)]
    every = [*rows, *made, made[0]]  # nulls, empty and very long texts, repeated rows
    docs = spark.createDataFrame(every, clashing.select("doc_id", "text", "lang", "source", "n_chars").schema)
    marks = {r[0]: int(r[0] % 4 == 0) for r in [*rows, *made] if r[0] is not None}
    labels = spark.createDataFrame([*marks.items(), (1000, 0), (None, 1), (1001, None)], "doc_id long, toxic int")
    text = {}
    for r in every:
        if r[0] is not None and r[1] is not None:
            text[r[0]] = min(text.get(r[0], r[1]), r[1])
    taught = [i for i in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    order = [r.i for r in spark.createDataFrame([(i,) for i in taught], "i long").orderBy(F.xxhash64("i"), "i").collect()]
    want = plain_ftrl([plain_features(text.get(i)) for i in order], [marks[i] for i in order])
    weights, bias = toxicity.train(docs, labels)
    assert {i for i, w in want.items() if w and i is not None} == set(weights.nonzero()[0].tolist())
    assert all(math.isclose(w, weights[i] if i is not None else bias, rel_tol=1e-4, abs_tol=1e-6) for i, w in want.items())
    got = sorted(((r.doc_id is not None, r.doc_id, r.score) for r in toxicity.score(docs, (weights, bias)).collect()), key=str)
    brute = sorted(((r[0] is not None, r[0], 1 / (1 + math.exp(-sum(want.get(i, 0.0) for i in [*plain_features(r[1]), None])))) for r in every), key=str)
    by_id = lambda x: sorted(x, key=lambda r: (r[0], r[1] or 0, r[2]))
    assert len(got) == len(every)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-4) for a, b in zip(by_id(got), by_id(brute)))


def test_toxicity_with_clashing_names(docs, clashing, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 70)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(clashing, labels.withColumns({"text": F.lit("clash"), "y": F.lit(1), "at": F.lit(1), "score": F.lit("clash")}))
    assert (model[0] == again[0]).all() and model[1] == again[1]
    same(toxicity.score(clashing, model).collect(), [tuple(r) for r in toxicity.score(docs, model).collect()])
