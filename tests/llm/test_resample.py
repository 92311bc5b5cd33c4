"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from flowtrail.llm import resample


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25, min_words=20):
    made = [(r[0], *features(r[1])) for r in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (total_s + 10_000) / (float(s[b] + 1) * (total_t + 10_000))))
    out = []
    for name, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = eligible[: percent * len(eligible) // 100]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(id(r), k + 1)
    return [(*r[:4], ranks.get(id(r))) for r in out]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


TARGET = ["the of and onth", None, "", "erst thing blé 日本 blé"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(x,) for x in TARGET], "text string")


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_resampled(request, rows, target, table):
    got = resample.resampled(request.getfixturevalue(table), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), brute(rows, TARGET))


def test_all_drawn_none_drawn_and_empty(docs, none, target, rows):
    everything = [r.rank for r in resample.resampled(docs, target, percent=100).collect() if r.rank]
    assert sorted(everything) == list(range(1, len(everything) + 1)) and len(everything) == sum(features(r[1])[0] >= 20 for r in rows)
    assert resample.resampled(docs, target, percent=0).where("rank is not null").count() == 0
    assert resample.resampled(none, target).count() == 0
    same(resample.resampled(docs, target.where("false")).collect(), brute(rows, []))


def test_names_of_text(spark, target):
    rows = [(f"d{k % 50}", " ".join(f"w{(k * 7 + i) % 90}" for i in range(30))) for k in range(200)]
    got = resample.resampled(spark.createDataFrame(rows, "doc_id string, text string"), target).collect()
    ranks = sorted(r.rank for r in got if r.rank)
    assert len(got) == 200 and ranks == list(range(1, 51))
    least = min(r.score for r in got if r.rank)
    assert all(r.rank for r in got if r.score > least)


def test_ties_and_copies_in_small_slices(spark, monkeypatch):
    """Equal scores of different ids, rows repeated often, rows without an id; slices and runs of a few rows."""
    monkeypatch.setattr(resample, "SLICE_ROWS", 5)
    rng = random.Random(5)
    rows = [(rng.randint(0, 300), 40, 5, rng.randint(0, 12), True) for _ in range(400)] + [(None, 40, 5, 7, True)] * 3 + [(7, 40, 5, 12, True)] * 90 + [(1, 3, 0, 99, False)] * 4
    df = spark.createDataFrame(rows, "id long, n_features long, weight long, score long, eligible boolean").repartition(9)
    for percent in (25, 50, 97):
        got = resample.draw(df, percent).collect()
        order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
        n = len(order) * percent // 100
        assert len(got) == len(rows)
        assert [(r.id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(r[0], r[3]) for r in order[:n]]
        assert sorted(r.rank for r in got if r.rank) == list(range(1, n + 1))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_tournament(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 50), i, j) for j in range(rng.randint(0, 20))) for i in range(k)]
    assert list(resample.Tournament(runs)) == sorted(x for r in runs for x in r)


def test_hasher_forgets(monkeypatch):
    monkeypatch.setattr(resample, "HELD", 1000)
    hasher = resample.Hasher()
    for text in ("one two three four five six", "one two", None, "", "Ä b", "one " * 50):
        n, found = hasher(text)
        assert (n, found.tolist()) == features(text)
