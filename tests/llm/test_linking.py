"""Buckets that keep very many components are split by finer keys, and lose no link."""

import random

import pytest

from flowtrail.llm import linking, near, simhash


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[root(a)] = root(b)
    return [root(i) for i in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("n, finer", [(700, 0), (5_000, 32)])
def test_fingerprints_that_share_a_key_and_little_else(spark, monkeypatch, n, finer):
    """All are in the bucket of their two lowest segments; some differ from another in up to three bits."""
    monkeypatch.setattr(linking, "FINER", finer)
    rng = random.Random(n)
    made = [rng.getrandbits(64) & ~((1 << 19) - 1) for _ in range(n)]
    for k in range(0, n // 10):
        x = rng.choice(made)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(19, 64)
        made.append(x)
    fps = sorted(set(made))
    if n < 1000:
        want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    else:  # neighbours by the first 23 and the last 22 bits above the key, or by the part that three bits leave alone
        parts = [[(x >> s) & ((1 << 11) - 1) for s in (19, 30, 41, 52)] for x in fps]
        seen, pairs = {}, []
        for i, p in enumerate(parts):
            for k, v in enumerate(p):
                for j in seen.setdefault((k, v), []):
                    if (fps[i] ^ fps[j]).bit_count() <= 3:
                        pairs.append((i, j))
                seen[k, v].append(i)
        want = components(len(fps), pairs)
    got = {r.node & ((1 << 64) - 1): r.root & ((1 << 64) - 1) for r in simhash.connected(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    mine = {}
    for i, x in enumerate(fps):
        mine.setdefault(want[i], set()).add(x)
    theirs = {}
    for x in fps:
        theirs.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert any(len(g) > 1 for g in mine.values())


def test_texts_that_share_a_passage_and_little_else(spark, monkeypatch):
    """All begin with the same passage, and each has as much again of its own, or of a near copy."""
    monkeypatch.setattr(linking, "FINER", 0)
    monkeypatch.setattr(linking, "ROUNDS", 1)
    monkeypatch.setattr(linking, "PAIRS_A_ROW", 0)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(15)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(15)]
        texts.append(passage + own)
        if rng.random() < 0.5:
            copy = passage + own
            copy[rng.choice([0, 29, rng.randrange(30)])] = word()
            texts.append(copy)
    sets = [near.shingles(" ".join(t)) for t in texts]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near.similar(sets[i], sets[j])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in near.one_of_each(docs).collect()}
    first = {}
    for i, root in enumerate(want):
        first.setdefault(root, i)
    assert kept == set(first.values()) and 50 < len(kept) < len(texts)
