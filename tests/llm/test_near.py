"""Near-duplicates by shingles against brute force."""

import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline
from flowtrail.llm import near, simhash
from tests.llm.test_documents import WORD, lower

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
SF = "/root/testdata/sf0.001"


def runs(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(texts):
    """Sets of the places of texts that links connect, by comparing all pairs."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    out = {}
    for i, r in enumerate(root):
        out.setdefault(r, []).append(i)
    return list(out.values())


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    out = STAGE(spark, df, None)
    assert out.columns == df.columns
    kept = Counter(r.mark for r in out.collect())
    assert max(kept.values()) == 1
    for g in groups([r[1] for r in rows]):
        stays = [i for i in g if kept[rows[i][2]]]
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        assert len(stays) == 1 and rows[stays[0]][0] == (min(ids) if ids else None)


@pytest.mark.parametrize("often", [4, 1])
def test_stage_keeps_one_of_each_group(spark, rows, monkeypatch, often):
    """Copies with more and more words changed, around the limit; shared boilerplate; null and repeated ids."""
    monkeypatch.setattr(near, "SAMPLE", 2 if often == 4 else 1)
    monkeypatch.setattr(near, "OFTEN", often)
    rng, made = random.Random(5), [(r[0], r[1]) for r in rows]
    notice = " ".join(f"notice{i}" for i in range(12))
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 8, 60, 150, 400]))]
        for c in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"other{rng.randrange(9999)}"
            made.append((rng.choice([None, 7, 1000 + 10 * k + c]), " ".join(w) + (" " + notice if k % 3 == 0 else "")))
    check(spark, [(i, t, at) for at, (i, t) in enumerate(made)])


def test_stage_on_documents(spark):
    check(spark, [(r.doc_id, r.text, at) for at, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())])


def test_simhash_comes_first(spark, monkeypatch):
    """Texts with near fingerprints are linked by them, after an exact comparison, before shingles are looked at."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{k}" for k in range(400))]
    assert bin((simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])) & (2**64 - 1)).count("1") <= 3
    found, by = [], near.by_fingerprint

    def seen(sets, links):
        roots = by(sets, links)
        found.append(roots.select("node").distinct().count())
        return roots

    monkeypatch.setattr(near, "by_fingerprint", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near.one_of_each(docs).collect()) == [0, 2]
    assert found == [2]
