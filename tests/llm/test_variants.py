"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from flowtrail.llm import variants


def counted(rows):
    out = Counter()
    for name, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(vocabulary):
    form, out = {}, []
    for w, n in vocabulary.items():
        others = [v for v in vocabulary if near(w, v)]
        best = min(others, key=lambda v: (-vocabulary[v], v), default=None)
        if best and vocabulary[best] < 5 * n:
            best = None
        form[w] = best
        out.append([w, n, len(others), best, vocabulary.get(best)])
    for r in out:
        root = r[0]
        while form[root]:
            root = form[root]
        r.append(root)
    return [tuple(r) for r in out]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def spelled(rng):
    """Texts of a few words, spelled with one, two and more errors, and their anagrams."""
    stems = ["colour", "separate", "straße", "Éclairs", "aaaaaa", "ababab", "bababa", "naïveté", "x÷y×zzz"]
    rows = []
    for k in range(400):
        w = []
        for _ in range(20):
            s = rng.choice(stems[: 1 + k % len(stems)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(s)), rng.choice("abé")
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i] + s[i + 2 :]])
            w.append(rng.choice([s, s.upper(), s.title()]))
        rows.append((k, rng.choice([" ", ", ", "1", "\n"]).join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, rows, seed):
    every = rows + spelled(random.Random(seed))
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(counted(every))
    assert sum(r[3] is not None for r in want) > 20
    got = variants.variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    same(got.collect(), want)
    from pyspark.sql import functions as F

    same(variants.variants(docs.withColumns({c: F.lit("clash") for c in ("word", "n", "key", "at", "run", "id", "letter", "a.b")})).collect(), want)


def test_edge_cases(spark, docs, rows, none):
    same(variants.variants(docs).collect(), brute(counted(rows)))
    assert variants.variants(none).count() == 0
    long_word = "y" * 50_000
    repeated = [("a", f"{long_word} {long_word}x {long_word} ")] * 60 + [(None, "ABCDEF abcdef abcdeg")] * 6 + [("b", None), ("b", "")]
    same(variants.variants(spark.createDataFrame(repeated, "doc_id string, text string")).collect(), brute(counted(repeated)))


def test_chains(spark):
    """Each form is five times as frequent as the one before; ties of frequency go to the first word."""
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625), ("aaaaaz", 25), ("qqqqqq", 9)]
    got = variants.forms(spark.createDataFrame(chain, "word string, n long")).collect()
    same(got, brute(dict(chain)))
    assert {r.word: r.root for r in got}["aaaaaa"] == "abbbbb"


def test_sums_of_letters_that_agree(spark, monkeypatch):
    """Letters whose values collide are told apart by the words."""
    monkeypatch.setattr(variants, "MODULUS", 7)
    vocabulary = Counter("".join(random.Random(k).choice("abc") for _ in range(6)) for k in range(400))
    same(variants.forms(spark.createDataFrame(list(vocabulary.items()), "word string, n long")).collect(), brute(vocabulary))


def test_exploded_rows_are_not_broadcast(spark):
    """Spark takes the index for little larger than the vocabulary's file, however many rows the words explode into."""
    vocabulary = variants.table(spark.createDataFrame([("abcdef", 9), ("abcdeg", 50)], "word string, n long"), "test-words")
    pairs = variants.near_pairs(vocabulary)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in pairs.collect()] == [("abcdef", "abcdeg")]
