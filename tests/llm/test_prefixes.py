"""Prefix hashes against plain strings, and the neighbours' fingerprints against a brute-force version."""

import hashlib
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtrail.llm import prefixes
from flowtrail.llm.prefixes import Fingerprint, Prefixes, fingerprint, likeness

TEXT = st.text("ab \x00é日😀", max_size=60)


@settings(max_examples=80, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(x, y, data):
    p, q = Prefixes.of(x), Prefixes.of(y)
    i, j = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    n = data.draw(st.integers(0, 8))
    fits = i + n <= len(x) and j + n <= len(y)
    assert p.equal(i, q, j, n) == (fits and x[i : i + n] == y[j : j + n])
    common = 0
    while i + common < len(x) and j + common < len(y) and x[i + common] == y[j + common]:
        common += 1
    assert p.extension(i, q, j) == common
    both = p.joined(i, q, j)
    assert both.n == i + j and both.span(0, i + j) == Prefixes.of(x[:i] + y[:j]).span(0, i + j)
    whole = Prefixes.of(x[:i] + y[:j])
    assert all((a == b).all() for a, b in zip(both.sums, whole.sums))
    for width in (1, 3, 16):
        assert p.spans(width).tolist() == [p.span(k, k + width) for k in range(len(x) - width + 1)] or len(x) < width
        assert [a == b for a in p.spans(width) for b in q.spans(width)] == [a == b for a in _cut(x, width) for b in _cut(y, width)]


def _cut(text, width):
    return [text[k : k + width] for k in range(max(1, len(text) - width + 1))] if text else []


def test_very_long_spans():
    text = "abc" * 100_000
    p = Prefixes.of(text)
    assert p.extension(0, p, 3) == len(text) - 3 and p.extension(0, p, 1) == 0
    assert p.equal(0, p, 299_997, 3) and not p.equal(0, p, 299_998, 3)


def _dice(x, y, width):
    a, b = Counter(_cut(x, width)), Counter(_cut(y, width))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_likeness_estimates_the_common_share():
    import random

    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    for kept in (0, 5_000, 10_000, 15_000, 19_000, 20_000):
        other = base[:kept] + "".join(rng.choice("ijklmnop ") for _ in range(20_000 - kept))
        assert abs(likeness(fingerprint(base), fingerprint(other)) - _dice(base, other, prefixes.WIDE)) < 0.2
    short, near = "a short text of some words", "a short text of some words more"
    assert likeness(fingerprint(short), fingerprint(near)) == pytest.approx(_dice(short, near, prefixes.NARROW))  # all spans are in the sketch
    repeated = "line of junk\n" * 40
    assert likeness(fingerprint(repeated), fingerprint(repeated[: len(repeated) * 3 // 4] + "q" * (len(repeated) // 4))) > 0.5
    assert likeness(fingerprint(""), fingerprint(None)) == 1 and likeness(fingerprint(""), fingerprint("a")) == 0


@settings(max_examples=40, deadline=None)
@given(TEXT, TEXT)
def test_fingerprints_as_text(x, y):
    a, b = fingerprint(x), fingerprint(y)
    assert Fingerprint.parse(str(a)) == a
    assert (str(a) == str(b)) == (x == y)
    assert likeness(a, b) == likeness(b, a) and 0 <= likeness(a, b) <= 1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], _signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for (name, text, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        t, f = text or "", following or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + f[:q]
        mine, other = fingerprint(t), fingerprint(edited)
        start = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        out.append((name, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(mine), str(other), likeness(mine, other), likeness(mine, fingerprint(f)), start(t, edited), start(t, f)))
    return out


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_successors(request, rows, table):
    docs = request.getfixturevalue(table)
    same(prefixes.successors(docs).collect(), brute(rows))
    same(prefixes.successors(docs.repartition(7)).collect(), brute(rows))


def test_successors_of_few_rows(spark, none):
    assert prefixes.successors(none).count() == 0
    for rows in ([("b", "some text of twenty letters")], [("b", "abcdefgh"), ("a", "12"), (None, None)], [("a", "same text"), ("a", "same text")]):
        same(prefixes.successors(spark.createDataFrame(rows, "doc_id string, text string")).collect(), brute(rows))


def test_query(spark):
    from flowtrail.llm.queries import op11_prefix_hashes

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_prefix_hashes(spark, sf)
    same(got.collect(), brute(rows))
    edited, following = got.selectExpr("avg(near_edited)", "percentile(near_next, 0.9)").first()
    assert edited > 0.7 and following < 0.3
