"""Patterns: held against another linear-time engine; what they need is in all that they match; lists of any length without a nested loop."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowtrail.functions import regex
from flowtrail.operators import lookup, patterns

ATOMS = ["a", "b", "ab", ".", "[ab]", "[^a]", r"\d", r"\w", r"\s", r"\.", "^", "$", r"\b", "(a|b)", "(?:ab|c|)", "[[:alpha:]]", "[a-c0-2]", r"\x61", r"\Qa.b\E", "(?i)B", "(?i:Ab)", r"\pL", "[^[:digit:]]", "(?P<n>b)", r"[\d.]", "-", "é", "[]a]", r"[\]x]", "{", "a{2}", "(?s:.)", r"\W", r"\p{Lu}", "\n"]
BAD = ["a**", "(", ")", "a)", "[a", "[z-a]", r"\1", "(?=a)", "(?!a)", "(?<=a)", "*a", "|*", "a{1001}", "a{3,2}", r"\q", r"\p{Nope}", "[[:nope:]]", "(?z)a", "(?P<>a)", "x{2}{3}", "\\", "a++", r"\x{110000}"]
TEXTS = ["", "a", "b", "ab", "a.b", "aab", "ABC", "abab", "1a2", "a b", "é", "\n", "a\nb", "b\n", "x-y", "cab.ab", "{", "aaaa", "B", "]", "É1"]


def made(rng):
    return "".join(rng.choice(ATOMS) + rng.choice(["", "", "", "*", "+", "?", "{1,2}", "|", "+?"]) for _ in range(rng.randint(1, 4)))


def test_translation_and_needs(spark):
    rng, con = random.Random(11), duckdb.connect()
    good, wrong = [], []
    # The other engine folds letters wrongly in some alternations.
    for p in {p for p in (made(rng) for _ in range(700)) if not ("|" in p and "(?i" in p)} | set(BAD):
        try:
            con.execute("SELECT regexp_matches('x', ?)", [p]).fetchone()
            good.append(p)
        except duckdb.Error:
            wrong.append(p)
    for p in wrong:
        with pytest.raises(ValueError):
            regex.read(p)
    assert set(BAD) <= set(wrong) and len(good) > 300
    df = spark.createDataFrame([(p, regex.translate(p), t) for p in good for t in TEXTS], "p string, java string, t string")
    for p, t, hit in df.select("p", "t", F.regexp("t", F.col("java"))).collect():
        assert hit == con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0], (p, t)
        if hit:
            assert all(any(x in regex.START + t + regex.END for x in group) for group in regex.read(p).required()), (p, t)


def test_matches_agree_with_trying_each(spark):
    rng = random.Random(12)
    hosts = sorted({".".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(3)) for _ in range(150)}) + ["日本.b", "x" * 300]
    lines = sorted({rng.choice(["^", "", "(^|[.])"]) + rng.choice(["ab", "c.", "a[.]b", "(ab|ca)+", "b{2}", "", "[ab]c", "本"]) + rng.choice(["", "$", ".*a", "[.]"]) for _ in range(120)}) + ["(", None, "a**"]
    con = duckdb.connect()
    want = {(h, p) for h in hosts for p in lines if p is not None and p not in ("(", "a**") and con.execute("SELECT regexp_matches(?, ?)", [h, p]).fetchone()[0]}
    given = spark.createDataFrame([(p, p) for p in lines], "pattern string, name string").repartition(3)
    got = patterns.matches(spark.createDataFrame([(h,) for h in hosts * 2], "host string"), given).collect()
    assert {(r.host, r.name) for r in got} == want and len(got) == len(want)
    empty = given.where("false")
    assert patterns.matches(spark.createDataFrame([("a",)], "host string"), empty).count() == 0


def test_a_hundred_thousand_keywords(spark):
    """No nested loop, and a host meets the few keywords only that share their rarest letters with it."""
    words = spark.range(100_000).select(F.lit("c").alias("code"), F.lit(lookup.KEYWORD).alias("type"), F.concat(F.lit("key"), F.hex("id"), F.lit("word")).alias("value"))
    hosts = spark.createDataFrame([("key1F4word.example",), ("none.example",), ("akey186A0wordb",)], "host string")
    got = lookup.category_lookup(hosts, words)
    assert {r.host for r in got.collect()} == {"key1F4word.example"}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quoted(spark):
    texts = ["a.b", "x*[y]$^", "", "é{1}", "\\d", "a b\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("q", patterns.quoted(F.col("t")))
    assert all(regex.read(r.q).texts == {r.t} for r in df.collect())
