"""Licence texts wherever their lines break."""

import textwrap

from flowtrail.llm import licenses


def test_known_texts_rewrapped(spark):
    rows, want = [], {}
    for name, text in licenses.KNOWN:
        for width in (10, 20, 33, 47, 60, 72, 79, 100, 10_000):
            for notice in ("", "Copyright (c) 2001 Someone\n\n", "Copyright Some One\n", "(c) 1999, 2001 Someone\n", "© Someone\n", "copyright: 2020 Someone\n"):
                want[len(rows)] = name
                rows.append((len(rows), notice + textwrap.fill(text, width, break_long_words=False)))
    isc = dict((n, t) for n, t in licenses.KNOWN if not t.startswith("ISC") and n == "ISC")["ISC"]
    want[len(rows)] = "ISC"
    rows.append((len(rows), isc.replace("provided that the above copyright", "provided that the above\ncopyright")))
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_list_items_and_body_lines_stay(spark):
    body = ["copyright notice and this permission", "(c) you must retain all notices", "copyright holders be liable", "copyrighted works", "copyright"]
    gone = ["Copyright (C) 2020 Me", "(c) 2020 Me", "© Me", "Copyright Me", "  copyright 1999-2001, Me"]
    df = spark.createDataFrame([(t,) for t in body + gone], "text string").select("text", licenses.canonical(licenses.F.col("text")).alias("c"))
    assert {r.text for r in df.collect() if r.c} == set(body)
