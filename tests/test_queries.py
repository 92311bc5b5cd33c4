"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

import flowtrail.item_queries  # noqa: F401  registers its queries
from flowtrail.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    r = duck.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=key)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in got), key=key) == want


def test_case_and_join_routing_agree(spark):
    a = {tuple(r) for r in QUERIES["route_lookup_case"](spark, SF).collect()}
    assert a == {tuple(r) for r in QUERIES["route_first_match_join"](spark, SF).collect()}
