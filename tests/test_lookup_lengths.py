from flowtrail.operators import lookup


def test_every_suffix_length_of_a_host_is_looked_up(spark):
    """Items of more lengths than hosts can have take no usable length away."""
    hosts = spark.createDataFrame([("a" * n + ".example",) for n in (1, 40, 90)], "host string")
    items = [(f"c{n}", lookup.SUFFIX, ("a" * 90 + ".example")[-n:]) for n in range(1, 99)] + [("far", lookup.SUFFIX, "b" * n) for n in range(99, 700)]
    got = {(len(r.host), r.code) for r in lookup.category_lookup(hosts, spark.createDataFrame(items, "code string, type int, value string")).collect()}
    assert got == {(m, f"c{n}") for m in (9, 48, 98) for n in range(1, m + 1)}
