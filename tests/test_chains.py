"""Chains of groups that stand for one another."""

from pyspark.sql import functions as F

from flowtrail.operators import lookup


def test_cycles_carry_no_chains(spark, monkeypatch):
    """However many groups there are, chains of a cycle are not doubled until they are as long as the number of groups."""
    longest, written = [], lookup.written

    def measured(df, name):
        out = written(df, name)
        if "chain" in out.columns:
            longest.append(out.agg(F.max(F.size("chain"))).first()[0] or 0)
        return out

    monkeypatch.setattr(lookup, "written", measured)
    cycles = [(f"{a}{k}", f"{b}{k}") for k in range(100) for a, b in (("x", "y"), ("y", "x"))]
    rows = [*cycles, ("s", "s"), ("in", "x7"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "leaf"), ("e", None)]
    got = {r.tag: r for r in lookup.resolve_chain(spark.createDataFrame(rows, "tag string, now string")).collect()}
    assert len(got) == len(rows) and max(longest) <= 5
    for tag, _ in [*cycles, ("s", ""), ("in", "")]:
        assert (got[tag].leaf, got[tag].chain, got[tag].cycle) == (None, None, True)
    assert (got["a"].leaf, got["a"].chain, got["a"].cycle) == ("leaf", ["a", "b", "c", "d", "leaf"], False)
    assert got["d"].chain == ["d", "leaf"] and got["e"].chain == ["e", None]
