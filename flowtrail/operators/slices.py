"""Running values of keys without a window over a whole key: time is cut into slices, and what a slice needs from earlier ones is carried over its bound.

The slices' bounds are quantiles of the times of all rows, so a key with a third of the rows is in about a third of
as many tasks as there are slices. A slice of a key gives one partial value; the running value over those is a
window of as many rows as slices. Rows and carried values meet by (key, slice), which is also how the window
inside a slice is dealt, so rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Slices of time, and the accuracy of their bounds.
SLICES, ACCURACY = 64, 1000


def _sliced(df: DataFrame, at: str) -> Column:
    """The slice of a time: how many bounds are at or before it."""
    percentages = [k / SLICES for k in range(1, SLICES)]
    found = df.select(F.col(at).cast("double").alias("t")).agg(F.percentile_approx("t", percentages, ACCURACY)).first()[0]
    bounds = sorted(set(found or []))  # SLICES numbers
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(at).cast("double"))) if bounds else F.lit(0)


def running(df: DataFrame, keys: list[str], at: str, then: list[str], value: str, name: str, *, largest: bool = False, itself: bool = True) -> DataFrame:
    """df with name: the last value that is not null among a key's rows up to this one, or the largest; without the row itself if not `itself`.

    Rows go by `at`, a number, and then by the columns of `then`; keys and `at` are not null. Of rows that tie in all of
    them any may be the last.
    """
    rows = df.withColumn("_slice", _sliced(df, at))
    order = [F.col(c) for c in (at, *then)]
    place = F.struct(at, *then)
    part = F.max(value) if largest else F.max_by(value, F.when(F.col(value).isNotNull(), place))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (F.max("_part") if largest else F.last("_part", ignorenulls=True)).over(before)
    parts = rows.groupBy(*keys, "_slice").agg(part.alias("_part")).select(*keys, "_slice", carried.alias("_carried"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    here = (F.max(value) if largest else F.last(value, ignorenulls=True)).over(inside)
    out = rows.join(parts, [*keys, "_slice"]).withColumn("_here", here)
    made = F.greatest("_here", "_carried") if largest else F.coalesce("_here", "_carried")
    return out.select(*df.columns, made.alias(name))


def chain(rows: DataFrame, key: str, at: str, until: str) -> DataFrame:
    """rows (distinct in key and at) with counts: whether the row is on its key's chain.

    The first row of a key counts, and then always the first whose `at` is at or after the `until` of the last that
    counted; until > at. A row that no earlier row reaches counts for sure, and what it begins, up to the next of that
    kind, is a stretch of its own. In a stretch each row points to the first one after its `until`, and the
    distance doubles with each step, so a stretch of any length needs few steps, each of them a join of narrow tables.
    """
    # A null key is a key as well: it is a value of its type and a mark.
    zero = F.lit("0").cast(rows.schema[key].dataType)
    k = F.struct(F.coalesce(F.col(key), zero).alias("of"), F.col(key).isNull().alias("none"))
    t = running(rows.select(k.alias("k"), F.col(at).alias("at"), F.col(until).alias("until")), ["k"], "at", [], "until", "reached", largest=True, itself=False)
    t = t.withColumn("sure", F.coalesce(F.col("reached") <= F.col("at"), F.lit(True)))
    t = written(t.withColumn("first", F.when(F.col("sure"), F.col("at"))).drop("reached"), "chain-rows")
    t = written(running(t, ["k"], "at", [], "first", "stretch").drop("first"), "chain-rows")
    # From behind, the last row at or after `until` is the first one.
    asks = t.select("k", "stretch", (-F.col("until")).alias("t"), F.lit(1).alias("side"), F.col("at").alias("asked"), F.lit(None).cast("long").alias("there"))
    gives = t.select("k", "stretch", (-F.col("at")).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("asked"), F.col("at").cast("long").alias("there"))
    both = running(asks.unionByName(gives), ["k", "stretch"], "t", ["side"], "there", "next")
    links = written(both.where((F.col("side") == 1) & F.col("next").isNotNull()).select("k", "asked", "next"), "chain-links")
    counted = written(t.where("sure").select("k", "at"), "chain-counted")
    while links.limit(1).count():
        same = F.col("a.k") == F.col("b.k")
        reached = counted.alias("a").join(links.alias("b"), same & (F.col("a.at") == F.col("b.asked"))).select("b.k", F.col("b.next").alias("at"))
        more = written(reached, "chain-counted")
        counted = counted.unionByName(more)
        if not more.limit(1).count():
            break
        links = written(links.alias("a").join(links.alias("b"), same & (F.col("a.next") == F.col("b.asked"))).select("a.k", "a.asked", "b.next"), "chain-links")
    found = counted.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.lit(True).alias("_on"))
    out = rows.withColumn("_k", k).join(found.withColumnRenamed("_at", at), ["_k", at], "left")
    return out.select(*rows.columns, F.coalesce("_on", F.lit(False)).alias("counts"))
