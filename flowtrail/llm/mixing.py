"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

A source's weight is a function of training time t in [0, 1], linear between knots. Its integral up to
t, scaled to the source's target, is the number of its tokens consumed by t. Inverting that at the
cumulative tokens of the documents before gives each document's training position; the range sort by
position is the training order. A source whose target exceeds its size runs through its documents
again, in the same order, so a document has a position for each pass that reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, quoted, table, without, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Knots (t, factor) of the schedules that sources take in turn; the factor multiplies the weight.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.5), (1.0, 0.75)))


def _segments(knots) -> tuple[list[tuple[float, float, float, float]], float]:
    """(start, length, factor at start, slope) and the integral."""
    out, area = [], 0.0
    for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
        out.append((area, t0, f0, (f1 - f0) / (t1 - t0)))
        area += (f0 + f1) / 2 * (t1 - t0)
    return out, area


def position(share: Column, schedule: Column) -> Column:
    """The time at which `share` (0 to 1) of a source's tokens is consumed: the inverse of the integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(SCHEDULES):
        segments, area = _segments(knots)
        y = share * F.lit(area)
        t = None
        for start, t0, f0, slope in segments:
            rest = F.greatest(y - F.lit(start), F.lit(0.0))
            here = F.lit(t0) + (rest / F.lit(f0) if slope == 0 else (F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(f0)) / F.lit(slope))
            t = here if t is None else F.when(y >= F.lit(start), here).otherwise(t)
        out = F.when(schedule == k, t).otherwise(out)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """source_size, target and schedule for each source; sizes has key, source and source_size.

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all sizes. A target
    stops at REPEATS times the source's size; the excess goes to the others by weight. That fixed
    point is min(cap, level * weight) with one level, found by ordering the sources by cap / weight: if
    those before a source are at their caps, the rest shares what they leave. Of the levels that the
    source itself can take the right one is the highest.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    s = sizes.withColumn("k", k).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") + 1).cast("int")))
    s = s.withColumns({"cap": (F.col("source_size") * REPEATS).cast("double"), "all": F.sum("source_size").over(every).cast("double") * SHARE})
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    return s.select("key", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"), F.pmod(F.col("k"), F.lit(len(SCHEDULES))).alias("schedule"))


def share(time: float) -> Column:
    """The part (0 to 1) of a source's tokens that its schedule consumes by `time`: the scaled integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(SCHEDULES):
        segments, area = _segments(knots)
        y = 0.0
        for start, t0, f0, slope in segments:
            if time > t0:
                t1 = min(time, next(t for t, _ in knots if t > t0))
                y = start + (f0 + f0 + slope * (t1 - t0)) / 2 * (t1 - t0)
        out = F.when(F.col("schedule") == k, F.lit(min(1.0, y / area))).otherwise(out)
    return out


def digest(id_col: str, text_col: str) -> Column:
    """What orders the documents of a source: md5 of the id and of the text's md5, so that rows without an id or with one id for all are spread too."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", until: float = 1.0) -> DataFrame:
    """One row for each input row: id, source, md5, size, source_size, target, passes.

    size: the text's words (null: 0). passes: time and words of each pass of which the mix takes some by
    training time `until`, empty if none does: what falls below the source's demand, its schedule's
    integral up to then. A source's last document may be taken in part, so at the end of the training a
    source's sum is its target rounded down. Null sources are one source. Documents follow in order of
    digest(), then size; equal rows are interchangeable, so reruns agree. An empty table gives an empty result.

    Prefix sums run within (source, first three digits of the digest), then over those 4,096 totals of
    each source, so that a source with most of the rows is not one task. Rows equal in source, id and
    text are counted before anything is shuffled and told apart at the end.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), digest(id_col, text_col).alias("md5"), F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"))
    return plan(table(rows.groupBy("_id", "source", "md5", "size").agg(F.count("*").alias("copies")), "mix-rows"), until).withColumnRenamed("_id", id_col)


def plan(rows: DataFrame, until: float = 1.0) -> DataFrame:
    """curriculum() over rows of _id, source, md5, size and copies."""
    # A key without null, so that the window and the join below share one exchange.
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    rows = rows.withColumns({"key": key, "part": F.substring("md5", 1, 3), "all": F.col("size") * F.col("copies")})
    parts = table(rows.groupBy("key", "part").agg(F.first("source").alias("source"), F.sum("all").alias("words")), "mix-parts")
    goal = targets(parts.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first")).join(goal.drop("source"), "key")
    inside = Window.partitionBy("key", "part").orderBy("md5", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(parts, ["key", "part"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    out = out.select("*", each.alias("copy")).withColumn("start", F.col("first") + F.col("inside") + F.col("copy") * F.col("size"))
    demand = F.floor(F.col("target") * share(until))

    def passed(p: int) -> Column:
        start = F.col("start") + F.col("source_size") * p
        n = F.least(F.greatest(demand - start, F.lit(0)), F.col("size"))
        return F.when(n > 0, F.struct(position(start / F.col("target"), F.col("schedule")).alias("time"), n.alias("words")))

    return out.select("_id", "source", "md5", "size", "source_size", "target", F.array_compact(F.array(*map(passed, range(REPEATS)))).alias("passes"))


def taken(passes: str = "passes") -> Column:
    """The words of all passes."""
    return F.aggregate(passes, F.lit(0).cast("long"), lambda a, p: a + p["words"])


def in_order(mix: DataFrame, n: int | None = None) -> DataFrame:
    """Rows range-sorted by first position; what the mix leaves out follows, by digest."""
    key = [F.get("passes", F.lit(0))["time"].asc_nulls_last(), F.col("md5").asc_nulls_last()]
    return mix.repartitionByRange(n, *key).sortWithinPartitions(*key) if n else mix.orderBy(*key)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, what stands between the words kept."""
    between = F.slice(F.split(text, WORD), 1, n.cast("int"))
    return F.array_join(F.zip_with(between, F.slice(words(text), 1, n.cast("int")), lambda a, b: F.concat(a, b)), "")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: each document once for every pass that takes some of it, in training order.

    The rows hold docs' columns only. Where a pass takes a document in part, which is at most once for a
    source, its text ends with the last word taken, so that a source's words are what the mix takes of
    it; other columns stay as they were. Documents with no word are in no pass. Rows equal in id, source
    and text are interchangeable, and one of them stands for all.

    The words are counted once, in the narrow rows; texts are joined by digest and range-sorted.
    """
    cols, md5, source, at, n = docs.columns, fresh("md5"), fresh("source"), fresh("at"), fresh("n")
    mix = table(curriculum(docs).where(F.size("passes") > 0), "mix")
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(source)
    passes = mix.select(F.col("md5").alias(md5), named, "size", F.explode("passes").alias("p")).select(md5, source, F.col("p.time").alias(at), F.when(F.col("p.words") < F.col("size"), F.col("p.words")).alias(n))
    one = fresh("one")
    key = F.concat(F.col(md5), F.col(source)).alias(one)
    rows = docs.select("*", digest("doc_id", "text").alias(md5), named)
    again = table(mix.groupBy("md5", "source").agg(F.count("*").alias("n")).where("n > 1").select(F.concat("md5", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).alias(one)), "mix-again")
    if again.limit(1).count():
        rows = without(rows.select("*", key), one, again.limit(0), again)
    out = rows.join(passes, [md5, source])
    text = F.when(F.col(n).isNotNull(), first_words(F.col("text"), F.col(n))).otherwise(F.col("text")).alias("text")
    return out.select(*[text if c == "text" else quoted(c)[0] for c in cols], F.col(at), F.col(md5)).orderBy(at, md5).select(*quoted(*cols))
