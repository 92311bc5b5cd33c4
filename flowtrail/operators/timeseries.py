"""Time-series arithmetic: averages, stability, trimmed means, responsiveness, idle and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.session import written

WINDOW = 4
TOLERANCE_PCT = 5.0
TRIM_PCT = 5
#: Values that are folded in one row.
BLOCK = 512


def ordered_mean(values: Column) -> Column:
    """The mean of an array, summed from the left; 0 if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def trimmed(values: Column, percent: int = TRIM_PCT) -> Column:
    """An array sorted, without its top floor(n * percent / 100); nothing is trimmed if that is none or all."""
    s = F.sort_array(values)
    cut = F.floor(F.size(values) * percent / 100).cast("int")
    return F.when((cut > 0) & (cut < F.size(values)), F.slice(s, 1, F.size(values) - cut)).otherwise(s)


def _same(keys: list[str]) -> Column:
    """Equal keys, null being a key as well."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def _parts(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df dealt out by ranges of the columns, with the number of the range: a key with very many rows is in many of them."""
    return written(df.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), name)


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (how often), upto (how many of the key's values are no larger) and total; nulls do not count.

    Equal values are counted first and the rest is ordered within ranges, so no task has all values of a key.
    """
    parts = _parts(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), [*keys, value], "ranks")
    sums = parts.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*keys)
    sums = sums.select(*keys, "part", F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(w).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    both = parts.withColumn("upto", inside).alias("a").join(sums.alias("b"), (F.col("a.part") == F.col("b.part")) & _same(keys))
    return both.select(*[f"a.{k}" for k in keys], f"a.{value}", "a.n", (F.col("a.upto") + F.col("b.before")).alias("upto"), "b.total")


def upper_trimmed_mean(df: DataFrame, key: str | list[str], value: str, percent: int = TRIM_PCT) -> DataFrame:
    """key and mean without the top floor(n * percent / 100) values; nothing is trimmed if that is none or all."""
    keys = [key] if isinstance(key, str) else key
    cut = F.floor(F.col("total") * percent / 100)
    keep = F.when((cut > 0) & (cut < F.col("total")), F.col("total") - cut).otherwise(F.col("total"))
    taken = F.least(F.col("n"), keep - (F.col("upto") - F.col("n")))
    kept = ranked(df, keys, value).withColumn("taken", taken).where("taken > 0")
    return kept.groupBy(*keys).agg((F.sum(F.col(value).cast("double") * F.col("taken")) / F.sum("taken")).alias("mean"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and the element n/2 (from 0) of its sorted values: the upper of two middle ones."""
    middle = F.floor(F.col("total") / 2) + 1
    return ranked(df, [key], value).where((F.col("upto") >= middle) & (F.col("upto") - F.col("n") < middle)).select(key, F.col(value).alias("median"))


def moving_stability(df: DataFrame, key: str, order: str, value: str, window: int = WINDOW, tolerance_pct: float = TOLERANCE_PCT) -> DataFrame:
    """key, order, moving average, ready, stable and confidence after each positive value.

    The average is over the last `window` values; it is stable if the population deviation of the last
    `window` averages is within the tolerance of the latest. Other values are passed over.
    """
    w = Window.partitionBy(key).orderBy(order)
    last = w.rowsBetween(1 - window, 0)
    d = df.where((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")) & (F.col(value).cast("double") < float("inf"))).select(key, order, F.col(value).alias("value"))
    d = d.withColumn("average", F.avg("value").over(last))
    d = d.withColumns({"n": F.count("*").over(last), "spread": F.stddev_pop("average").over(last)})
    ready = F.col("n") >= window
    stable = ready & (F.col("average") > 0) & (F.col("spread") <= F.col("average") * (tolerance_pct / 100))
    return d.select(key, order, "average", ready.alias("ready"), stable.alias("stable"), F.when(stable, "high").when(ready, "medium").otherwise("low").alias("confidence"))


def measurement_window(stability: DataFrame, key: str, order: str, window: int = WINDOW) -> DataFrame:
    """key, lower and upper interval: from the first stable interval back over the window."""
    first = stability.where("stable").groupBy(key).agg(F.min(order).alias("upper"))
    return first.select(key, F.greatest(F.col("upper") - (window - 1), F.lit(0)).alias("lower"), "upper")


def ewma(df: DataFrame, key: str, order: list[str], value: str, weight: float = 0.3) -> DataFrame:
    """key, its last average and n: weight * x + (1 - weight) * previous, the first value or a previous of exactly 0 starting anew.

    BLOCK values in a row are folded for themselves, to what they make of 0 and to the factor and term that they apply to any
    other average; then BLOCK blocks in a row, and so on, so no row or task has all values of a key. Blocks are counted
    from a key's first value, so the result is the same however the rows are dealt. An average that a block is
    entered with is taken not to come to exactly 0 within it. Ties in order follow by value; nulls are left out.
    """
    x = df.where(F.col(value).isNotNull()).select(key, F.struct(*order).alias("at"), F.col(value).cast("double").alias("x"))
    parts = _parts(x, [key, "at", "x"], "ewma")
    counts = parts.groupBy(key, "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select(key, "part", before.alias("before"), (before + F.col("m")).alias("upto")), "ewma-counts")
    nth = F.row_number().over(Window.partitionBy(key, "part").orderBy("at", "x")) - 1
    both = parts.withColumn("nth", nth).alias("a").join(counts.alias("b"), (F.col("a.part") == F.col("b.part")) & _same([key]))
    placed = both.select(f"a.{key}", (F.col("a.nth") + F.col("b.before")).alias("nth"), "a.x")
    one = F.struct("nth", F.col("x").alias("anew"), F.lit(1 - weight).alias("factor"), (F.lit(weight) * F.col("x")).alias("term"), F.lit(1).cast("long").alias("n")).alias("b")
    folded, most = placed.select(key, one), counts.agg(F.max("upto")).first()[0] or 0

    def join(a: Column, b: Column) -> Column:
        """What a and then b make."""
        anew = F.when(a["anew"] == 0, b["anew"]).otherwise(b["factor"] * a["anew"] + b["term"])
        return F.struct(anew.alias("anew"), (a["factor"] * b["factor"]).alias("factor"), (b["factor"] * a["term"] + b["term"]).alias("term"), (a["n"] + b["n"]).alias("n"))

    start = F.struct(F.lit(0.0).alias("anew"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("term"), F.lit(0).cast("long").alias("n"))
    while True:
        of = F.floor(F.col("b.nth") / BLOCK)
        made = folded.groupBy(key, of.alias("nth")).agg(F.aggregate(F.sort_array(F.collect_list("b")), start, join).alias("f"))
        if most <= BLOCK:
            return made.select(key, F.col("f.anew").alias("ewma"), F.col("f.n").alias("n"))
        folded, most = made.select(key, F.struct("nth", "f.anew", "f.factor", "f.term", "f.n").alias("b")), -(-most // BLOCK)


PROBES = ("tcp", "tls", "http_first", "http_loaded")


def responsiveness(rounds: DataFrame, key: str, percent: int = TRIM_PCT) -> DataFrame:
    """Round trips per minute of each key from probe rounds (tcp, tls, http_first, http_loaded in ms; 0 or null: none).

    The mean of what idle probes allow (over the components that were measured) and what loaded ones do; 0
    if either is missing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("probe"), F.col(c).cast("double").alias("ms")) for c in PROBES]))
    measured = rounds.select(key, each.alias("m")).select(key, "m.probe", "m.ms").where("ms > 0")
    means = upper_trimmed_mean(measured, [key, "probe"], "ms", percent).unionByName(rounds.select(key).distinct(), allowMissingColumns=True)
    m = means.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("probe") == c, F.col("mean"))), F.lit(0.0)).alias(c) for c in PROBES])
    parts = F.filter(F.array("tcp", "tls", "http_first"), lambda x: x > 0)
    rpm = F.floor((60000.0 / ordered_mean(parts) + 60000.0 / F.col("http_loaded")) / 2 + 0.5).cast("int")
    return m.select(key, F.when((F.col("http_loaded") <= 0) | (F.size(parts) == 0), F.lit(0)).otherwise(rpm).alias("rpm"))


def capacity(samples: DataFrame, window: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Bits per second of each key: the trimmed mean of samples (interval, bps) in its window, else of all, else bytes * 8 / seconds.

    spans: key, total_bytes, seconds for every key.
    """
    s = samples.join(window, key, "left").withColumn("inside", F.coalesce(F.col("interval").between(F.col("lower"), F.col("upper")), F.lit(False)))
    some = s.groupBy(key).agg(F.max("inside").alias("some"))
    mean = upper_trimmed_mean(s.join(some, key).where(F.col("inside") | ~F.col("some")), key, "bps")
    fallback = F.when(F.col("seconds") > 0, (F.col("total_bytes") * 8 / F.col("seconds")).cast("long")).otherwise(F.lit(0))
    return spans.join(mean, key, "left").select(key, F.coalesce(F.floor(F.col("mean") + 0.5), fallback).alias("capacity"))


def nat_class(probes: DataFrame) -> DataFrame:
    """mapping and filtering from probe results: mapped1..3 (external address seen, null: no answer), filter1, filter2 (answered)."""
    mapping = (
        F.when(F.col("mapped1").isNull() | F.col("mapped2").isNull(), "unknown").when(F.col("mapped1") == F.col("mapped2"), "endpoint_independent")
        .when(F.col("mapped3").isNull(), "unknown").when(F.col("mapped2") == F.col("mapped3"), "address_dependent").otherwise("address_and_port_dependent")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    filtering = F.when(yes("filter1"), "endpoint_independent").when(yes("filter2"), "address_dependent").otherwise("address_and_port_dependent")
    return probes.withColumns({"mapping": mapping, "filtering": filtering})
