"""Usage cells and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import translate
from ..functions.scalar import round2
from ..session import written

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_5m_tokens", "cache_1h_tokens", "cache_total_tokens")


def week_start(reset_at: Column, window_minutes: Column) -> Column:
    """Epoch seconds of the week that ends at reset_at; 0 without a hint."""
    return F.when(reset_at.isNull() | (F.coalesce(window_minutes, F.lit(0)) <= 0), F.lit(0)).otherwise(reset_at - window_minutes * 60)


def week_label(start: Column) -> Column:
    return F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd HH:mm:ss 'UTC+00:00'")


def cells(requests: DataFrame, *more: str) -> DataFrame:
    """Requests and token sums by (model, context_window, week_start, more..., user); user '' included."""
    r = requests.withColumn("cache_total_tokens", F.when(F.col("cache_total_tokens") == 0, F.col("cache_5m_tokens") + F.col("cache_1h_tokens")).otherwise(F.col("cache_total_tokens")))
    return r.groupBy("model", "context_window", "week_start", *more, "user").agg(F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in TOKENS])


def all_users(by_user: DataFrame, *more: str) -> DataFrame:
    return by_user.groupBy("model", "context_window", "week_start", *more).agg(F.sum("requests").alias("requests"), *[F.sum(t).alias(t) for t in TOKENS])


def price(model: Column, families: list[tuple[str, dict]], default: dict, premium: Column | None = None) -> Column:
    """The prices (struct) of the first family whose pattern the model matches; a family's `premium` prices where premium holds."""
    names = [k for k in default if k != "premium"]

    def struct(p: dict) -> Column:
        plain = F.struct(*[F.lit(float(p[k])).alias(k) for k in names])
        return plain if premium is None or "premium" not in p else F.when(premium, struct({k: v for k, v in p["premium"].items()})).otherwise(plain)

    out = None
    for pattern, p in families:
        hit = F.regexp(model, F.lit(translate(pattern)))
        out = F.when(hit, struct(p)) if out is None else out.when(hit, struct(p))
    return struct(default) if out is None else out.otherwise(struct(default))


def cost(p: Column) -> Column:
    """A cell's cost, rounded to cents: cache writes by their lifetimes, or all as short ones where only the total is known."""
    split = (F.col("cache_5m_tokens") > 0) | (F.col("cache_1h_tokens") > 0)
    writes = F.when(split, F.col("cache_5m_tokens") * p["cache_5m"] + F.col("cache_1h_tokens") * p["cache_1h"]).otherwise(F.col("cache_total_tokens") * p["cache_5m"])
    return round2((F.col("input_tokens") * p["input"] + F.col("output_tokens") * p["output"] + F.col("cache_read_tokens") * p["cache_read"] + writes) / 1_000_000)


def cost_without_cached(p: Column) -> Column:
    """The variant where cached tokens are part of the input: regular input is what remains, not below 0."""
    regular = F.greatest(F.col("input_tokens") - F.col("cache_read_tokens"), F.lit(0))
    return round2((regular * p["input"] + F.col("output_tokens") * p["output"] + F.col("cache_read_tokens") * p["cache_read"]) / 1_000_000)


def summary(by_user: DataFrame, priced) -> DataFrame:
    """view (total, user, week, user_week), user, week_start and cost. priced makes a cell's cost column.

    The total and the weeks are summed over cells of all users, the users' views over cells of each, so
    the views need not add up: each cell is rounded by itself. Weeks without a start have no week view;
    the blank user has no user view.
    """
    cents = F.sum(F.round(F.col("cost") * 100, 0).cast("long")).alias("c")  # cells are whole cents, so sums are exact
    by_user = written(by_user, "usage-cells")
    whole, named = all_users(by_user).withColumn("cost", priced()), by_user.where("user <> ''").withColumn("cost", priced())
    user, week = F.lit(None).cast("string"), F.col("week_start").cast("long")
    weeks = whole.groupBy("week_start").agg(cents)
    users = written(named.groupBy("user", "week_start").agg(cents), "usage-users")
    weeks = written(weeks, "usage-weeks")
    total = F.coalesce(F.sum("c"), F.lit(0)).alias("c")
    views = [
        weeks.agg(total).select(F.lit("total").alias("view"), user.alias("user"), F.lit(None).cast("long").alias("week_start"), "c"),
        users.groupBy("user").agg(total).select(F.lit("user").alias("view"), "user", F.lit(None).cast("long").alias("week_start"), "c"),
        weeks.where("week_start > 0").select(F.lit("week").alias("view"), user.alias("user"), week.alias("week_start"), "c"),
        users.where("week_start > 0").select(F.lit("user_week").alias("view"), "user", week.alias("week_start"), "c"),
    ]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out.select("view", "user", "week_start", (F.col("c") / 100).alias("cost"))


#: Service tiers that have prices of their own; any other is the default one.
TIERS = ("flex", "priority")


def service_tier(tier: Column) -> Column:
    """A request's tier as its cell has it."""
    t = F.lower(F.trim(tier))
    return F.when(t.isin(*TIERS), t).otherwise(F.lit("default"))
