"""Traffic accounting over recorded connections: totals, counters, changelogs, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, written
from .slices import chain, running

RETAINED = 1000
CLOSED_MAX_AGE_MS = 5 * 60 * 1000
COLUMNS = ("id", "inbound", "network", "source", "destination", "domain", "protocol", "user", "rule", "outbound", "chain", "uplink", "downlink", "created")
DEFAULT_COLUMNS = ("id", "network", "source", "destination", "outbound", "created")


def totals(connections: DataFrame) -> DataFrame:
    """Upload and download over every connection, closed and evicted ones included."""
    return connections.agg(F.coalesce(F.sum("upload"), F.lit(0)).alias("upload"), F.coalesce(F.sum("download"), F.lit(0)).alias("download"))


def counters(connections: DataFrame, inbounds=(), outbounds=(), users=()) -> DataFrame:
    """name and value of the counters of configured tags; blank tags are never counted.

    One row for each connection becomes up to six, and partial sums leave one for each counter and
    task before the shuffle.
    """
    sides = []
    for kind, column, tags in (("inbound", "inbound", inbounds), ("outbound", "outbound", outbounds), ("user", "auth_user", users)):
        if not tags or column not in connections.columns:
            continue
        counted = F.col(column).isin([t for t in tags if t])
        for link, value in (("uplink", "upload"), ("downlink", "download")):
            name = F.concat(F.lit(f"{kind}>>>"), F.col(column), F.lit(f">>>traffic>>>{link}"))
            sides.append(F.when(counted, F.struct(name.alias("name"), F.col(value).alias("value"))))
    if not sides:
        return connections.sparkSession.createDataFrame([], "name string, value long")
    return connections.select(F.explode(F.array_compact(F.array(*sides))).alias("c")).groupBy(F.col("c.name").alias("name")).agg(F.sum("c.value").alias("value"))


def query_counters(counted: DataFrame, patterns=(), regex: bool = False) -> DataFrame:
    """Counters by pattern: all without patterns; one that fits k patterns is returned k times."""
    if not patterns:
        return counted
    fits = [F.regexp("name", F.lit(p)) if regex else F.contains("name", F.lit(p)) for p in patterns]
    hits = F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)]))
    return counted.select("name", "value", F.explode(hits).alias("_k")).drop("_k")


def user_stats(connections: DataFrame) -> DataFrame:
    """Bytes, packets (UDP only) and sessions for each user; the blank user counts as one."""
    udp = F.col("network") == "udp"
    packets = lambda c: F.coalesce(F.sum(F.when(udp, F.col(c))), F.lit(0)) if c in connections.columns else F.lit(0).cast("long")
    return connections.groupBy(F.coalesce("auth_user", F.lit("")).alias("user")).agg(
        F.sum("upload").alias("uplink_bytes"), F.sum("download").alias("downlink_bytes"), packets("upload_packets").alias("uplink_packets"), packets("download_packets").alias("downlink_packets"),
        F.sum(F.when(~udp, 1).otherwise(0)).alias("tcp_sessions"), F.sum(F.when(udp, 1).otherwise(0)).alias("udp_sessions"),
    )


def with_all_users(stats: DataFrame) -> DataFrame:
    """user_stats() and one row more, without a user: the sums over every user, the blank one included."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns if c != "user"]
    return stats.unionByName(stats.agg(*sums).withColumn("user", F.lit(None).cast("string")))


def one_counter(counted: DataFrame, name: str) -> DataFrame:
    """name and value of one counter; where it isn't counted, reading the row is an error."""
    value = counted.where(F.col("name") == name).agg(F.max("value").alias("value"))
    return value.select(F.lit(name).alias("name"), F.coalesce("value", F.raise_error(F.lit(f"no such counter: {name}")).cast("long")).alias("value"))


def counter(counted: DataFrame, name: str) -> int:
    """The value of one counter; a name that isn't counted is an error."""
    found = counted.where(F.col("name") == name).limit(1).collect()
    if not found:
        raise KeyError(f"no such counter: {name}")
    return found[0].value


def pruned(stats: DataFrame, users: DataFrame) -> DataFrame:
    """Only the users that are listed (column user)."""
    return stats.join(users.select("user").distinct(), "user", "left_semi")


def per_tick(connections: DataFrame, seconds: int = 1) -> DataFrame:
    """Upload and download of each tick, with the running total and its change since the tick before.

    Rows are first summed by tick, and ticks by day, so that the running sum over all time goes over days only.
    """
    tick = F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / seconds) * seconds
    by_tick = connections.groupBy(tick.alias("tick")).agg(F.sum("upload").alias("up"), F.sum("download").alias("down")).withColumn("day", F.floor(F.col("tick") / 86400))
    by_day = by_tick.groupBy("day").agg(F.sum("up").alias("day_up"), F.sum("down").alias("day_down"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = by_day.select("day", F.coalesce(F.sum("day_up").over(earlier), F.lit(0)).alias("base_up"), F.coalesce(F.sum("day_down").over(earlier), F.lit(0)).alias("base_down"))
    inside = Window.partitionBy("day").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    out = by_tick.withColumns({"run_up": F.sum("up").over(inside), "run_down": F.sum("down").over(inside)}).join(base, "day")
    return out.select("tick", "up", "down", (F.col("base_up") + F.col("run_up")).alias("total_up"), (F.col("base_down") + F.col("run_down")).alias("total_down"))


def deltas(samples: DataFrame, key: str, order: str, columns: list[str], wraps: list[str] = ()) -> DataFrame:
    """Differences of counters between a key's consecutive samples; those in `wraps` are unsigned 32-bit. The first sample has none."""
    w = Window.partitionBy(key).orderBy(order)
    change = lambda c: F.col(c) - F.lag(c).over(w)
    return samples.withColumns({f"{c}_delta": F.pmod(change(c), F.lit(1 << 32)) if c in wraps else change(c) for c in columns})


def change_events(samples: DataFrame) -> DataFrame:
    """UPDATE events from samples (id, ts, upload, download) of running totals.

    A change gives its deltas; the first sample without one after traffic gives a single zero. A counter
    that went back is a reset: it gives a zero if there was traffic before, and counts from there.
    """
    w = Window.partitionBy("id").orderBy("ts")
    up, down = F.col("upload") - F.coalesce(F.lag("upload").over(w), F.lit(0)), F.col("download") - F.coalesce(F.lag("download").over(w), F.lit(0))
    d = samples.withColumns({"up_delta": up, "down_delta": down})
    reset, moved = (F.col("up_delta") < 0) | (F.col("down_delta") < 0), (F.col("up_delta") > 0) | (F.col("down_delta") > 0)
    d = d.withColumn("had", ~reset & moved)
    before = F.coalesce(F.lag("had").over(w), F.lit(False))
    d = d.withColumn("emit", F.col("had") | before)
    return d.where("emit").select("id", "ts", F.when(F.col("had"), F.col("up_delta")).otherwise(0).alias("up_delta"), F.when(F.col("had"), F.col("down_delta")).otherwise(0).alias("down_delta"))


def apply_changes(events: DataFrame, now_ms: int | None = None) -> DataFrame:
    """The state of each connection after its events (id, seq, type NEW/UPDATE/CLOSED, ts_ms, up_delta, down_delta).

    NEW replaces what was there, UPDATE adds and sets the current rate, CLOSED freezes and zeroes the rate;
    updates of unknown connections are ignored. Closed ones older than five minutes at now_ms are left out.
    Partial aggregates and one join, so a connection with very many events is in many tasks.
    """
    started = events.where("type = 'NEW'").groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_from"))
    e = events.join(small(started), F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") >= F.col("_from")))
    update, closed = F.col("type") == "UPDATE", F.col("type") == "CLOSED"
    state = e.groupBy("id").agg(
        F.sum(F.when(~closed, F.col("up_delta")).otherwise(0)).alias("uplink_total"), F.sum(F.when(~closed, F.col("down_delta")).otherwise(0)).alias("downlink_total"),
        F.max_by(F.when(update, F.col("up_delta")).otherwise(0), "seq").alias("uplink"), F.max_by(F.when(update, F.col("down_delta")).otherwise(0), "seq").alias("downlink"),
        F.min(F.when(F.col("type") == "NEW", F.col("ts_ms"))).alias("created_ms"), F.max_by(F.when(closed, F.col("ts_ms")), F.when(closed, F.col("seq"))).alias("closed_ms"),
    )
    return state if now_ms is None else state.where(F.col("closed_ms").isNull() | (F.lit(now_ms) - F.col("closed_ms") <= CLOSED_MAX_AGE_MS))


def idle_gaps(activity: DataFrame, key: str, at: str = "ts", gap_s: float = 5, ignore_s: float = 1) -> DataFrame:
    """Breaks of a key's activity: at, idle_ms where an activity follows the last refresh by gap_s or more.

    Touches within ignore_s of the last refresh do not refresh, so refreshes are a chain: each is followed by the first
    touch that is ignore_s after it or more (operators/slices.py). Equal times are one touch.
    """
    touches = activity.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms")).distinct()
    ignored = max(int(ignore_s * 1000), 1)
    on = written(chain(touches.withColumn("until", F.col("ms") + ignored), "key", "ms", "until").where("counts").select("key", "ms"), "refreshes")
    named = on.select("key", "ms", F.struct(F.coalesce("key", F.lit("0").cast(on.schema["key"].dataType)).alias("of"), F.col("key").isNull().alias("none")).alias("k"))
    idle = running(named, ["k"], "ms", [], "ms", "before", itself=False)
    return idle.where(F.col("ms") - F.col("before") >= int(gap_s * 1000)).select("key", F.col("ms").alias("at_ms"), (F.col("ms") - F.col("before")).alias("idle_ms"))


def recent_closed(connections: DataFrame, n: int = RETAINED) -> DataFrame:
    """The last n closed connections; ties by id, largest first."""
    return connections.where(F.col("closed_at").isNotNull()).orderBy(F.desc("closed_at"), F.desc("id")).limit(n)


ORDERS = {"date": ("created_at",), "traffic": ("uplink", "downlink"), "total": ("upload", "download")}


def top(connections: DataFrame, by: str = "total", n: int | None = None) -> DataFrame:
    """Connections by date, current or total traffic, largest first; ties by id, largest first."""
    if by not in ORDERS:
        raise ValueError(f"unknown order: {by}")
    key = F.col(ORDERS[by][0]) if len(ORDERS[by]) == 1 else F.col(ORDERS[by][0]) + F.col(ORDERS[by][1])
    out = connections.orderBy(key.desc(), F.desc("id"))
    return out if n is None else out.limit(n)


def in_state(connections: DataFrame, state: str) -> DataFrame:
    where = {"all": F.lit(True), "active": F.col("closed_at").isNull(), "closed": F.col("closed_at").isNotNull()}
    if state not in where:
        raise ValueError(f"unknown state: {state}")
    return connections.where(where[state])


def without_dns(connections: DataFrame) -> DataFrame:
    return connections.where(F.coalesce(F.col("outbound_type") != "dns", F.lit(True)))


def listed(connections: DataFrame, columns=DEFAULT_COLUMNS) -> DataFrame:
    """The named columns, by creation; a name that isn't one of COLUMNS is an error."""
    for c in columns:
        if c not in COLUMNS:
            raise ValueError(f"unknown column: {c}")
    return connections.orderBy("created", "id").select(*columns)


def last_lines(log: DataFrame, n: int, level: str | None = None) -> DataFrame:
    """The last n log lines by seq, of one level if one is named."""
    return (log.where(F.col("level") == level) if level else log).orderBy(F.desc("seq")).limit(n)


def default_first(proxies: DataFrame, default: str) -> DataFrame:
    """Tags in their order, the default one first."""
    return proxies.orderBy((F.col("tag") == default).desc(), "ordinal")
