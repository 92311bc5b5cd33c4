"""Ordered evaluation of rules: the first that decides wins.

Up to CASE_RULES rules are one CASE expression, which Spark evaluates lazily in one pass over the
table, without a shuffle. Longer lists of plain lookups are joined instead (operators/lookup.py) and the
least rule number wins. Actions that change the row (route-options, sniff, resolve) split the list into
stages, as later rules see the changed row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compile import Context, compile_rule
from .rules import Rule, describe

CASE_RULES = 200
DECIDING = ("route", "reject", "hijack-dns")


def decides(rule: Rule) -> bool:
    """Bypass decides only with an outbound; what isn't here goes on to the next rule."""
    action = rule.action["action"]
    return action in DECIDING or action == "bypass" and bool(rule.action.get("outbound"))


def _first(cases: list[tuple[Column, int]]) -> Column:
    out = None
    for condition, k in cases:
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def matches(df: DataFrame, rules, **kw) -> DataFrame:
    """Every (row, rule) that matches, not only the first: df's columns and rule_idx."""
    x = Context.of(df, **kw)
    hits = F.array_compact(F.array(*[F.when(compile_rule(x, r)[0], F.lit(k)) for k, r in enumerate(rules)])) if rules else F.expr("cast(array() as array<int>)")
    return df.withColumn("_hits", hits).select(*df.columns, F.explode("_hits").alias("rule_idx"))


def route(df: DataFrame, rules, default: str = "direct", sniff: Callable[[DataFrame], DataFrame] | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None, **kw) -> DataFrame:
    """df with rule_idx (null: none), action, outbound and rule of the first deciding rule.

    sniff and resolve fill in columns of the rows that such rules match, before the rules after them are
    asked; route-options replaces the destination and, with an address, forgets resolved addresses.
    """
    out = df.withColumn("rule_idx", F.lit(None).cast("int"))
    cases: list[tuple[Column, int]] = []

    def settle(d: DataFrame) -> DataFrame:
        nonlocal cases
        if cases:
            d, cases = d.withColumn("rule_idx", F.coalesce("rule_idx", _first(cases))), []
        return d

    for k, rule in enumerate(rules):
        action = rule.action
        if decides(rule):
            if len(cases) >= CASE_RULES:  # a longer CASE does not compile
                out = settle(out)
            cases.append((compile_rule(Context.of(out, **kw), rule)[0], k))
            continue
        if action["action"] not in ("route-options", "sniff", "resolve", "bypass"):
            continue
        if action["action"] in ("route-options", "bypass") and not OVERRIDES & set(action):
            continue
        out = settle(out)
        hit = F.col("rule_idx").isNull() & compile_rule(Context.of(out, **kw), rule)[0]
        if action["action"] in ("sniff", "resolve"):
            fill = sniff if action["action"] == "sniff" else resolve
            if fill is not None:
                filled = fill(out.withColumn("_hit", hit))
                out = filled.drop("_hit")
            continue
        out = overridden(out, hit, action)
    out = settle(out)
    # What decides a row changes it too; only rows that it decides, so the order of these does not matter.
    for k, rule in enumerate(rules):
        if decides(rule) and OVERRIDES & set(rule.action):
            out = overridden(out, F.coalesce(F.col("rule_idx") == k, F.lit(False)), rule.action)
    return named(out, rules, default)


OVERRIDES = {"override_address", "override_port"}


def overridden(df: DataFrame, hit: Column, action: dict) -> DataFrame:
    """df with the destination that an action names, in the rows it hits."""
    changed = {}
    if "override_address" in action:
        changed["dst_ip"] = F.when(hit, F.lit(action["override_address"]).cast(df.schema["dst_ip"].dataType)).otherwise(F.col("dst_ip"))
        if "addresses" in df.columns:
            changed["addresses"] = F.when(~hit, F.col("addresses"))
    if "override_port" in action:
        changed["dst_port"] = F.when(hit, F.lit(action["override_port"])).otherwise(F.col("dst_port"))
    return df.withColumns(changed)


def named(df: DataFrame, rules, default: str) -> DataFrame:
    """Adds action, outbound and rule to rows with rule_idx. Where no rule decided, the default outbound is used; reject and hijack-dns have none."""
    table = [(r.action["action"], r.action.get("outbound") or (default if r.action["action"] == "route" else None), describe(r)) for r in rules]
    look = lambda i, other: F.when(F.col("rule_idx").isNull(), F.lit(other)).otherwise(F.get(F.array(*[F.lit(t[i]).cast("string") for t in table]), F.col("rule_idx"))) if table else F.lit(other)
    return df.withColumns({"action": look(0, "route"), "outbound": look(1, default), "rule": look(2, "")})


def pre_match(df: DataFrame, rules, **kw) -> DataFrame:
    """The verdict on packets before a connection: route and bypass with an outbound continue as flows, reject and drop end, other rules are passed over."""
    out = route(df, rules, **kw)
    method = F.get(F.array(*[F.lit(r.action.get("method", "default")) for r in rules]), F.col("rule_idx")) if rules else F.lit("default")
    verdict = F.when(F.col("rule_idx").isNull(), "continue").when(F.col("action") == "reject", F.when(method == "drop", "drop").otherwise("reject")).when(F.col("action") == "bypass", "bypass").when(F.col("action") == "hijack-dns", "continue").otherwise("flow")
    return out.withColumn("verdict", verdict)


def by_lookup(df: DataFrame, rules, row_id: str, default: str = "direct") -> DataFrame:
    """route() by joins, for long lists of rules that each ask for one kind of thing: row_id, rule_idx, action, outbound, rule.

    Every condition of every rule becomes a row of a lookup table: values are found by equality, domain
    suffixes by the host's labels, prefixes and port ranges by buckets. The least rule number wins. The
    cost follows the rows' matches, not the number of rules.
    """
    from ..functions.net import prefix_range
    from ..operators.lookup import range_join, small, suffix_join
    from .compile import SETS
    from .rules import RuleError, port_bounds

    spark, equal, suffixes, ranges, ports = df.sparkSession, [], [], [], []
    for k, rule in enumerate(rules):
        names = set(getattr(rule, "fields", {}))
        if not names or rule.invert or len(names) > 1 and not names <= {"domain", "domain_suffix", "ip_cidr"} and not names <= {"port", "port_range"}:
            raise RuleError(f"rule {k} is no plain lookup")
        if not decides(rule):
            continue
        for name in names:
            if name == "domain_suffix":
                suffixes += [(v, k) for v in rule.get(name)]
            elif name == "ip_cidr":
                ranges += [(lo, hi, k) for _, lo, hi in map(prefix_range, rule.get(name))]
            elif name == "port_range":
                ports += [(*port_bounds(v), k) for v in rule.get(name)]
            elif name == "domain":
                equal += [("host", v.lower(), k) for v in rule.get(name)]
            elif name in SETS:
                equal += [(SETS[name], str(v), k) for v in rule.get(name)]
            else:
                raise RuleError(f"rule {k} is no plain lookup")
    hits = []
    if equal:
        table = spark.createDataFrame(equal, "field string, value string, idx int").groupBy("field", "value").agg(F.min("idx").alias("idx"))
        fields = sorted({f for f, _, _ in equal})
        values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.lower(f) if f == "host" else F.col(f).cast("string")).alias("value")) for f in fields]))
        hits.append(df.select(row_id, values.alias("v")).select(row_id, "v.*").join(small(table), ["field", "value"]).select(row_id, "idx"))
    if suffixes:
        hits.append(suffix_join(df.select(row_id, "host"), spark.createDataFrame(suffixes, "suffix string, idx int")).select(row_id, "idx"))
    if ranges:
        hits.append(range_join(df.select(row_id, "dst_ip"), spark.createDataFrame(ranges, "lo long, hi long, idx int"), "dst_ip").select(row_id, "idx"))
    if ports:
        # A port range touches 256 buckets of 256 ports at most.
        low = F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8)))
        table = spark.createDataFrame(ports, "lo int, hi int, idx int").where("lo <= hi").select("*", low.alias("bucket"))
        hits.append(df.select(row_id, "dst_port", F.shiftright("dst_port", 8).alias("bucket")).join(small(table), "bucket").where(F.col("dst_port").between(F.col("lo"), F.col("hi"))).select(row_id, "idx"))
    best = None
    for h in hits:
        best = h if best is None else best.unionByName(h)
    out = df.select(row_id)
    if best is None:
        return named(out.withColumn("rule_idx", F.lit(None).cast("int")), rules, default)
    return named(out.join(best.groupBy(row_id).agg(F.min("idx").alias("rule_idx")), row_id, "left"), rules, default)
