"""DNS rules over recorded queries and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compile import Context, compile_rule
from .rules import OPTIONS, Default, Logical, Rule, RuleError, leaves

ADDRESS_TYPES = (1, 28, 65)  # A, AAAA, HTTPS


def address_limited(rule: Rule, sets: dict | None = None) -> bool:
    """Whether a rule can only be judged with an answer's addresses."""
    if isinstance(rule, Logical):
        return any(address_limited(r, sets) for r in rule.rules)
    if any(n in rule.fields for n in ("ip_cidr", "ip_is_private", "ip_accept_any")):
        return True
    if rule.fields.get("rule_set_ip_cidr_match_source"):
        return False
    return any("ip_cidr" in leaf.fields for tag in rule.get("rule_set") for leaf in leaves((sets or {})[tag].rules))


def pre_and_final(df: DataFrame, rule: Rule, **kw) -> tuple[Column, Column]:
    """(eligible before the answer, accepted with it) of a rule, where addresses are judged on the answer."""
    x = Context.of(df, **kw)
    pre = compile_rule(Context.of(df, pre=True, **kw), rule)[0]
    final = compile_rule(Context(x.columns, x.sets, x.env, response=True), rule)[0]
    return pre, final


def walk(df: DataFrame, rules, default: str = "default", start: int = 0, **kw) -> DataFrame:
    """server_idx, server and the options of the first rule that is eligible and, if it depends on addresses, accepts the answer.

    Rules that depend on addresses are passed over unless the question is for addresses. A rule that
    rejects the answer leaves the row to the rules after it. start: the rule to begin with, so that a walk
    can go on after a rule whose answer was refused elsewhere. Each of OPTIONS has the value of the last
    route-options rule that matched before the deciding one, or else the deciding rule's own.
    """
    sets, out, hits = kw.get("sets", {}), None, []
    for k, rule in list(enumerate(rules))[start:]:
        pre, final = pre_and_final(df, rule, **kw)
        ok = pre & F.col("query_type").isin(*ADDRESS_TYPES) & final if address_limited(rule, sets) else pre
        if rule.action["action"] == "route-options":
            hits.append((k, ok))
            continue
        out = F.when(ok, F.lit(k)) if out is None else out.when(ok, F.lit(k))
    idx = F.lit(None).cast("int") if out is None else out
    servers = F.array(*[F.lit(r.action.get("server", default)) for r in rules]) if rules else F.array().cast("array<string>")
    d = df.withColumn("server_idx", idx).withColumn("server", F.coalesce(F.get(servers, F.col("server_idx")), F.lit(default)))
    named = [o for o in OPTIONS if any(o in r.action for r in rules)]
    for o in named:
        values = [F.when(F.col("server_idx") == k, F.lit(r.action[o])) for k, r in enumerate(rules) if o in r.action and r.action["action"] != "route-options"]
        values += [F.when(ok & (F.col("server_idx").isNull() | (F.col("server_idx") > k)), F.lit(rules[k].action[o])) for k, ok in reversed(hits) if o in rules[k].action]
        d = d.withColumn(o, F.coalesce(*values))
    return d


def race(evaluations: DataFrame, reads: DataFrame) -> DataFrame:
    """The response that each query gets from its recorded evaluations: query_id, tag, rule_idx, answered_ms and failed.

    evaluations: query_id, tag, completed_ms, ok (an evaluation that failed answers nothing).
    reads: query_id, rule_idx, tag, race, and route if there are routes. Reads stand in rule order; one without race waits for its
    evaluation and everything before it, so later reads count only if it fails. Consecutive racing
    reads commit by completion time, then by rule. A route was started ahead, while what stands before it was still awaited:
    it counts only if all of that failed, and then it is the answer even if it failed itself.
    answered_ms: when the answer was there and all that it waited for had failed.
    """
    reads = reads if "route" in reads.columns else reads.withColumn("route", F.lit(False))
    # A run of racing reads that no waiting read interrupts shares the order of its first rule.
    w = Window.partitionBy("query_id").orderBy("rule_idx")
    runs = reads.withColumn("new", F.when(~F.col("race") | ~F.coalesce(F.lag("race").over(w), F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    at = runs.join(evaluations, ["query_id", "tag"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    earlier = F.max("completed_ms").over(Window.partitionBy("query_id").orderBy("run").rangeBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("answered_ms", F.greatest("completed_ms", earlier)).where(F.col("ok") | F.col("route"))
    best = F.min(F.struct("run", F.when(F.col("race"), F.col("completed_ms")).otherwise(F.lit(0)).alias("t"), "rule_idx", "tag", "answered_ms", (~F.col("ok")).alias("failed"))).alias("b")
    return at.groupBy("query_id").agg(best).select("query_id", "b.tag", "b.rule_idx", "b.answered_ms", "b.failed")


def predefined(df: DataFrame, records: list[dict]) -> Column:
    """The fixed answer of a rule as an array of (name, type, rdata); an owner of `*` is the question's name."""
    row = lambda r: F.struct((F.col("qname") if r["name"] == "*" else F.lit(r["name"])).alias("name"), F.lit(r["type"]).alias("type"), F.lit(r["rdata"]).alias("rdata"))
    return F.array(*map(row, records))


def mode(rules, sets: dict | None = None) -> str:
    """`legacy`, `current` or `either`: address rules without match_response need the legacy mode, evaluate, respond and match_response forbid it."""
    legacy = any(address_limited(r, sets) and not _responds(r) for r in rules)
    current = any(r.action["action"] in ("evaluate", "respond") or _responds(r) for r in rules)
    if legacy and current:
        raise RuleError("rules that need the legacy mode are mixed with rules that forbid it")
    return "legacy" if legacy else "current" if current else "either"


def _responds(rule: Rule) -> bool:
    return any(isinstance(leaf, Default) and leaf.fields.get("match_response") for leaf in leaves([rule]))


def fold(df: DataFrame, rules, **kw) -> DataFrame:
    """Current mode over recorded answers; df has responses, a MAP from tag to STRUCT<rcode INT, addresses ARRAY>.

    An `evaluate` rule that matches makes its tag's answer readable for the rules after it; rules with
    match_response read the tag that they name (or the last evaluated one without a name). The first
    `respond` or `route` rule that matches decides. Adds decided_idx (null: none) and respond_tag.
    """
    cols, out, last = df.columns, df.withColumn("decided_idx", F.lit(None).cast("int")).withColumn("_armed", F.expr("cast(array() as array<string>)")), ""
    for k, rule in enumerate(rules):
        tag = next((leaf.fields.get("match_response_tag", "") for leaf in leaves([rule]) if leaf.fields.get("match_response")), None)
        if tag is not None:
            answer = F.element_at("responses", F.lit(tag or last))
            there = F.array_contains("_armed", tag or last) & answer.isNotNull()
            out = out.withColumns({"response": there, "response_rcode": answer["rcode"], "response_addresses": answer["addresses"]})
        m = F.col("decided_idx").isNull() & compile_rule(Context.of(out, **kw), rule)[0]
        if rule.action["action"] == "evaluate":
            last = rule.action.get("tag", "")
            out = out.withColumn("_armed", F.when(m, F.array_append("_armed", F.lit(last))).otherwise(F.col("_armed")))
        elif rule.action["action"] in ("respond", "route"):
            out = out.withColumn("decided_idx", F.when(m, F.lit(k)).otherwise(F.col("decided_idx")))
    tags = F.array(*[F.lit(r.action.get("tag")).cast("string") for r in rules]) if rules else F.array().cast("array<string>")
    return out.select(*cols, "decided_idx", F.get(tags, F.col("decided_idx")).alias("respond_tag"))
