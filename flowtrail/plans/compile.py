"""Rules compiled to Columns.

A rule compiles to a pair of booleans. `matched` says whether it matches; `open` says that the match
hinges on destination prefixes that cannot be judged yet, which only happens when a DNS rule is asked
before there is an answer (`pre`). An inverted rule matches if it isn't matched or if it is open. All
booleans are never null: a missing input is false before any inversion.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from ..functions.regex import translate
from ..functions.scalar import basename
from .rules import Default, Logical, Rule, RuleError, RuleSet, port_bounds

GROUPS = ("source_address", "source_port", "destination_address", "destination_port")


@dataclass(frozen=True)
class Context:
    """What rules are compiled against.

    columns: the table's columns by name; a field without a column is missing in every row. sets: rule
    sets by tag. env: properties of the machine that rules can ask for (clash_mode, network_type,
    network_is_expensive, network_is_constrained, wifi_ssid, wifi_bssid, interfaces, preferred).
    pre: asked before an answer. response: addresses come from the answer.
    """

    columns: dict[str, T.DataType]
    sets: dict[str, RuleSet] = field(default_factory=dict)
    env: dict = field(default_factory=dict)
    pre: bool = False
    response: bool = False
    match_source: bool = False
    accept_empty: bool = False

    @classmethod
    def of(cls, df: DataFrame, **kw) -> Context:
        return cls({f.name: f.dataType for f in df.schema}, **kw)

    def has(self, name: str) -> bool:
        return name in self.columns

    def long(self, name: str) -> bool:
        kind = self.columns.get(name)
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return isinstance(kind, (T.LongType, T.IntegerType))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def all_of(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def host(x: Context) -> Column:
    """The lower-cased domain, or else the destination's name; empty if there is neither."""
    found = [F.when(F.col(c) != "", F.col(c)) for c in ("domain", "fqdn", "host") if x.has(c)]
    return F.lower(F.coalesce(*found, F.lit("")))


def suffix_match(h: Column, suffix: str) -> Column:
    """`.x` is a plain suffix; `x` matches x itself and what ends in .x."""
    s = suffix.lower()
    return F.endswith(h, F.lit(s)) if s.startswith(".") else (h == s) | F.endswith(h, F.lit("." + s))


def _in(x: Context, column: str, values: list) -> Column:
    return sure(F.col(column).isin(values)) if x.has(column) else F.lit(False)


def _search(c: Column, patterns: list[str]) -> Column:
    return sure(F.regexp(c, F.lit("|".join(f"(?:{translate(p)})" for p in patterns))))


def _ports(x: Context, column: str, ranges: list[str]) -> Column:
    if not x.has(column):
        return F.lit(False)
    return sure(any_of([F.col(column).between(*port_bounds(r)) for r in ranges]))


def _source(x: Context, test) -> Column:
    return sure(test(F.col("src_ip"), x.long("src_ip"))) if x.has("src_ip") else F.lit(False)


def _destination(x: Context, test, accept_empty: bool) -> Column:
    """test over what stands for the destination: the answer's addresses, the address, or any resolved address."""
    empty = F.lit(accept_empty)

    def some(column: str) -> Column:
        return sure(F.exists(F.col(column), lambda a: sure(test(a, x.long(column)))))

    def known(column: str) -> Column:
        return sure(F.size(column) > 0)

    if x.response:
        return F.when(known("response_addresses"), some("response_addresses")).otherwise(empty) if x.has("response_addresses") else empty
    out = F.when(known("addresses"), some("addresses")).otherwise(empty) if x.has("addresses") else empty
    return F.when(F.col("dst_ip").isNotNull(), sure(test(F.col("dst_ip"), x.long("dst_ip")))).otherwise(out) if x.has("dst_ip") else out


def _records(x: Context, column: str, expected: list[dict]) -> Column:
    """Whether any expected record (name, type, class, rdata) is in the section, whatever its TTL."""
    if not x.has(column):
        return F.lit(False)
    same = lambda r, e: all_of([r[k] == F.lit(e[k]) for k in ("name", "type", "class", "rdata") if k in e])
    return sure(F.exists(F.col(column), lambda r: any_of([sure(same(r, e)) for e in expected])))


def _overlaps(prefixes: list[str], others: list[str]) -> bool:
    a, b = [net.prefix_range(p) for p in prefixes], [net.prefix_range(p) for p in others]
    return any(v == w and lo <= hi2 and lo2 <= hi for v, lo, hi in a for w, lo2, hi2 in b)


def _environment(x: Context, name: str, want) -> bool:
    """Conditions on the machine, which are the same for all rows."""
    env, interfaces = x.env, x.env.get("interfaces", [])
    if name == "clash_mode":
        return str(env.get(name, "")).lower() == want.lower()
    if name in ("network_type", "wifi_ssid", "wifi_bssid"):
        return env.get(name) in want
    if name in ("network_is_expensive", "network_is_constrained"):
        return bool(env.get(name))
    if name == "interface_address":
        by_name = {i["name"]: i["prefixes"] for i in interfaces}
        return all(n in by_name and _overlaps(by_name[n], p if isinstance(p, list) else [p]) for n, p in want.items())
    if name == "network_interface_address":
        fits = lambda kind, p: any(i["type"] == kind and not i.get("own") and _overlaps(i["prefixes"], p) for i in interfaces)
        return all(fits(kind, p if isinstance(p, list) else [p]) for kind, p in want.items())
    default = next((i for i in interfaces if i.get("default")), None)
    return default is not None and all(_overlaps([p], default["prefixes"]) for p in want)


ENVIRONMENT = ("clash_mode", "network_type", "network_is_expensive", "network_is_constrained", "wifi_ssid", "wifi_bssid", "interface_address", "network_interface_address", "default_interface_address")
SETS = {
    "inbound": "inbound", "auth_user": "auth_user", "protocol": "protocol", "client": "client", "network": "network", "process_path": "process_path",
    "source_mac_address": "src_mac", "source_hostname": "src_hostname", "source_port": "src_port", "port": "dst_port",
}


def _item(x: Context, rule: Default, name: str) -> Column:
    want = rule.fields[name]
    if name in SETS:
        return _in(x, SETS[name], want)
    if name in ENVIRONMENT:
        return F.lit(_environment(x, name, want))
    if name in ("domain", "domain_suffix"):
        h, tests = host(x), []
        if rule.get("domain"):
            tests.append(h.isin([d.lower() for d in rule.get("domain")]))
        tests += [suffix_match(h, s) for s in rule.get("domain_suffix")]
        return (h != "") & any_of(tests)
    if name == "domain_keyword":  # keywords are compared as written
        return any_of([F.contains(host(x), F.lit(k)) for k in want])
    if name == "domain_regex":
        return _search(host(x), want)
    if name == "adguard_domain":
        from ..sources.filterlist import line_regex

        return _search(host(x), [line_regex(w) for w in want])
    if name == "source_ip_cidr":
        return _source(x, lambda a, lng: net.contains(net.merged(want), a, lng))
    if name == "source_ip_is_private":
        return _source(x, net.not_public)
    if name == "ip_cidr":
        test = lambda a, lng: net.contains(net.merged(want), a, lng)
        return _source(x, test) if x.match_source else _destination(x, test, x.accept_empty)
    if name == "ip_is_private":
        return _destination(x, net.not_public, False)
    if name == "ip_accept_any":
        return _destination(x, lambda a, lng: a.isNotNull(), False)
    if name == "ip_version":
        six, tests = int(want) == 6, []
        if x.has("ip_version"):
            tests.append((F.col("ip_version") != 0) & ((F.col("ip_version") == 6) == F.lit(six)))
        if x.has("dst_ip"):
            tests.append(net.is_v6(F.col("dst_ip"), x.long("dst_ip")) == F.lit(six))
        return any_of([sure(t) for t in tests]) if tests else F.lit(False)
    if name in ("port_range", "source_port_range"):
        return _ports(x, "dst_port" if name == "port_range" else "src_port", want)
    if name == "outbound":
        return sure(F.col("outbound") != "") if "any" in want and x.has("outbound") else _in(x, "outbound", want)
    if name == "user":
        return _in(x, "user", want)
    if name == "user_id":
        return _in(x, "user_id", [w for w in want if w != -1])
    if name == "process_name":
        return sure(basename(F.col("process_path")).isin(want)) if x.has("process_path") else F.lit(False)
    if name == "process_path_regex":
        return _search(F.col("process_path"), want) if x.has("process_path") else F.lit(False)
    if name == "package_name":
        return sure(F.arrays_overlap("packages", F.array(*map(F.lit, want)))) if x.has("packages") else F.lit(False)
    if name == "package_name_regex":
        return sure(F.exists("packages", lambda p: _search(p, want))) if x.has("packages") else F.lit(False)
    if name == "query_type":
        return _in(x, "query_type", [w for w in want if w != 0])
    if name == "query_client_subnet":
        if not x.has("subnet_ip"):
            return F.lit(False)
        inside = lambda p: net.contains([net.prefix_range(p)], F.col("subnet_ip"), x.long("subnet_ip")) & (F.col("subnet_bits") >= int(p.partition("/")[2] or (32 if ":" not in p else 128)))
        return any_of([sure(inside(p)) for p in want])
    if name == "query_dnssec":
        return sure(F.col("query_dnssec")) if x.has("query_dnssec") else F.lit(False)
    if name == "response_rcode":
        return sure(F.col("response_rcode") == want) if x.has("response_rcode") else F.lit(False)
    if name in ("response_answer", "response_ns", "response_extra"):
        return _records(x, name, want)
    if name == "preferred_by" and x.has("preferred"):  # the tags that prefer the row, by operators/enrich.py
        return sure(F.arrays_overlap("preferred", F.array(*map(F.lit, want))))
    if name == "preferred_by":
        preferred = [d for tag in want for d in x.env.get("preferred", {}).get(tag, ())]
        return any_of([suffix_match(host(x), d) for d in preferred]) if preferred else F.lit(False)
    raise RuleError(f"unknown field: {name}")


#: Fields by the group in which one match is enough; all others must match each.
IN_GROUP = {
    "domain": "destination_address", "domain_keyword": "destination_address", "domain_regex": "destination_address", "adguard_domain": "destination_address",
    "source_ip_cidr": "source_address", "source_ip_is_private": "source_address", "source_port": "source_port", "source_port_range": "source_port", "port": "destination_port", "port_range": "destination_port",
}
DESTINATION = ("ip_cidr", "ip_is_private", "ip_accept_any")


def _groups(x: Context, rule: Default) -> tuple[Column, dict[str, Column], bool]:
    """(all ungrouped fields match, group -> satisfied for the groups that the rule asks for, open)."""
    items, groups = [], {}
    names = ["domain" if n == "domain_suffix" else n for n in rule.fields if n not in ("rule_set",) and not n.startswith("rule_set_") and n not in ("match_response", "match_response_tag", "race")]
    for name in dict.fromkeys(names):
        if name in DESTINATION:
            continue
        c = _item(x, rule, name if name in rule.fields else "domain_suffix")
        if name in IN_GROUP:
            groups.setdefault(IN_GROUP[name], []).append(c)
        else:
            items.append(c)
    addresses = "destination_address" in groups
    later = [n for n in rule.fields if n in DESTINATION]
    if later and (x.match_source or not x.pre):
        groups.setdefault("source_address" if x.match_source else "destination_address", []).extend(_item(x, rule, n) for n in later)
    return all_of(items), {g: any_of(cs) for g, cs in groups.items()}, bool(later) and x.pre and not x.match_source and not addresses


def _mergeable(rule_set: RuleSet) -> Default | None:
    """A set's only rule, if its groups can be joined with those of the rule that uses the set."""
    if len(rule_set.rules) == 1 and isinstance(rule_set.rules[0], Default) and not rule_set.rules[0].invert:
        return rule_set.rules[0]
    return None


def compile_rule(x: Context, rule: Rule) -> tuple[Column, Column]:
    """(matched, open) of a rule."""
    if isinstance(rule, Logical):
        parts = [compile_rule(x, r) for r in rule.rules]
        if rule.mode == "and":
            matched, held = all_of([m for m, _ in parts]), any_of([d for _, d in parts])
        else:
            matched, held = any_of([m for m, _ in parts]), ~any_of([m & ~d for m, d in parts])
        return _inverted(matched, matched & held) if rule.invert else (matched, matched & held)
    if rule.fields.get("match_response") and not x.pre:
        x = replace(x, response=True)
        present = sure(F.col("response")) if x.has("response") else F.lit(False)
        m, d = _default(x, rule)
        return F.when(present, m).otherwise(F.lit(rule.invert)), d
    if rule.fields.get("match_response"):
        return F.lit(False), F.lit(False)
    return _default(x, rule)


def _default(x: Context, rule: Default) -> tuple[Column, Column]:
    items, groups, mine = _groups(x, rule)
    if "rule_set" in rule.fields:
        matched, held = _with_sets(x, rule, groups, mine)
        matched = items & matched
        if "destination_address" in groups:
            held = held & ~groups["destination_address"]
        held = matched & held
    else:
        if rule.empty:
            return F.lit(True), F.lit(False)
        matched, held = items & all_of(list(groups.values())), F.lit(mine)
        held = matched & held
    return _inverted(matched, held) if rule.invert else (matched, held)


def _inverted(matched: Column, held: Column) -> tuple[Column, Column]:
    return ~matched | held, held


def _with_sets(x: Context, rule: Default, outer: dict[str, Column], mine: bool) -> tuple[Column, Column]:
    """A rule's sets are tried one by one. A set with a single plain rule shares its groups with the rule."""
    inside = replace(x, match_source=bool(rule.fields.get("rule_set_ip_cidr_match_source")), accept_empty=bool(rule.fields.get("rule_set_ip_cidr_accept_empty")))
    done = all_of(list(outer.values()))
    tried: list[tuple[Column, Column, Column]] = []  # matched, open, the rule's own open part if this one decides
    for tag in rule.fields["rule_set"]:
        if tag not in x.sets:
            raise RuleError(f"rule set not found: {tag}")
        only = _mergeable(x.sets[tag])
        if only is not None:
            items, groups, later = _groups(inside, only)
            joined = {g: any_of([c[g] for c in (outer, groups) if g in c]) for g in {*outer, *groups}}
            met = joined.get("destination_address", F.lit(False))
            tried.append((items & all_of(list(joined.values())), F.lit(later) & ~met, F.lit(mine) & ~met))
        else:
            m, d = any_rule(inside, x.sets[tag].rules)
            tried.append((done & m, d, F.lit(mine)))
    matched, held = any_of([m for m, _, _ in tried]), F.lit(True)
    for m, d, own in reversed(tried):
        held = F.when(m & ~d, own).otherwise(held)
    return matched, held


def any_rule(x: Context, rules) -> tuple[Column, Column]:
    """Whether any rule of a set matches; a set without rules never does."""
    parts = [compile_rule(x, r) for r in rules]
    if not parts:
        return F.lit(False), F.lit(False)
    matched = any_of([m for m, _ in parts])
    return matched, matched & ~any_of([m & ~d for m, d in parts])


def predicate(df: DataFrame, rule: Rule, **kw) -> Column:
    """Whether a rule matches a row of df."""
    return compile_rule(Context.of(df, **kw), rule)[0]
