"""Rules as data: a strict parser and validator for rule lists and rule sets.

A default rule is a set of field lists with an optional inversion; a logical rule joins rules by and/or.
Nothing here touches Spark; compile.py turns rules into Columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

#: Fields of rule sets by the version that brought them in; others are in version 1.
SINCE = {"network_type": 3, "network_is_expensive": 3, "network_is_constrained": 3, "network_interface_address": 4, "default_interface_address": 4, "package_name_regex": 5}
CURRENT_VERSION = 5
MAX_DEPTH = 100

LISTS = (
    "query_type", "network", "domain", "domain_suffix", "domain_keyword", "domain_regex", "source_ip_cidr", "ip_cidr", "source_port", "source_port_range", "port", "port_range",
    "process_name", "process_path", "process_path_regex", "package_name", "package_name_regex", "network_type", "wifi_ssid", "wifi_bssid", "default_interface_address", "adguard_domain",
)
FLAGS = ("network_is_expensive", "network_is_constrained")
MAPS = ("network_interface_address",)
#: What rules outside of rule sets can ask for as well.
ROUTE_LISTS = ("inbound", "auth_user", "protocol", "client", "user", "user_id", "outbound", "source_mac_address", "source_hostname", "preferred_by", "rule_set", "response_answer", "response_ns", "response_extra", "query_client_subnet")
ROUTE_FLAGS = ("source_ip_is_private", "ip_is_private", "ip_accept_any", "query_dnssec", "match_response", "rule_set_ip_cidr_match_source", "rule_set_ip_cidr_accept_empty", "race")
ROUTE_VALUES = ("ip_version", "clash_mode", "response_rcode", "match_response_tag")
ROUTE_MAPS = ("interface_address",)
REMOVED = ("geosite", "geoip", "source_geoip")
ACTIONS = ("route", "route-options", "evaluate", "respond", "direct", "bypass", "reject", "hijack-dns", "sniff", "resolve", "predefined")
#: What route-options of DNS rules set for the query that follows.
OPTIONS = ("disable_cache", "rewrite_ttl", "client_subnet")
FINAL = ("route", "reject", "hijack-dns", "direct")
#: Fields that modify others and are no condition by themselves.
MODIFIERS = ("rule_set_ip_cidr_match_source", "rule_set_ip_cidr_accept_empty", "match_response", "match_response_tag", "race")


class RuleError(ValueError):
    """A rule or rule set that does not load."""


@dataclass(frozen=True)
class Default:
    fields: dict = field(default_factory=dict)
    invert: bool = False
    action: dict | None = None

    def get(self, name: str) -> list:
        return self.fields.get(name, [])

    @property
    def empty(self) -> bool:
        return not any(k not in MODIFIERS for k in self.fields)


@dataclass(frozen=True)
class Logical:
    mode: str
    rules: tuple
    invert: bool = False
    action: dict | None = None


Rule = Default | Logical


@dataclass(frozen=True)
class RuleSet:
    version: int
    rules: tuple


def _listed(value) -> list:
    return list(value) if isinstance(value, list) else [value]


def _check(name: str, values: list) -> list:
    for v in values:
        if name in ("domain", "domain_suffix", "domain_keyword") and v == "":
            raise RuleError(f"{name}: empty value")
        if name.endswith("port_range"):
            port_bounds(v)
    return values


def port_bounds(text: str) -> tuple[int, int]:
    """`a:b`, `:b` (from 0), `a:` (to 65535); a > b is no error and matches nothing."""
    if ":" not in text:
        raise RuleError(f"bad port range: {text}")
    low, _, high = text.partition(":")
    try:
        lo, hi = int(low) if low else 0, int(high) if high else 65535
    except ValueError:
        raise RuleError(f"bad port range: {text}") from None
    if not (0 <= lo <= 65535 and 0 <= hi <= 65535):
        raise RuleError(f"bad port range: {text}")
    return lo, hi


def parse_rule(raw: dict, headless: bool = False, nested: bool = False, depth: int = 0) -> Rule:
    """A rule from its JSON object. headless: a rule of a rule set, which has no action and fewer fields."""
    if depth > MAX_DEPTH:
        raise RuleError("logical rule nested too deep")
    raw = dict(raw)
    kind, invert = raw.pop("type", "default") or "default", bool(raw.pop("invert", False))
    action = None
    if not headless:
        keys = [k for k in raw if k in ("action", "server", "method", "tag", "override_address", "override_port", "rcode", "strategy", *OPTIONS) or k == "outbound" and not isinstance(raw[k], list)]
        action = {k: raw.pop(k) for k in keys}
        if nested and action:
            raise RuleError("sub rules have no actions")
        action = None if nested else {"action": "route"} | action
        if action and action["action"] not in ACTIONS:
            raise RuleError(f"unknown action: {action['action']}")
    if kind == "logical":
        mode, rules = raw.pop("mode", None), raw.pop("rules", [])
        if mode not in ("and", "or"):
            raise RuleError(f"unknown logical mode: {mode}")
        if raw:
            raise RuleError(f"unknown fields: {', '.join(sorted(raw))}")
        if not rules:
            raise RuleError("logical rule without rules")
        return Logical(mode, tuple(parse_rule(r, headless, True, depth + 1) for r in rules), invert, action)
    if kind != "default":
        raise RuleError(f"unknown rule type: {kind}")
    fields = {}
    for name, value in raw.items():
        if name in REMOVED:
            raise RuleError(f"{name} was removed; use rule sets")
        if name in LISTS or not headless and name in ROUTE_LISTS:
            if values := _check(name, _listed(value)):
                fields[name] = values
        elif name in FLAGS or not headless and name in ROUTE_FLAGS:
            if value:
                fields[name] = True
        elif name in MAPS or not headless and name in ROUTE_MAPS + ROUTE_VALUES:
            if value not in (None, "", {}):
                fields[name] = value
        else:
            raise RuleError(f"unknown field: {name}")
    rule = Default(fields, invert, action)
    if rule.empty and not fields.get("match_response"):
        raise RuleError("missing conditions")
    return rule


def parse_rule_set(source: str | dict) -> RuleSet:
    """A rule set in source form: JSON with a version from 1 to CURRENT_VERSION."""
    raw = json.loads(source) if isinstance(source, str) else dict(source)
    version = raw.pop("version", 0)
    if not version:
        raise RuleError("missing version")
    if not isinstance(version, int) or not 1 <= version <= CURRENT_VERSION:
        raise RuleError(f"unsupported version: {version}")
    rules = raw.pop("rules", [])
    if raw:
        raise RuleError(f"unknown fields: {', '.join(sorted(raw))}")
    return RuleSet(version, tuple(parse_rule(r, headless=True) for r in rules))


def to_json(rule: Rule) -> dict:
    """A rule of a rule set as its JSON object; single values are scalars."""
    if isinstance(rule, Logical):
        out = {"type": "logical", "mode": rule.mode, "rules": [to_json(r) for r in rule.rules]}
    else:
        out = {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in rule.fields.items()}
    return out | {"invert": True} if rule.invert else out


def rule_set_json(rule_set: RuleSet) -> dict:
    return {"version": rule_set.version, "rules": [to_json(r) for r in rule_set.rules]}


def leaves(rules) -> list[Default]:
    out = []
    for r in rules:
        out += leaves(r.rules) if isinstance(r, Logical) else [r]
    return out


def metadata(rules) -> dict[str, bool]:
    """What a rule set's tree contains anywhere: process, network-environment, address, query-type and query-option conditions."""
    has = lambda *names: any(n in r.fields for r in leaves(rules) for n in names)
    return {
        "contains_process": has("process_name", "process_path", "process_path_regex", "package_name", "package_name_regex"),
        "contains_wifi": has("wifi_ssid", "wifi_bssid"),
        "contains_ip_cidr": has("ip_cidr"),
        "contains_query_type": has("query_type"),
        "contains_network_environment": has("network_type", "network_is_expensive", "network_is_constrained", "network_interface_address", "default_interface_address"),
    }


def downgraded(rule_set: RuleSet) -> RuleSet:
    """The lowest version, but not 1, that has every field in use."""
    used = {name for r in leaves(rule_set.rules) for name in r.fields}
    version = rule_set.version
    while version > 2 and not any(SINCE.get(name) == version for name in used):
        version -= 1
    return replace(rule_set, version=version)


def upgraded(rule_set: RuleSet) -> RuleSet:
    """Version 1 becomes the current version; others stay."""
    return replace(rule_set, version=CURRENT_VERSION) if rule_set.version == 1 else rule_set


def merge(rule_sets: dict[str, RuleSet]) -> RuleSet:
    """All rules in order of path; the highest version wins."""
    ordered = [rule_sets[path] for path in sorted(rule_sets)]
    return RuleSet(max((r.version for r in ordered), default=CURRENT_VERSION), tuple(x for r in ordered for x in r.rules))


def destination_prefixes(rules) -> list[str]:
    """Every destination prefix in the tree, in order."""
    return [p for r in leaves(rules) for p in r.get("ip_cidr")]


def describe(rule: Rule) -> str:
    """A rule in one line: `a=1 b=[2 3]`, `!(...)`, `(x && y)`; lists of over three addresses or names are cut."""
    if isinstance(rule, Logical):
        text = {"and": " && ", "or": " || "}[rule.mode].join(f"({describe(r)})" if isinstance(r, Logical) else describe(r) for r in rule.rules)
        return f"!({text})" if rule.invert else text
    parts = []
    for name, v in rule.fields.items():
        if v is True:
            parts.append(f"{name}=true")
        elif not isinstance(v, list):
            parts.append(f"{name}={v}")
        elif len(v) == 1:
            parts.append(f"{name}={v[0]}")
        elif len(v) > 3 and ("domain" in name or "cidr" in name):
            parts.append(f"{name}=[{' '.join(map(str, v[:3]))}...]")
        else:
            parts.append(f"{name}=[{' '.join(map(str, v))}]")
    text = " ".join(parts)
    return f"!({text})" if rule.invert else text
