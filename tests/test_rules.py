"""Rules: loading, grouping, inversion and sets, held against a plain evaluator."""

import ipaddress
import itertools

import pytest
from pyspark.sql import functions as F

from flowtrail.functions import net
from flowtrail.plans import dns, route
from flowtrail.plans.compile import predicate
from flowtrail.plans.rules import RuleError, RuleSet, describe, downgraded, merge, metadata, parse_rule, parse_rule_set, port_bounds, rule_set_json, upgraded

SETS = {
    "two": [{"domain_suffix": ["shop.test"]}, {"ip_cidr": ["198.18.4.0/22"]}],
    "far": [{"ip_cidr": ["198.18.4.0/22"]}],
    "home": [{"ip_cidr": ["172.20.0.0/14"]}],
    "name": [{"domain_suffix": ["news.test"]}],
}


def sets(raw):
    return {tag: RuleSet(5, tuple(parse_rule(r, headless=True) for r in rules)) for tag, rules in raw.items()}


def holds(df, raw, **kw):
    """The predicate's value on a one-row table."""
    return df.select(predicate(df, parse_rule(raw), **kw).alias("m")).first().m


def judged(rule, host, source, answer):
    """(may still match, matches) of a DNS rule by definition: before the answer (None) a destination prefix may turn out either way.

    A rule's domains and destination prefixes are one group, its source prefixes another; a set with a
    single plain rule lends its groups to the rule that names it. Every outcome of what is open is tried.
    """
    inside = lambda a, nets: any(ipaddress.ip_address(a) in ipaddress.ip_network(n) for n in nets)
    under = lambda names: any(host == n or host.endswith("." + n) for n in names)

    def value(r, outer=None, by_source=False):
        if r.get("type") == "logical":
            got = [value(x) for x in r["rules"]]
            out = all(got) if r["mode"] == "and" else any(got)
            return out != r.get("invert", False)
        groups = {k: list(v) for k, v in (outer or {}).items()}
        if "domain_suffix" in r:
            groups.setdefault("destination", []).append(under(r["domain_suffix"]))
        if "ip_cidr" in r:
            groups.setdefault("source" if by_source else "destination", []).append(inside(source if by_source else answer, r["ip_cidr"]))
        if "source_ip_cidr" in r:
            groups.setdefault("source", []).append(inside(source, r["source_ip_cidr"]))
        met = lambda g: all(any(x) for x in g.values())
        if "rule_set" in r:
            match_source = r.get("rule_set_ip_cidr_match_source", False)
            out = any(value(SETS[t][0], groups, match_source) if len(SETS[t]) == 1 else met(groups) and any(value(x, None, match_source) for x in SETS[t]) for t in r["rule_set"])
        else:
            out = met(groups)
        return out != r.get("invert", False)

    return value(rule)


def test_dns_rules_against_a_plain_evaluator(spark):
    """After the answer a rule is what it says; a rule that some answer would make match is eligible before it."""
    leaves = [{"ip_cidr": ["198.18.4.0/22"]}, {"rule_set": ["far"]}, {"rule_set": ["two"]}, {"domain_suffix": ["news.test"]}, {"rule_set": ["name"]}, {"rule_set": ["home"], "rule_set_ip_cidr_match_source": True}, {"source_ip_cidr": ["172.20.9.0/24"]}, {"source_ip_cidr": ["10.0.0.0/8"], "ip_cidr": ["198.18.4.0/22"]}]
    rules = [x | {"invert": i} if i else x for x in leaves for i in (False, True)]
    rules += [{"type": "logical", "mode": m, "invert": i, "rules": [a, b]} for m in ("and", "or") for i in (False, True) for a, b in itertools.combinations([leaves[1], leaves[3], leaves[6] | {"invert": True}, leaves[0] | {"invert": True}], 2)]
    cases = list(itertools.product(("news.test", "a.shop.test", "else.test"), ("198.18.5.1", "203.0.113.9")))
    source = "172.20.9.4"
    number = lambda a: int(net.key(a), 16)
    df = spark.createDataFrame([(k, h, number(source), [number(a)], 1) for k, (h, a) in enumerate(cases)], "k int, domain string, src_ip long, response_addresses array<long>, query_type int")
    columns = []
    for n, raw in enumerate(rules):
        pre, final = dns.pre_and_final(df, parse_rule(raw | {"action": "route", "server": "s"}), sets=sets(SETS))
        columns += [pre.alias(f"p{n}"), final.alias(f"f{n}")]
    for r in df.select("k", *columns).collect():
        host, answer = cases[r.k]
        for n, raw in enumerate(rules):
            assert r[f"f{n}"] == judged(raw, host, source, answer), (raw, host, answer)
            if any(judged(raw, host, source, a) for _, a in cases):
                assert r[f"p{n}"], (raw, host)


@pytest.fixture(scope="module")
def flow(spark):
    def make(host="www.example.com", port=443, **more):
        v = {"host": host, "dst_port": port, "src_ip": int(net.key("10.0.0.1"), 16), "src_port": 1000, "network": "tcp"} | more
        return spark.range(1).select(*[(F.lit(x).cast("long") if isinstance(x, int) and k.endswith("ip") else F.lit(x)).alias(k) for k, x in v.items()])

    return make


@pytest.mark.parametrize("host, port, single, multi", [("api.two.test", 8443, True, False), ("own.test", 8443, True, False), ("neither.test", 8443, False, False), ("api.two.test", 22, False, False)])
def test_rule_set_merge_boundary(flow, host, port, single, multi):
    rule = {"domain": ["own.test"], "port": [8443], "rule_set": ["s"]}
    one = sets({"s": [{"domain_suffix": ["one.test", "two.test"]}]})
    two = sets({"s": [{"domain_suffix": ["one.test"]}, {"domain_suffix": ["two.test"]}]})
    df = flow(host, port)
    assert holds(df, rule, sets=one) == single
    assert holds(df, rule, sets=two) == multi


@pytest.mark.parametrize("inner, more", [({"domain": "x.example"}, {}), ({"domain_suffix": "example"}, {}), ({"domain_keyword": "x.e"}, {}), ({"domain_regex": "^x"}, {}), ({"ip_cidr": "198.51.100.0/24"}, {"dst_ip": int(net.key("198.51.100.7"), 16)})])
def test_outer_prefix_merges_with_single_set(flow, inner, more):
    df = flow("x.example", **more)
    assert holds(df, {"ip_cidr": ["203.0.113.0/24"], "rule_set": "s"}, sets=sets({"s": [inner]}))


def test_sets_do_not_combine_and_empty_set_never_matches(flow):
    df = flow("x.example", 443)
    two = sets({"a": [{"domain": "x.example", "source_port": 1}], "b": [{"source_port": 1000, "domain": "y.example"}]})
    assert not holds(df, {"rule_set": ["a", "b"]}, sets=two)
    assert not holds(df, {"rule_set": ["e"]}, sets=sets({"e": []}))
    assert not holds(df, {"domain": "x.example", "rule_set": ["e"]}, sets=sets({"e": []}))


def test_missing_fields_are_false_before_inversion(flow):
    df = flow().withColumn("process_path", F.lit(None).cast("string"))
    assert not holds(df, {"process_name": "curl"})
    assert holds(df, {"process_name": "curl", "invert": True})
    assert holds(df, {"wifi_ssid": "home", "invert": True})
    assert holds(df.withColumn("user_id", F.lit(-1)), {"user_id": -1, "invert": True})


def test_items(flow):
    df = flow("Sub.Example.com", 8080, dst_ip=int(net.key("10.1.2.3"), 16), process_path="/usr/bin/curl")
    yes = [{"domain_suffix": "example.com"}, {"domain_suffix": ".example.com"}, {"domain_regex": "^sub\\..*com$"}, {"port_range": ":9000"}, {"port_range": ["1:2", "8000:"]}, {"ip_is_private": True}, {"ip_version": 4}, {"process_name": "curl"}, {"network": ["udp", "tcp"]}, {"ip_cidr": "10.0.0.0/8"}, {"source_ip_cidr": "10.0.0.1"}, {"clash_mode": "RULE"}]
    no = [{"domain_suffix": "ample.com"}, {"domain_keyword": "Example"}, {"port_range": "9:1"}, {"ip_version": 6}, {"ip_cidr": "11.0.0.0/8"}, {"domain": "example.com"}, {"protocol": "tls"}]
    for raw in yes:
        assert holds(df, raw, env={"clash_mode": "rule"}), raw
    for raw in no:
        assert not holds(df, raw), raw


def test_logical_rules(flow):
    df = flow("x.example", 80)
    a, b = {"domain": "x.example"}, {"port": 443}
    assert holds(df, {"type": "logical", "mode": "or", "rules": [a, b]})
    assert not holds(df, {"type": "logical", "mode": "and", "rules": [a, b]})
    assert holds(df, {"type": "logical", "mode": "and", "rules": [a, b], "invert": True})


@pytest.mark.parametrize("raw", [{"invert": True}, {"domain": ""}, {"port_range": "80"}, {"geosite": "cn"}, {"nothing": 1}, {"type": "logical", "mode": "xor", "rules": [{"port": 1}]}, {"type": "logical", "mode": "or", "rules": [{"port": 1, "outbound": "x"}]}])
def test_bad_rules_do_not_load(raw):
    with pytest.raises(RuleError):
        parse_rule(raw)


def test_look_around_is_refused(flow):
    with pytest.raises(ValueError):
        holds(flow(), {"domain_regex": "a(?=b)"})


def test_rule_set_source_versions_and_merge():
    with pytest.raises(RuleError):
        parse_rule_set('{"rules": []}')
    one = parse_rule_set({"version": 5, "rules": [{"domain": "a"}, {"type": "logical", "mode": "or", "rules": [{"ip_cidr": "10.0.0.0/8"}]}]})
    assert downgraded(one).version == 2
    assert downgraded(parse_rule_set({"version": 5, "rules": [{"network_type": "wifi"}]})).version == 3
    assert downgraded(parse_rule_set({"version": 5, "rules": [{"package_name_regex": "x"}]})).version == 5
    assert upgraded(parse_rule_set({"version": 1, "rules": []})).version == 5
    assert metadata(one.rules)["contains_ip_cidr"] and not metadata(one.rules)["contains_wifi"]
    both = merge({"b.json": one, "a.json": parse_rule_set({"version": 1, "rules": [{"domain": "z"}]})})
    assert both.version == 5 and describe(both.rules[0]) == "domain=z"
    assert parse_rule_set(rule_set_json(one)) == one


def test_port_bounds():
    assert port_bounds(":5") == (0, 5) and port_bounds("7:") == (7, 65535)


def test_first_match_and_staged_changes(spark):
    df = spark.createDataFrame([(1, 80, 1), (2, 443, 2), (3, 22, 3)], "id long, dst_port int, dst_ip long")
    rules = [parse_rule(r) for r in (
        {"port": 22, "action": "route-options", "override_port": 443},
        {"port": 80, "action": "bypass"},
        {"port": 443, "outbound": "proxy"},
        {"port": [80, 22], "action": "reject"},
    )]
    got = {r.id: (r.rule_idx, r.outbound, r.dst_port) for r in route.route(df, rules).collect()}
    assert got == {1: (3, None, 80), 2: (2, "proxy", 443), 3: (2, "proxy", 443)}  # a rejected connection has no outbound
    every = sorted((r.id, r.rule_idx) for r in route.matches(df, rules).collect())
    assert every == [(1, 1), (1, 3), (2, 2), (3, 0), (3, 3)]


def test_dns_walk_retries_after_a_rejected_answer(spark):
    df = spark.createDataFrame([(1, "a.example", 1, [16843009]), (2, "a.example", 16, [16843009]), (3, "a.example", 1, [134744072])], "id long, domain string, query_type int, response_addresses array<long>")
    rules = [parse_rule({"ip_cidr": "8.8.8.0/24", "server": "x"}), parse_rule({"domain_suffix": "example", "server": "y"})]
    assert {r.id: r.server for r in dns.walk(df, rules).collect()} == {1: "y", 2: "y", 3: "x"}
    assert dns.mode(rules) == "legacy"


def test_dns_race(spark):
    """Racing reads commit by completion time, waiting ones by rule; a failed evaluation never does."""
    done = spark.createDataFrame([(q, t, ms, ok) for q, (a, b) in enumerate([((70, True), (31, True)), ((44, False), (90, True)), ((12, True), (12, True)), ((61, True), (8, True)), ((5, False), (6, False))]) for t, (ms, ok) in zip("mn", (a, b))], "query_id long, tag string, completed_ms long, ok boolean")
    reads = spark.createDataFrame([(q, k, t, q != 3) for q in range(5) for k, t in enumerate("mn")], "query_id long, rule_idx int, tag string, race boolean")
    assert {r.query_id: r.tag for r in dns.race(done, reads).collect()} == {0: "n", 1: "n", 2: "m", 3: "m"}


def test_dns_race_with_a_route_started_ahead(spark):
    """A route counts only if what it waited for failed, is the answer even if it failed, and is there when the last of these failed."""
    done = [(q, tag, ms, ok) for q, oks in enumerate([(1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0)]) for tag, ms, ok in zip("mnr", (50, 30, 10), map(bool, oks))] + [(4, "m", 5, False)]
    reads = [(q, k, tag, tag != "r", tag == "r") for q in range(5) for k, tag in enumerate("mnr")]
    got = dns.race(spark.createDataFrame(done, "query_id int, tag string, completed_ms int, ok boolean"), spark.createDataFrame(reads, "query_id int, rule_idx int, tag string, race boolean, route boolean"))
    assert {r.query_id: (r.tag, r.answered_ms, r.failed) for r in got.collect()} == {0: ("n", 30, False), 1: ("n", 30, False), 2: ("r", 50, False), 3: ("r", 50, True), 4: ("r", 5, True)}


def test_dns_fold_reads_named_answers(spark):
    df = spark.createDataFrame([(1, "a.example", {"u": (0, [16843009])}), (2, "a.example", {"u": (3, [])}), (3, "b.test", {"u": (0, [16843009])})], "id long, domain string, responses map<string, struct<rcode:int,addresses:array<bigint>>>")
    rules = [parse_rule({"domain_suffix": "example", "action": "evaluate", "tag": "u"}), parse_rule({"match_response": True, "match_response_tag": "u", "ip_cidr": "1.1.1.0/24", "action": "respond", "tag": "u"}), parse_rule({"match_response": True, "match_response_tag": "u", "response_rcode": 3, "action": "route", "server": "z"})]
    assert {r.id: r.decided_idx for r in dns.fold(df, rules).collect()} == {1: 1, 2: 2, 3: None}


def test_address_keys(spark):
    texts = ["1.2.3.4", "256.1.1.1", "::1", "2001:db8::a:1", "1:2:3:4:5:6:7:8", "::", "1::2::3", "abc", None, "1.2.3.4\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.k for r in df.select(net.to_key(F.col("t")).alias("k")).collect()]
    want = [net.key(t) if t in ("1.2.3.4", "::1", "2001:db8::a:1", "1:2:3:4:5:6:7:8", "::") else None for t in texts]
    assert got == want
