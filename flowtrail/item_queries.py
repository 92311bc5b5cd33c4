"""Registered queries that go through every rule item, DNS evaluation, keyed state and payload class, each beside its SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import net, scalar
from .operators import accounting, enrich, lookup, quic, selection, sniff, usage
from .plans import dns, route, rules
from .plans.compile import predicate
from .plans.rules import RuleError, parse_rule
from .queries import CLOSED, FLOWS, HOSTS, SQL, closed_flows, in_prefixes, literal, query, values
from .session import shared, written
from .sources import filterlist, store
from .sources.tables import flows, hosts, hosts_file
from .streaming import subscribe


def judged(df: DataFrame, key: str, items: dict[str, dict], **kw) -> DataFrame:
    """key and a column for each rule."""
    return df.select(key, *[predicate(df, parse_rule(raw), **kw).alias(name) for name, raw in items.items()])


LOCAL = {
    "process_path": "CASE event_id % 4 WHEN 0 THEN '/usr/bin/fetch' WHEN 1 THEN '/opt/app/run' WHEN 2 THEN '' END",
    "user": "concat('n', event_id % 7)", "user_id": "event_id % 6 - 1", "src_mac": "concat('02:00:00:00:00:0', event_id % 8)", "src_hostname": "concat('pc', event_id % 9)",
    "protocol": "CASE event_id % 5 WHEN 0 THEN 'tls' WHEN 1 THEN 'quic' END", "client": "CASE event_id % 5 WHEN 1 THEN 'left' WHEN 2 THEN 'right' END", "src_port": "1000 + event_id % 50",
}
LOCAL_SQL = f"{FLOWS}, m AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in LOCAL.items())}, event_id % 3 = 0 AS has, 'com.a' || event_id % 2 AS package FROM flows)"


def local_flows(spark, sf_dir) -> DataFrame:
    packages = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("com.a"), F.col("event_id") % 2), F.lit("org.b")))
    return flows(spark, sf_dir).withColumns({**{n: F.expr(e) for n, e in LOCAL.items()}, "packages": packages})


@query(f"""WITH {LOCAL_SQL} SELECT id, coalesce(process_path IN ('/usr/bin/fetch', '/opt/app/run') AND regexp_extract(process_path, '[^/]*$') = 'run', false) AS process_name, coalesce(process_path = '/usr/bin/fetch', false) AS process_path,
    coalesce(regexp_matches(process_path, '^/opt/.*n$'), false) AS process_path_regex, has AND package = 'com.a1' AS package_name, has AS package_name_regex, "user" IN ('n1', 'n3') AS "user", user_id IN (2, 4) AS user_id, user_id NOT IN (3) AS not_user_id,
    src_mac = '02:00:00:00:00:03' AS source_mac_address, src_hostname IN ('pc1', 'pc8') AS source_hostname, coalesce(protocol = 'tls', false) AS protocol, coalesce(client = 'right', false) AS client, coalesce(client, '') <> 'left' AS not_client,
    inbound IN ('view') AS inbound, auth_user = 'u5' AS auth_user, network = 'udp' AS network FROM m""")
def rule_items_local(spark, sf_dir):
    """Owner, neighbour, protocol and plain set items."""
    return judged(local_flows(spark, sf_dir), "id", {
        "process_name": {"process_name": "run"}, "process_path": {"process_path": "/usr/bin/fetch"}, "process_path_regex": {"process_path_regex": "^/opt/.*n$"}, "package_name": {"package_name": ["com.a1", "none"]}, "package_name_regex": {"package_name_regex": "^org[.]"},
        "user": {"user": ["n1", "n3"]}, "user_id": {"user_id": [2, 4, -1]}, "not_user_id": {"user_id": [3], "invert": True}, "source_mac_address": {"source_mac_address": "02:00:00:00:00:03"}, "source_hostname": {"source_hostname": ["pc1", "pc8"]},
        "protocol": {"protocol": "tls"}, "client": {"client": "right"}, "not_client": {"client": "left", "invert": True}, "inbound": {"inbound": "view"}, "auth_user": {"auth_user": "u5"}, "network": {"network": "udp"},
    })


@query(f"""WITH {LOCAL_SQL}, a AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE dst_ip END AS d, event_id % 8 < 4 AS resolved FROM m)
    SELECT id, src_ip BETWEEN 167772160 AND 184549375 AS source_ip_is_private, src_port = 1007 AS source_port, src_port BETWEEN 1040 AND 1045 OR src_port < 1002 AS source_port_range, d IS NOT NULL AS ip_version_4, false AS ip_version_6, d IS NOT NULL OR resolved AS ip_accept_any,
    CASE WHEN d IS NOT NULL THEN d < 2147483648 ELSE resolved END AS ip_cidr, coalesce(d, CASE WHEN resolved THEN 0 END) IS NOT NULL AND NOT CASE WHEN d IS NOT NULL THEN d < 2147483648 ELSE resolved END OR coalesce(d, CASE WHEN resolved THEN 0 END) IS NULL AS not_ip_cidr FROM a""")
def rule_items_address(spark, sf_dir):
    """Address items over the destination, or else any resolved address."""
    df = local_flows(spark, sf_dir).withColumn("addresses", F.when(F.col("event_id") % 8 < 4, F.array(F.lit(0).cast("long"), F.lit(4294967295).cast("long")))).withColumn("dst_ip", F.when(F.col("event_id") % 4 != 0, F.col("dst_ip")))
    return judged(df, "id", {
        "source_ip_is_private": {"source_ip_is_private": True}, "source_port": {"source_port": 1007}, "source_port_range": {"source_port_range": ["1040:1045", ":1001"]}, "ip_version_4": {"ip_version": 4}, "ip_version_6": {"ip_version": 6},
        "ip_accept_any": {"ip_accept_any": True}, "ip_cidr": {"ip_cidr": "0.0.0.0/1"}, "not_ip_cidr": {"ip_cidr": "0.0.0.0/1", "invert": True},
    })


@query(f"""WITH {HOSTS} SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.example.net' AS preferred_by, host = 'example.org' OR host LIKE '%.example.org' AS adguard_domain, contains(host, 'th') AS domain_keyword,
    regexp_matches(host, '^m[.]|net$') AS domain_regex, false AS upper_keyword FROM hosts""")
def rule_items_name(spark, sf_dir):
    items = {"preferred_by": {"preferred_by": ["p", "none"]}, "adguard_domain": {"adguard_domain": "||example.org^"}, "domain_keyword": {"domain_keyword": "th"}, "domain_regex": {"domain_regex": ["^m[.]", "net$"]}, "upper_keyword": {"domain_keyword": "TH"}}
    return judged(hosts(spark, sf_dir), "page_id", items, env={"preferred": {"p": ["example.com", ".example.net"]}})


DNS = f"""{FLOWS}, q AS (SELECT id, event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 65 ELSE 0 END AS query_type, event_id % 3 = 0 AS query_dnssec, src_ip, 16 + event_id % 9 AS subnet_bits, event_id % 5 <> 0 AS response,
    event_id % 3 AS rcode, event_id % 4 AS last, nullif('o' || event_id % 3, 'o0') AS outbound FROM flows)"""


def dns_flows(spark, sf_dir) -> DataFrame:
    record = lambda n: F.array(F.struct(F.lit(f"{n}.test").alias("name"), F.lit(1).alias("type"), F.lit(1).alias("class"), F.concat(F.lit("10.0.0."), F.col("event_id") % 4).alias("rdata"), (F.col("event_id") % 100).cast("int").alias("ttl")))
    there = F.col("event_id") % 5 != 0
    return flows(spark, sf_dir).select(
        "id", "event_id", F.expr("CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 65 ELSE 0 END").alias("query_type"), (F.col("event_id") % 3 == 0).alias("query_dnssec"), F.col("src_ip").alias("subnet_ip"), (F.lit(16) + F.col("event_id") % 9).alias("subnet_bits"),
        there.alias("response"), F.when(there, F.col("event_id") % 3).alias("response_rcode"), F.when(there, record("a")).alias("response_answer"), F.when(there, record("n")).alias("response_ns"), F.when(there, record("x")).alias("response_extra"), F.nullif(F.concat(F.lit("o"), F.col("event_id") % 3), F.lit("o0")).alias("outbound"),
    )


@query(f"""WITH {DNS} SELECT id, query_type IN (1, 28) AS query_type, query_dnssec, src_ip BETWEEN 167772160 AND 167776255 AND subnet_bits >= 20 AS query_client_subnet, response AND rcode = 2 AS response_rcode, response AND last = 3 AS response_answer, response AND last IN (1, 2) AS response_ns,
    response AND last = 0 AS response_extra, outbound IS NOT NULL AS outbound_any, coalesce(outbound = 'o2', false) AS outbound, response AND rcode = 1 AS read_response, NOT response OR rcode <> 1 AS not_read_response FROM q""")
def rule_items_dns(spark, sf_dir):
    """Query and response items; a rule that reads a response that is not there gives its inversion."""
    of = lambda n, *last: [{"name": f"{n}.test", "type": 1, "class": 1, "rdata": f"10.0.0.{k}", "ttl": 999} for k in last]
    return judged(dns_flows(spark, sf_dir), "id", {
        "query_type": {"query_type": [1, 28, 0]}, "query_dnssec": {"query_dnssec": True}, "query_client_subnet": {"query_client_subnet": "10.0.0.0/20"}, "response_rcode": {"response_rcode": 2}, "response_answer": {"response_answer": of("a", 3)}, "response_ns": {"response_ns": of("n", 1, 2)},
        "response_extra": {"response_extra": of("x", 0)}, "outbound_any": {"outbound": ["any"]}, "outbound": {"outbound": ["o2"]}, "read_response": {"match_response": True, "response_rcode": 1}, "not_read_response": {"match_response": True, "response_rcode": 1, "invert": True},
    })


ENV = {
    "clash_mode": "Rule", "network_type": "wifi", "network_is_expensive": True, "network_is_constrained": False, "wifi_ssid": "home", "wifi_bssid": "00:11",
    "interfaces": [{"name": "w0", "type": "wifi", "prefixes": ["192.168.4.0/22"], "default": True}, {"name": "t0", "type": "other", "own": True, "prefixes": ["10.7.0.0/16"]}],
}
ENV_ITEMS = [
    ("clash_mode", {"clash_mode": "rULE"}, True), ("clash_mode_other", {"clash_mode": "all"}, False), ("network_type", {"network_type": ["cellular", "wifi"]}, True), ("network_is_expensive", {"network_is_expensive": True}, True), ("network_is_constrained", {"network_is_constrained": True}, False),
    ("wifi_ssid", {"wifi_ssid": "home"}, True), ("wifi_bssid", {"wifi_bssid": "00:22"}, False), ("interface_address", {"interface_address": {"w0": ["192.168.5.0/24"]}}, True), ("interface_address_all", {"interface_address": {"w0": ["192.168.5.0/24"], "t0": ["10.8.0.0/16"]}}, False),
    ("network_interface_address", {"network_interface_address": {"wifi": ["192.168.0.0/16"]}}, True), ("network_interface_address_own", {"network_interface_address": {"other": ["10.0.0.0/8"]}}, False), ("default_interface_address", {"default_interface_address": ["192.168.6.0/24"]}, True), ("default_interface_address_all", {"default_interface_address": ["192.168.6.0/24", "172.16.0.0/12"]}, False),
]


@query(f"WITH {FLOWS} SELECT inbound, item, count(*) AS n FROM flows, (VALUES {values([(n, int(w)) for n, _, w in ENV_ITEMS])}) AS v(item, holds) WHERE holds = 1 GROUP BY inbound, item")
def rule_items_environment(spark, sf_dir):
    """How many connections each condition on the machine lets through."""
    names = [n for n, _, _ in ENV_ITEMS]
    m = judged(flows(spark, sf_dir).withColumn("row", F.col("inbound")), "row", {n: raw for n, raw, _ in ENV_ITEMS}, env=ENV)
    held = F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("item")
    return m.select(F.col("row").alias("inbound"), held).groupBy("inbound", "item").agg(F.count("*").alias("n"))


@query(f"""WITH {FLOWS} SELECT id, CASE WHEN inbound = 'error' AND network = 'udp' THEN 'drop' WHEN inbound = 'error' THEN 'reject' WHEN dst_port < 500 THEN 'bypass' WHEN dst_port < 1000 THEN 'continue' WHEN network = 'udp' THEN 'flow' ELSE 'continue' END AS verdict FROM flows""")
def packet_verdicts(spark, sf_dir):
    """The verdict before a connection is made."""
    raw = [{"inbound": "error", "network": "udp", "action": "reject", "method": "drop"}, {"inbound": "error", "action": "reject"}, {"port_range": ":499", "action": "bypass", "outbound": "x"}, {"port_range": ":999", "action": "hijack-dns"}, {"network": "udp", "outbound": "a"}]
    return route.pre_match(flows(spark, sf_dir), [parse_rule(r) for r in raw]).select("id", "verdict")


@query(f"""WITH {DNS}, a AS (SELECT *, query_type = 1 OR query_type = 28 AS asked, response AND (query_type = 1 OR query_type = 28) AS there FROM q)
    SELECT id, CASE WHEN there AND rcode = 0 AND last >= 1 THEN 1 WHEN there AND rcode = 2 THEN 2 WHEN event_id % 7 = 0 THEN 3 END AS decided_idx, CASE WHEN there AND rcode = 0 AND last >= 1 THEN 'u' END AS respond_tag FROM a""")
def dns_fold(spark, sf_dir):
    """The current mode over recorded answers: evaluate, read, respond or route."""
    df = dns_flows(spark, sf_dir)
    answer = F.struct(F.col("response_rcode").cast("int").alias("rcode"), F.array((F.lit(int(net.key("10.0.0.0"), 16)).cast("long") + F.col("event_id") % 4)).alias("addresses"))
    df = df.select("id", "event_id", "query_type", F.when(F.col("event_id") % 7 == 0, "seven").alias("domain"), F.when(F.col("response"), F.create_map(F.lit("u"), answer)).otherwise(F.expr("cast(map() as map<string,struct<rcode:int,addresses:array<bigint>>>)")).alias("responses"))
    raw = [
        {"query_type": [1, 28], "action": "evaluate", "tag": "u"}, {"match_response": True, "match_response_tag": "u", "response_rcode": 0, "ip_cidr": ["10.0.0.1/32", "10.0.0.2/31"], "action": "respond", "tag": "u"},
        {"match_response": True, "match_response_tag": "u", "response_rcode": 2, "server": "b"}, {"domain": "seven", "server": "c"},
    ]
    return dns.fold(df, [parse_rule(r) for r in raw]).select("id", "decided_idx", "respond_tag")


@query(f"""WITH {FLOWS}, e AS (SELECT event_id, t.tag, CASE t.tag WHEN 'm' THEN event_id * 37 % 211 ELSE event_id * 53 % 199 END AS ms, CASE t.tag WHEN 'm' THEN event_id % 6 <> 0 ELSE event_id % 10 <> 0 END AS ok, t.k FROM flows, (VALUES ('m', 0), ('n', 1)) AS t(tag, k)),
    o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN event_id % 2 = 0 THEN ms ELSE 0 END, k) AS place FROM e WHERE ok) SELECT event_id AS query_id, tag, k AS rule_idx FROM o WHERE place = 1""")
def dns_race(spark, sf_dir):
    """Even queries race their two reads, odd ones wait for the first."""
    f = flows(spark, sf_dir).select("event_id")
    two = f.select(F.col("event_id").alias("query_id"), F.explode(F.array(F.lit("m"), F.lit("n"))).alias("tag"))
    i, first = F.col("query_id"), F.col("tag") == "m"
    done = two.select("query_id", "tag", F.when(first, i * 37 % 211).otherwise(i * 53 % 199).alias("completed_ms"), F.when(first, i % 6 != 0).otherwise(i % 10 != 0).alias("ok"))
    reads = two.select("query_id", F.when(first, 0).otherwise(1).alias("rule_idx"), "tag", (i % 2 == 0).alias("race"))
    return dns.race(done, reads).select("query_id", "tag", "rule_idx")


@query(f"""WITH {HOSTS} SELECT page_id, host || '|1|192.0.2.1;fixed.test|1|192.0.2.2' AS answer FROM hosts""")
def dns_predefined(spark, sf_dir):
    h = hosts(spark, sf_dir).withColumnRenamed("host", "qname")
    made = dns.predefined(h, [{"name": "*", "type": 1, "rdata": "192.0.2.1"}, {"name": "fixed.test", "type": 1, "rdata": "192.0.2.2"}])
    return h.select("page_id", F.array_join(F.transform(made, lambda r: F.concat_ws("|", r["name"], r["type"].cast("string"), r["rdata"])), ";").alias("answer"))


@query(f"""WITH {FLOWS} SELECT id, CASE WHEN inbound = 'view' THEN 2 WHEN inbound = 'error' THEN 3 END AS server_idx, CASE WHEN inbound = 'error' OR inbound NOT IN ('view') AND dst_port < 3000 THEN true WHEN inbound = 'view' AND dst_port < 3000 THEN true END AS disable_cache,
    CASE WHEN inbound = 'view' THEN CASE WHEN network = 'udp' THEN 60 END WHEN network = 'udp' THEN 60 END AS rewrite_ttl FROM flows""")
def dns_walk_options(spark, sf_dir):
    """route-options of rules before the deciding one add up."""
    raw = [{"port_range": ":2999", "action": "route-options", "disable_cache": True}, {"network": "udp", "action": "route-options", "rewrite_ttl": 60}, {"inbound": "view", "server": "a"}, {"inbound": "error", "server": "b", "disable_cache": True}]
    return dns.walk(flows(spark, sf_dir).withColumn("query_type", F.lit(1)), [parse_rule(r) for r in raw]).select("id", "server_idx", "disable_cache", "rewrite_ttl")


EXPLAINED = [({"domain": "a.test"}, "domain=a.test"), ({"port": [1, 2], "network": "tcp", "invert": True}, "!(port=[1 2] network=tcp)"), ({"domain_suffix": ["a", "b", "c", "d"]}, "domain_suffix=[a b c...]"), ({"type": "logical", "mode": "or", "rules": [{"port": 1}, {"ip_is_private": True}]}, "port=1 || ip_is_private=true")]


@query(f"WITH {FLOWS}, r AS (SELECT id, event_id % 5 AS k FROM flows) SELECT id, CASE k {' '.join(f'WHEN {k} THEN {chr(39)}{t}{chr(39)}' for k, (_, t) in enumerate(EXPLAINED))} ELSE '' END AS rule FROM r")
def rule_explain(spark, sf_dir):
    df = flows(spark, sf_dir).select("id", F.when(F.col("event_id") % 5 < len(EXPLAINED), F.col("event_id") % 5).cast("int").alias("rule_idx"))
    return route.named(df, [parse_rule(r) for r, _ in EXPLAINED], "direct").select("id", "rule")


# Rule sets


CONVERTED = [("downgraded", 3, 2), ("upgraded", 5, 1), ("merged", 5, 3), ("round_trip", 3, 2), ("binary", 3, 2)]


@query(f"""WITH p AS (SELECT string_agg('10.' || n_nationkey || '.0.0/16', ',' ORDER BY n_nationkey) AS every FROM nation)
    SELECT step, CAST(version AS INT) AS version, CAST(n_rules AS INT) AS n_rules, CASE WHEN step = 'upgraded' THEN 'none' ELSE every END AS prefixes FROM (VALUES {values(CONVERTED)}) AS v(step, version, n_rules), p""")
def ruleset_conversions(spark, sf_dir):
    """Compile, decompile, downgrade, upgrade, merge and the prefixes of a set with a prefix for each nation."""
    from .sources import binary

    prefixes = [f"10.{r.n_nationkey}.0.0/16" for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows: a rule's list
    five = rules.parse_rule_set({"version": 5, "rules": [{"network_type": "wifi"}, {"type": "logical", "mode": "or", "rules": [{"ip_cidr": prefixes}]}]})
    one = rules.parse_rule_set({"version": 1, "rules": [{"domain": "a.test"}]})
    low = rules.downgraded(five)
    made = {"downgraded": low, "upgraded": rules.upgraded(one), "merged": rules.merge({"b": five, "a": one}), "round_trip": rules.parse_rule_set(rules.rule_set_json(low))}
    rows = [(k, s.version, len(s.rules), ",".join(rules.destination_prefixes(s.rules)) or "none") for k, s in made.items()]
    back = binary.read_rule_set(binary.write_rule_set(low))  # which gathers prefixes into ranges: compared as addresses
    same = net.merged(rules.destination_prefixes(back.rules)) == net.merged(prefixes)
    return literal(spark, [*rows, ("binary", back.version, len(back.rules), ",".join(prefixes) if same else "other")], "step string, version int, n_rules int, prefixes string")


#: What is put before and after a host to make a line, and why the line is dropped.
SHAPES = [("||", "^$third-party", "modifier"), ("", "/path", "path"), ("", "?x", "query"), ("", "##b", "cosmetic"), ("/^10.1.", "/", "address pattern"), ("198.51.100.7 ", "", "hosts"), ("! ", "", None), ("||", "^", None), ("0.0.0.0 ", "", None)]


@query(f"""WITH {HOSTS} SELECT dropped, count(*) AS n FROM hosts JOIN (VALUES {values([(k, d) for k, (_, _, d) in enumerate(SHAPES)])}) AS v(k, dropped) ON page_id % {len(SHAPES)} = k WHERE host <> '' AND dropped IS NOT NULL GROUP BY dropped""")
def filterlist_dropped(spark, sf_dir):
    """A line for each page, of each shape in turn."""
    h, k = hosts(spark, sf_dir).where("host <> ''"), F.col("page_id") % len(SHAPES)
    line = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), "host", F.lit(b))) for i, (a, b, _) in enumerate(SHAPES)])
    return filterlist.dropped_counts(filterlist.parse(h.select(line.alias("value"))))


#: What is put before and after a host to make a line that comes back from a rule as it was.
REVERSED = [("||", "^"), ("|", "^"), ("/^", "[0-9]/"), ("@@||", "^"), ("||", "^$important")]


@query(f"""WITH {HOSTS} SELECT DISTINCT a || host || b AS line FROM hosts JOIN (VALUES {values([(k, *x) for k, x in enumerate(REVERSED)])}) AS v(k, a, b) ON page_id % {len(REVERSED)} = k WHERE host <> ''""")
def filterlist_reverse(spark, sf_dir):
    """A list with a line for each host as one rule, and back: a rule is a literal, so its lines are on the driver."""
    h, k = hosts(spark, sf_dir).where("host <> ''"), F.col("page_id") % len(REVERSED)
    lines = h.select(F.coalesce(*[F.when(k == i, F.concat(F.lit(a), "host", F.lit(b))) for i, (a, b) in enumerate(REVERSED)]).alias("value")).distinct()
    rule = filterlist.to_rule(filterlist.parse(lines))
    return literal(spark, [(x,) for x in filterlist.from_rule(rule)], "line string")


@query(f"""WITH {HOSTS} SELECT host AS name, '10.0.0.' || page_id % 200 AS address, page_id AS line FROM hosts WHERE host <> '' AND page_id % 3 <> 0 UNION ALL SELECT 'also.' || host, '10.0.0.' || page_id % 200, page_id FROM hosts WHERE host <> '' AND page_id % 3 <> 0""")
def hosts_file_names(spark, sf_dir):
    """Lines of a hosts file, comments among them."""
    h = hosts(spark, sf_dir).where("host <> ''")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "host")).otherwise(F.concat(F.lit(" 10.0.0."), F.col("page_id") % 200, F.lit("\t"), F.upper("host"), F.lit(". also."), "host", F.lit(" # end")))
    return hosts_file(h.select(F.col("page_id").alias("line"), line.alias("value"))).select("name", "address", "line")


# Lookups


KEYS = [("2001:db8::/32", "A"), ("2001:db8:0:40::/58", "B"), ("2001:db8:0:41::/64", "C"), ("10.0.0.0/8", "D"), ("10.0.64.0/18", "E"), ("::/0", "F")]
KEY_RANGES = [(f"{lo:0{8 if v == 4 else 32}x}", f"{hi:0{8 if v == 4 else 32}x}", c) for v, lo, hi, c in ((*net.prefix_range(p), c) for p, c in KEYS)]
SIX = f"{FLOWS}, a AS (SELECT id, CASE WHEN event_id % 3 = 0 THEN lpad(lower(to_hex(src_ip)), 8, '0') WHEN event_id % 3 = 1 THEN '20010db800000' || lpad(lower(to_hex(event_id % 256)), 3, '0') || lpad(lower(to_hex(dst_ip)), 16, '0') ELSE lpad(lower(to_hex(dst_ip)), 32, '3') END AS ip FROM flows), r(lo, hi, code) AS (VALUES {values(KEY_RANGES)})"


def six_flows(spark, sf_dir) -> DataFrame:
    h = lambda c, n, fill="0": F.lpad(F.lower(F.hex(c)), n, fill)
    i = F.col("event_id") % 3
    ip = F.when(i == 0, h("src_ip", 8)).when(i == 1, F.concat(F.lit("20010db800000"), h(F.col("event_id") % 256, 3), h("dst_ip", 16))).otherwise(h("dst_ip", 32, "3"))
    return flows(spark, sf_dir).select("id", ip.alias("ip"))


@query(f"WITH {SIX} SELECT id, code FROM a JOIN r ON length(ip) = length(lo) AND ip BETWEEN lo AND hi")
def key_range_join(spark, sf_dir):
    """Ranges of both address families."""
    return lookup.key_range_join(six_flows(spark, sf_dir), literal(spark, KEY_RANGES, "lo string, hi string, code string"), "ip").select("id", "code")


@query(f"WITH {SIX}, b AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY lo DESC, hi) AS k FROM a JOIN r ON length(ip) = length(lo) AND ip BETWEEN lo AND hi) SELECT a.id, coalesce(code, 'unknown') AS code FROM a LEFT JOIN b ON a.id = b.id AND k = 1")
def country_of_keys(spark, sf_dir):
    return lookup.country_of(six_flows(spark, sf_dir), literal(spark, KEY_RANGES, "lo string, hi string, code string"), "id", "ip")


@query("SELECT code, string_agg(prefix, ',' ORDER BY prefix) AS ip_cidr FROM (SELECT 'n' || n_regionkey AS code, '10.' || n_nationkey || '.0.0/16' AS prefix FROM nation) GROUP BY code")
def country_networks(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_regionkey").alias("code"), F.concat(F.lit("10."), "n_nationkey", F.lit(".0.0/16")).alias("prefix"))
    return lookup.networks_by_country(n).select("code", F.array_join("ip_cidr", ",").alias("ip_cidr"))


@query(f"""WITH {FLOWS}, f AS (SELECT id, event_id, created_at, network, src_ip, 1000 + event_id % 50 AS src_port, CASE WHEN event_id % 4 = 0 THEN 3323068416 + event_id % 300 ELSE dst_ip % 97 END AS dst_ip, CASE WHEN event_id % 10 = 1 THEN 'own.test' END AS domain FROM flows),
    s AS (SELECT 3323068416 + x AS address, 'fake' || x AS name FROM range(0, 250) AS t(x)), an AS (SELECT dst_ip, created_at, 'h' || event_id AS value FROM f WHERE event_id % 5 = 2 AND event_id % 4 <> 0),
    a1 AS (SELECT dst_ip, created_at, max(value) AS value FROM an GROUP BY 1, 2),
    n AS (SELECT f.*, s.name, dst_ip >= 3323068416 AND dst_ip <= 3323068715 AS inside FROM f LEFT JOIN s ON f.dst_ip = s.address), r AS (SELECT n.*, a1.value AS found, a1.created_at AS since FROM n ASOF LEFT JOIN a1 ON n.dst_ip = a1.dst_ip AND n.created_at >= a1.created_at)
    SELECT id, CASE WHEN src_port < 1025 AND network = 'tcp' THEN '/bin/p' || src_port END AS process_path, CASE WHEN src_ip % 2 = 0 THEN '02:' || src_ip END AS src_mac, CASE WHEN inside AND name IS NOT NULL THEN name WHEN inside THEN domain WHEN coalesce(domain, '') = '' THEN CASE WHEN created_at < since + to_seconds(7200) THEN found END ELSE domain END AS domain,
    CASE WHEN inside AND name IS NOT NULL THEN dst_ip END AS origin_ip, CASE WHEN inside AND name IS NULL THEN 'no name for this synthetic address' END AS error, CASE WHEN inside AND name IS NOT NULL THEN NULL ELSE 4 END AS ip_version FROM r""")
def enriched_flows(spark, sf_dir):
    """Owner, neighbour, synthetic name or else answered name, family."""
    i = F.col("event_id")
    f = flows(spark, sf_dir).select("id", "event_id", "created_at", "network", "src_ip", (F.lit(1000) + i % 50).alias("src_port"), F.when(i % 4 == 0, F.lit(3323068416) + i % 300).otherwise(F.col("dst_ip") % 97).alias("dst_ip"), F.when(i % 10 == 1, "own.test").alias("domain"))
    owners = f.where("network = 'tcp' AND src_port < 1025").select("network", "src_ip", "src_port").distinct().select("*", F.concat(F.lit("/bin/p"), "src_port").alias("process_path"), F.lit(0).alias("user_id"))
    near = f.where("src_ip % 2 = 0").select("src_ip").distinct().select("src_ip", F.concat(F.lit("02:"), "src_ip").alias("src_mac"), F.lit("pc").alias("src_hostname"))
    names = spark.range(250).select((F.lit(3323068416) + F.col("id")).alias("address"), F.concat(F.lit("fake"), "id").alias("domain"))
    answers = f.where("event_id % 5 = 2 AND event_id % 4 <> 0").select("dst_ip", "created_at", F.concat(F.lit("h"), "event_id").alias("value"), F.lit(7200).alias("ttl_s"))
    out = enrich.enrich(f, owners, near, names, (3323068416, 3323068715), answers)
    return out.select("id", "process_path", "src_mac", "domain", "origin_ip", "error", "ip_version")


@query(f"""WITH {FLOWS}, q AS (SELECT id, event_id, 't' || event_id % 3 AS transport, 'n' || dst_ip % 40 AS qname, created_at AS ts FROM flows), j AS (SELECT transport, qname, ts FROM q WHERE event_id % 5 = 0), d AS (SELECT DISTINCT * FROM j)
    SELECT q.id, coalesce(q.ts < d.ts + to_seconds(3600 * 24), false) AS rejected FROM q ASOF LEFT JOIN d ON q.transport = d.transport AND q.qname = d.qname AND q.ts >= d.ts WHERE event_id % 5 <> 0""")
def rejected_answers(spark, sf_dir):
    i = F.col("event_id")
    q = flows(spark, sf_dir).select("id", "event_id", F.concat(F.lit("t"), i % 3).alias("transport"), F.concat(F.lit("n"), F.col("dst_ip") % 40).alias("qname"), F.lit(1).alias("qtype"), F.col("created_at").alias("ts"))
    known = q.where("event_id % 5 = 0").select("transport", "qname", "qtype", "ts", F.lit(3600 * 24).alias("ttl_s"))
    return enrich.rejected(q.where("event_id % 5 <> 0"), known).select("id", "rejected")


# Accounting and usage


@query(f"""WITH {FLOWS}, s AS (SELECT auth_user, CAST(sum(upload) AS BIGINT) AS uplink_bytes, CAST(sum(download) AS BIGINT) AS downlink_bytes, count(*) FILTER (network <> 'udp') AS tcp_sessions, count(*) FILTER (network = 'udp') AS udp_sessions FROM flows GROUP BY auth_user)
    SELECT auth_user AS user, uplink_bytes, downlink_bytes, tcp_sessions, udp_sessions FROM s UNION ALL SELECT NULL, CAST(sum(uplink_bytes) AS BIGINT), CAST(sum(downlink_bytes) AS BIGINT), CAST(sum(tcp_sessions) AS BIGINT), CAST(sum(udp_sessions) AS BIGINT) FROM s""")
def ssm_all_users(spark, sf_dir):
    return accounting.with_all_users(accounting.user_stats(flows(spark, sf_dir))).select("user", "uplink_bytes", "downlink_bytes", "tcp_sessions", "udp_sessions")


@query(f"WITH {FLOWS} SELECT 'inbound>>>view>>>traffic>>>uplink' AS name, CAST(sum(upload) AS BIGINT) AS value FROM flows WHERE inbound = 'view'")
def single_counter(spark, sf_dir):
    name = "inbound>>>view>>>traffic>>>uplink"
    return accounting.one_counter(accounting.counters(flows(spark, sf_dir), inbounds=["view"]), name)


@query(f"WITH {FLOWS} SELECT auth_user AS user, CAST(sum(upload) AS BIGINT) AS uplink_bytes FROM flows WHERE auth_user IN (SELECT 'u' || c_custkey FROM customer) GROUP BY auth_user")
def counters_pruned(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("u"), "c_custkey").alias("user"))
    return accounting.pruned(accounting.user_stats(flows(spark, sf_dir)), users).select("user", "uplink_bytes")


@query(f"""WITH {CLOSED}, l AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS newest, row_number() OVER (ORDER BY created_at, id) AS oldest, row_number() OVER (ORDER BY upload % 1000 + download % 1000 DESC, id DESC) AS busiest FROM c)
    SELECT id, CASE WHEN newest <= 50 THEN newest END AS newest, CASE WHEN busiest <= 50 THEN busiest END AS busiest, CASE WHEN oldest <= 50 THEN oldest END AS oldest FROM l WHERE newest <= 50 OR busiest <= 50 OR oldest <= 50""")
def connection_lists(spark, sf_dir):
    """The first fifty by date, by present traffic and by creation; the lists' places are numbered from their order."""
    c = closed_flows(spark, sf_dir).withColumns({"uplink": F.col("upload") % 1000, "downlink": F.col("download") % 1000, "created": F.col("created_at"), "outbound_type": F.lit("proxy")})
    place = lambda d, name: d.coalesce(1).select("id", (F.monotonically_increasing_id() + 1).alias(name))  # noqa: E731  fifty rows, in order
    newest, busiest, oldest = place(accounting.top(c, "date", 50), "newest"), place(accounting.top(c, "traffic", 50), "busiest"), place(accounting.listed(accounting.without_dns(c), ("id", "created")).limit(50), "oldest")
    return newest.join(busiest, "id", "full").join(oldest, "id", "full")


TIERED = "CASE event_id % 6 WHEN 0 THEN ' Flex' WHEN 1 THEN 'priority' WHEN 2 THEN 'scale' WHEN 3 THEN 'auto' WHEN 4 THEN 'odd' END"


@query(f"""WITH {FLOWS}, t AS (SELECT CASE event_id % 6 WHEN 0 THEN 'flex' WHEN 1 THEN 'priority' ELSE 'default' END AS service_tier, upload % 5000 AS i, upload % 700 AS c, download % 300 AS o FROM flows), s AS (SELECT service_tier, CAST(sum(i) AS BIGINT) AS i, CAST(sum(c) AS BIGINT) AS c, CAST(sum(o) AS BIGINT) AS o FROM t GROUP BY 1)
    SELECT service_tier, i AS input_tokens, floor((greatest(i - c, 0) * 2.5::DOUBLE + o * 7.5::DOUBLE + c * 0.5::DOUBLE) / 1000000 * 100 + 0.5) / 100 AS cost FROM s""")
def usage_tiers(spark, sf_dir):
    """Cells by service tier, at the variant's cost: cached tokens are part of the input."""
    f = flows(spark, sf_dir).select(F.lit("m").alias("model"), F.lit(0).alias("context_window"), F.lit(0).cast("long").alias("week_start"), F.lit("").alias("user"), usage.service_tier(F.expr(TIERED)).alias("service_tier"), (F.col("upload") % 5000).alias("input_tokens"), (F.col("download") % 300).alias("output_tokens"), (F.col("upload") % 700).alias("cache_read_tokens"), *[F.lit(0).cast("long").alias(c) for c in ("cache_5m_tokens", "cache_1h_tokens", "cache_total_tokens")])
    cells = usage.all_users(usage.cells(f, "service_tier"), "service_tier")
    price = F.struct(F.lit(2.5).alias("input"), F.lit(7.5).alias("output"), F.lit(0.5).alias("cache_read"))
    return cells.select("service_tier", "input_tokens", usage.cost_without_cached(price).alias("cost"))


@query("""SELECT o_orderkey, w AS week_start, strftime(to_timestamp(w + 7200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC+02:00' AS label, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', n / 1024.0::DOUBLE) END AS size FROM
    (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) - 10080 * 60 END AS w, o_orderkey % 4000 AS n FROM orders)""")
def week_labels(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = usage.week_start(F.when(F.col("o_orderkey") % 4 != 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))), F.lit(10080))
    return o.select("o_orderkey", start.alias("week_start"), scalar.zone_label(start, 7200).alias("label"), scalar.human_bytes(F.col("o_orderkey") % 4000).alias("size"))


# State


@query(f"""WITH RECURSIVE {FLOWS}, b AS (SELECT id, event_id % 5 AS k FROM flows), t AS (SELECT k, list_transform([97, 98 + k, 0] || list_transform(range(8), lambda i: CASE WHEN i = 7 THEN k ELSE 0 END), lambda x: x::UBIGINT) AS bytes FROM range(5) AS r(k)),
    w AS (SELECT k, 0 AS i, 14695981039346656037::UHUGEINT AS h, bytes FROM t UNION ALL SELECT k, i + 1, (xor(h::UBIGINT, bytes[i + 1])::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, bytes FROM w WHERE i < len(bytes))
    SELECT b.id, lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS environment FROM b JOIN w ON b.k = w.k WHERE i = len(bytes)""")
def cache_environment(spark, sf_dir):
    """The environment's hash in a cache key."""
    k = F.col("event_id") % 5
    entries = F.array(F.concat(F.lit("a"), F.char(98 + k)))
    return flows(spark, sf_dir).select("id", scalar.fnv64a(entries, k).alias("environment"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AND o_orderkey % 3 <> 0 AND o_orderkey % 7 > 0 AS cacheable, o_orderkey % 2 = 0 AND o_orderkey % 5 = 1 OR o_orderkey % 2 = 1 AND o_orderkey % 5 = 2 AS empty_success,
    epoch_ms(o_orderdate) + 3600000 >= epoch_ms(TIMESTAMP '1996-06-01 00:00:00') AS swept_in FROM orders""")
def cache_rules(spark, sf_dir):
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    left = selection.swept(o.withColumnRenamed("o_orderdate", "expire_at"), F.lit("1996-06-01 00:00:00").cast("timestamp"), 3600).select("o_orderkey", F.lit(True).alias("_in"))
    strategy = F.when(k % 5 == 1, "ipv6_only").when(k % 5 == 2, "ipv4_only").otherwise("prefer_ipv4")
    out = o.select("o_orderkey", selection.cacheable(k % 4, k % 7, k % 3 != 0).alias("cacheable"), selection.short_circuit(F.when(k % 2 == 0, 1).otherwise(28), strategy).alias("empty_success"))
    return out.join(left, "o_orderkey", "left").select("o_orderkey", "cacheable", "empty_success", F.coalesce("_in", F.lit(False)).alias("swept_in"))


@query(f"""WITH {FLOWS}, h AS (SELECT auth_user AS tag, CASE WHEN event_id % 9 <> 0 THEN upload % 900 END AS delay, created_at AS ts FROM flows), l AS (SELECT tag, arg_max(CASE WHEN delay IS NULL THEN -1 ELSE delay END, ts) AS delay, max(ts) AS ts FROM h GROUP BY tag)
    SELECT tag, delay FROM l WHERE delay >= 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) < 86400 * 5""")
def latency_history(spark, sf_dir):
    """Each tag's last measurement, unless it failed or is old."""
    h = flows(spark, sf_dir).select(F.col("auth_user").alias("tag"), F.when(F.col("event_id") % 9 != 0, F.col("upload") % 900).alias("delay"), F.col("created_at").cast("timestamp").alias("ts"))
    return selection.latest(h, "2024-01-31 00:00:00", 86400 * 5).select("tag", "delay")


@query(f"""WITH {FLOWS} SELECT id, 'r' || event_id || '.test' AS value, CAST(event_id % 100 AS INT) AS ttl_s, lpad(lower(to_hex(dst_ip)), 8, '0') AS address FROM flows WHERE event_id % 3 < 2""")
def reverse_answers(spark, sf_dir):
    """Address records become mappings, others don't."""
    i = F.col("event_id")
    record = F.struct(F.when(i % 3 == 0, 1).when(i % 3 == 1, 28).otherwise(5).alias("type"), F.lpad(F.lower(F.hex("dst_ip")), 8, "0").alias("rdata"), (i % 100).cast("int").alias("ttl"))
    a = flows(spark, sf_dir).select(F.col("id").alias("ts"), F.concat(F.lit("r"), i, F.lit(".test")).alias("qname"), F.array(record).alias("answer"))
    return selection.reverse_map(a).select(F.col("ts").alias("id"), "value", "ttl_s", "address")


# Payloads


PACKETS = {
    0: ("1b0006" + "00" * 45, "ntp"), 1: ("000100002112a442" + "11" * 12, "stun"), 2: ("16fefd0000000000000000" + "0010" + "00" * 16, "dtls"), 3: ("0000041727101980" + "00000000" + "01020304", "bittorrent"), 4: ("4100" + "00" * 18, "bittorrent"),
    5: ("123401000001000000000000" + "0161047465737400" + "00010001", "dns"), 6: ("ff" * 20, None),
}


@query(f"WITH {FLOWS} SELECT id, CASE event_id % 7 {' '.join(f'WHEN {k} THEN {chr(39)}{p}{chr(39)}' for k, (_, p) in PACKETS.items() if p)} END AS protocol FROM flows")
def sniff_packets(spark, sf_dir):
    payload = F.expr("CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{h}'" for k, (h, _) in PACKETS.items()) + " END")
    df = flows(spark, sf_dir).select("id", F.unhex(payload).alias("payload"))
    return sniff.classify(df, packet=True).select("id", "protocol")


def _hello(extensions, most: int):
    """A client hello in hexadecimal, with so many extensions before the name."""
    h = lambda c, n: F.lpad(F.hex(c), n, "0")
    name = F.hex(F.concat(F.lit("H"), F.col("event_id") % 1000, F.lit(".test")).cast("binary"))
    n = F.floor(F.length(name) / 2)
    ext = F.concat(F.repeat(F.lit("00FF0000"), (extensions % most).cast("int")), F.lit("0000"), h(n + 5, 4), h(n + 3, 4), F.lit("00"), h(n, 4), name)
    body = F.concat(F.lit("0303" + "AB" * 32 + "00" + "00021301" + "0100"), h(F.floor(F.length(ext) / 2), 4), ext)
    return F.concat(F.lit("01"), h(F.floor(F.length(body) / 2), 6), body)


def _record(data):
    return F.concat(F.lit("160301"), F.lpad(F.hex(F.floor(F.length(data) / 2)), 4, "0"), data)


@query(f"WITH {FLOWS} SELECT id, 'tls' AS protocol, 'h' || event_id % 1000 || '.test' AS domain FROM flows")
def sniff_tls(spark, sf_dir):
    """Hellos with up to a hundred extensions before the name."""
    df = flows(spark, sf_dir).select("id", F.unhex(_record(_hello(F.col("event_id"), 101))).alias("payload"))
    return sniff.classify(df).select("id", "protocol", "domain")


@query(f"""WITH {FLOWS}, p AS (SELECT id, event_id, event_id % 6 AS k FROM flows) SELECT id, CASE k WHEN 0 THEN 'ssh' WHEN 1 THEN 'http' WHEN 2 THEN 'tls' WHEN 3 THEN 'tls' END AS protocol,
    CASE k WHEN 1 THEN 'h' || id || '.example' WHEN 2 THEN 'h' || event_id % 1000 || '.test' WHEN 3 THEN 'h' || event_id % 1000 || '.test' END AS domain, CASE k WHEN 0 THEN 'x_' || id END AS client, k = 4 AS need_more FROM p""")
def sniff_pieces(spark, sf_dir):
    """Streams cut at two places each, of which the hellos of every other one are also cut into two records."""
    i = F.col("event_id")
    hello = _hello(i, 20)
    half = (2 * F.floor(F.length("hello") / 4)).cast("int")
    text = F.expr(r"""CASE event_id % 6 WHEN 0 THEN concat('SSH-2.0-x_', id, '\r\n') WHEN 1 THEN concat('GET / HTTP/1.1\r\nHost: H', id, '.example:80\r\n\r\n') WHEN 4 THEN 'GET / HTTP/1.1\r\nHost: h' WHEN 5 THEN 'hello, world, what is this' END""")
    two = F.concat(_record(F.substring(F.col("hello"), F.lit(1), half)), _record(F.substring(F.col("hello"), half + 1, F.lit(1 << 20))))
    whole = flows(spark, sf_dir).withColumn("hello", hello).select("id", "event_id", F.when(i % 6 == 2, _record(F.col("hello"))).when(i % 6 == 3, two).otherwise(F.hex(text.cast("binary"))).alias("p"))
    n = F.floor(F.length("p") / 2)
    most = F.when(i % 6 == 0, 8).otherwise(n)  # a banner is decided as soon as its first bytes are there
    cuts = whole.select("id", "p", F.array_sort(F.array(F.lit(0), (i % most).cast("int"), (i * 7 % most).cast("int"), n.cast("int"))).alias("at"))
    piece = lambda k: F.struct((k - 1).alias("seq"), F.unhex(F.substring(F.col("p"), 2 * F.element_at("at", k) + 1, 2 * (F.element_at("at", k + 1) - F.element_at("at", k)))).alias("payload"))
    parts = cuts.select("id", F.inline(F.transform(F.sequence(F.lit(3), F.lit(1)), piece)))  # the last one first
    return sniff.classify_pieces(parts, "id", "seq").select("id", "protocol", "domain", "client", "need_more")


def _sealed(df, number, frames):
    """Initial packets of QUIC version 1 in hexadecimal for a connection id (dcid, binary), as a client would send them."""
    h = lambda c, n: F.lpad(F.hex(c), n, "0")
    d = quic.with_keys(df.withColumn("v", F.lit(1).cast("long")), "v", "dcid").withColumns({"n": number, "frames": frames})
    d = d.withColumn("head", F.concat(F.lit("C10000000108"), F.hex("dcid"), F.lit("0000"), h(F.lit(0x4000 + 18) + F.floor(F.length("frames") / 2), 4), h("n", 4)))
    # Spark puts the nonce before what it seals.
    d = d.withColumn("sealed", F.hex(F.aes_encrypt(F.unhex("frames"), F.unhex("key"), F.lit("GCM"), F.lit("DEFAULT"), quic.nonce(F.col("iv"), F.col("n")), F.unhex("head"))).substr(25, 1 << 20))
    d = d.withColumn("mask", quic.mask(F.col("hp"), F.unhex(F.col("sealed").substr(5, 32))))
    xor = lambda x, at, n: h(F.conv(x, 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("mask", at, n), 16, 10).cast("long")), n)
    first = h(F.lit(0xC1).bitwiseXOR(F.conv(F.substring("mask", 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(15))), 2)
    size = F.length("head")
    return d.withColumn("packet", F.concat(first, F.col("head").substr(F.lit(3), size - 6), xor(F.col("head").substr(size - 3, F.lit(4)), 3, 4), F.col("sealed")))


@query(f"""WITH {FLOWS} SELECT event_id AS connection, CASE WHEN event_id % 5 <> 4 THEN 'quic' END AS protocol, CASE WHEN event_id % 5 < 3 THEN 'h' || event_id % 1000 || '.test' END AS domain, event_id % 5 = 3 AS need_more FROM flows""")
def quic_hellos(spark, sf_dir):
    """Hellos in one packet, in two, in pieces out of order, in pieces of which one is lost, and packets that were damaged."""
    i, h = F.col("event_id"), lambda c, n: F.lpad(F.hex(c), n, "0")
    df = flows(spark, sf_dir).select("event_id", F.unhex(h(i * 2654435761, 16)).alias("dcid"), _hello(i, 30).alias("hello"))
    part = lambda a, b: F.concat(F.lit("06"), h(F.lit(0x4000) + a, 4), h(F.lit(0x4000) + (b - a), 4), F.substring("hello", 2 * a + 1, 2 * (b - a)))
    n, a, b = (F.length("hello") / 2).cast("int"), F.lit(20), F.lit(60)
    blank = F.lit("00" * 40 + "01")
    kind = i % 5
    one = F.when(kind.isin(0, 4), F.concat(part(F.lit(0), n), blank)).when(kind == 1, F.concat(part(F.lit(0), a), part(a, b))).when(kind == 2, F.concat(part(b, n), F.lit("0200000000"), blank, part(F.lit(0), a))).otherwise(F.concat(blank, part(a, b)))
    two = F.when(kind.isin(1, 3), part(b, n)).when(kind == 2, F.concat(part(a, b), blank))
    both = _sealed(df, F.lit(0), one).unionByName(_sealed(df.where(kind.isin(1, 2, 3)), F.lit(1), two))
    packet = F.when(kind == 4, F.concat(F.col("packet").substr(F.lit(1), F.length("packet") - 1), F.translate(F.substring("packet", -1, 1), "0123456789ABCDEF", "123456789ABCDEF0"))).otherwise(F.col("packet"))
    return quic.hellos(written(both.select(i.alias("connection"), F.col("n").alias("seq"), F.unhex(packet).alias("payload")), "quic-packets"))


@query(f"WITH {FLOWS}, j AS (SELECT id, '771,' || (4865 + event_id % 4) || '-4866,0-23-' || event_id % 50 || ',29,0' AS ja3 FROM flows) SELECT id, ja3, md5(ja3) AS ja3_md5 FROM j")
def hello_fingerprints(spark, sf_dir):
    i = F.col("event_id")
    grease = F.lit(0x1A1A)
    h = flows(spark, sf_dir).select("id", F.lit(771).alias("version"), F.array(grease, (F.lit(4865) + i % 4).cast("int"), F.lit(4866)).alias("ciphers"), F.array(F.lit(0), grease, F.lit(23), (i % 50).cast("int")).alias("extensions"), F.array(grease, F.lit(29)).alias("groups"), F.array(F.lit(0)).alias("formats"))
    return sniff.ja3(h).select("id", "ja3", "ja3_md5")


# Streams


def _parts(df: DataFrame, order: str, n: int = 4) -> list[DataFrame]:
    """df in n ranges of an order, one after the other."""
    bounds, at = df.approxQuantile(order, [k / n for k in range(1, n)], 0.001), F.col(order)
    return [df.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)) for low, high in zip([None, *bounds], [*bounds, None])]


def _arriving(df: DataFrame, name: str, order: str) -> Iterator[DataFrame]:
    """df as a stream that gets its parts one after the other; a query that is run to the end after each has a batch for each.

    A part is as many files as its scan has tasks, so none goes through one task.
    """
    spark, folder = df.sparkSession, shared(df.sparkSession, name)
    for part in _parts(df, order):
        part.write.mode("append").parquet(folder)
        yield spark.readStream.schema(df.schema).parquet(folder)


@query(SQL["connection_deltas"])
def connection_deltas_stream(spark, sf_dir):
    """connection_deltas from samples that come in four batches, with one small state a connection."""
    s = flows(spark, sf_dir).select(F.col("auth_user").alias("id"), F.col("event_id").alias("ts"), F.expr("upload % 300 div 100 * 50").alias("upload"), F.expr("download % 200 div 100 * 70").alias("download"))
    out, checkpoint = shared(spark, "deltas"), shared(spark, "deltas-state")
    with subscribe.settings(spark):
        for stream in _arriving(s, "samples", "ts"):
            store.to_batches(subscribe.deltas(stream), out, checkpoint).awaitTermination()
    return spark.read.schema("id string, ts long, up_delta long, down_delta long").parquet(out).drop("batch")


@query(SQL["changelog_fold"])
def subscription(spark, sf_dir):
    """A snapshot of the first half of the changes, and then a stream of changes that overlaps with it."""
    ev = flows(spark, sf_dir).select(
        F.col("auth_user").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("inbound") == "signup", "NEW").when(F.col("inbound") == "error", "CLOSED").otherwise("UPDATE").alias("type"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("ts_ms"), F.col("upload").alias("up_delta"), F.col("download").alias("down_delta"),
    )
    half, quarter = ev.approxQuantile("seq", [0.5, 0.25], 0.001)
    snapshot = written(accounting.apply_changes(ev.where(F.col("seq") <= half)).withColumn("seq", F.lit(half).cast("long")), "snapshot")
    out, checkpoint = shared(spark, "subscription"), shared(spark, "subscription-state")
    with subscribe.settings(spark):
        for changes in _arriving(ev.where(F.col("seq") > quarter), "changes", "seq"):
            subscribe.subscribe(changes, snapshot, out, checkpoint).awaitTermination()
    return subscribe.subscribed(spark, out).drop("seq")


@query(f"""WITH {HOSTS}, m AS (SELECT max(page_id) // 2 AS middle FROM hosts) SELECT page_id, CAST(CASE WHEN page_id <= middle THEN 1 ELSE 2 END AS BIGINT) AS version,
    CASE WHEN page_id <= middle THEN host = 'example.com' OR ends_with(host, '.example.com') ELSE contains(host, 'th') END AS matched FROM hosts, m""")
def rules_reloaded(spark, sf_dir):
    """Rules are updated between two runs of a stream; an update that is no valid rule set comes before each run and changes nothing."""
    h, folder, out, checkpoint = hosts(spark, sf_dir), shared(spark, "rules"), shared(spark, "matched"), shared(spark, "matched-state")
    source, middle = shared(spark, "hosts"), h.agg(F.floor(F.max("page_id") / 2)).first()[0]

    def judge(batch: DataFrame) -> DataFrame:
        version, rule_set = store.current(spark, folder)
        return batch.select("page_id", F.lit(version).cast("long").alias("version"), predicate(batch, rule_set.rules[0]).alias("matched"))

    for rule, part in (({"domain_suffix": "example.com"}, h.where(F.col("page_id") <= middle)), ({"domain_keyword": "th"}, h.where(F.col("page_id") > middle))):
        store.publish(spark, folder, json.dumps({"version": 3, "rules": [rule]}))
        for bad in ('{"version": 3, "rules": [{"domain_regex": "a(b"}]}', '{"version": 3, "rules": [{"port": "x"}]}', "{"):
            try:
                store.publish(spark, folder, bad)
            except RuleError:
                continue
            raise AssertionError("an invalid rule set was published")
        part.coalesce(1).write.mode("append").parquet(source)
        store.to_batches(spark.readStream.schema(h.schema).parquet(source), out, checkpoint, judge).awaitTermination()
    return spark.read.schema("page_id long, version long, matched boolean").parquet(out).drop("batch")


@query(f"WITH {FLOWS} SELECT event_id, upload FROM flows")
def timeline_replayed(spark, sf_dir):
    """Samples are written by a stream whose progress is lost between two runs: what it writes again replaces what was there."""
    s, out, folder = flows(spark, sf_dir).select("event_id", "upload"), shared(spark, "timeline"), shared(spark, "timeline-samples")
    for part in _parts(s, "event_id"):
        part.write.mode("append").parquet(folder)
    files = len(spark.read.schema(s.schema).parquet(folder).inputFiles())
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(folder)
    for run in range(2):
        store.to_batches(stream, out, shared(spark, f"timeline-state-{run}"), kind="json").awaitTermination()
    return spark.read.schema("event_id long, upload long").json(out).drop("batch")


# What only had tests


@query(f"""WITH {FLOWS}, f AS (SELECT *, 'd' || event_id % 7 || '.test' AS domain FROM flows) SELECT id, {in_prefixes("dst_ip", ["64.0.0.0/3"])} OR domain IN ('d1.test', 'd2.test') AS cidr_or_name, network = 'tcp' AND dst_port <= 5000 OR network = 'udp' AND domain = 'd3.test' AS either_set,
    domain = 'd4.test' AND network = 'tcp' AS both_in_one, false AS empty_set, false AS empty_with_outer FROM f""")
def ruleset_semantics(spark, sf_dir):
    """Destination prefixes beside a set of names, sets of which one must hold, groups that a set can't lend to another, and empty sets."""
    df = flows(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), F.col("event_id") % 7, F.lit(".test")))
    made = lambda *raw: rules.parse_rule_set({"version": 3, "rules": list(raw)})
    sets = {
        "names": made({"domain": ["d1.test", "d2.test"]}), "tcp": made({"network": "tcp", "port_range": ":5000"}), "udp": made({"network": "udp", "domain": "d3.test"}),
        "one": made({"domain": "d4.test", "network": "tcp"}), "other": made({"domain": "d5.test", "network": "nothing"}), "empty": made(),
    }
    items = {"cidr_or_name": {"ip_cidr": "64.0.0.0/3", "rule_set": "names"}, "either_set": {"rule_set": ["tcp", "udp"]}, "both_in_one": {"rule_set": ["one", "other"]}, "empty_set": {"rule_set": "empty"}, "empty_with_outer": {"inbound": ["view", "click"], "rule_set": "empty"}}
    return judged(df, "id", items, sets=sets)


#: Rules, what dns.mode says of them, whether the first one decides, and what a set of them contains.
TOLD = [
    ({"domain": "a.test"}, "either", True, ""), ({"ip_cidr": "10.0.0.0/8"}, "legacy", True, "contains_ip_cidr"), ({"query_type": 1, "action": "evaluate", "tag": "u"}, "current", False, "contains_query_type"),
    ({"wifi_ssid": "s", "action": "route-options"}, "either", False, "contains_wifi"), ({"process_name": "p", "action": "reject"}, "either", True, "contains_process"),
]


@query(f"""WITH {FLOWS} SELECT id, mode, decides, contains FROM flows JOIN (VALUES {values([(k, m, str(d).lower(), c) for k, (_, m, d, c) in enumerate(TOLD)])}) AS v(k, mode, decides, contains) ON event_id % {len(TOLD)} = k""")
def rules_described(spark, sf_dir):
    """What is told of the rule that each flow names."""
    told = []
    for k, (raw, *_) in enumerate(TOLD):
        rule = parse_rule(raw)
        told.append((k, dns.mode([rule]), str(route.decides(rule)).lower(), ",".join(x for x, yes in rules.metadata([rule]).items() if yes)))
    named = literal(spark, told, "k int, mode string, decides string, contains string")
    return flows(spark, sf_dir).withColumn("k", (F.col("event_id") % len(TOLD)).cast("int")).join(F.broadcast(named), "k").select("id", "mode", "decides", "contains")


@query("SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 3 THEN CAST(l_partkey % 60 AS VARCHAR) ELSE CAST(l_orderkey % 90 AS VARCHAR) END, ',' ORDER BY l_linenumber, l_partkey) AS ttls FROM lineitem GROUP BY l_orderkey")
def ttl_rewritten(spark, sf_dir):
    """The records of an order's lines with one time to live, but for those of the third line, which carry options."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 3, 41).otherwise(1).alias("type"), (F.col("l_partkey") % 60).cast("int").alias("ttl")).alias("r"))
    g = r.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return g.select("l_orderkey", F.array_join(F.transform(selection.with_ttl(F.col("r"), F.col("l_orderkey") % 90), lambda x: x["ttl"].cast("string")), ",").alias("ttls"))


@query("SELECT event_id AS seq, event_type AS level FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def log_ring(spark, sf_dir):
    """The last hundred lines of one level."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("level"))
    return accounting.last_lines(log, 100, "error")


@query(f"WITH {FLOWS} SELECT id, network, created_at AS created FROM flows WHERE event_id % 4 <> 0")
def connections_listed(spark, sf_dir):
    """Chosen columns of connections that do not go to the resolver; a name that isn't a column is an error."""
    i = F.col("event_id")
    c = flows(spark, sf_dir).withColumns({"created": F.col("created_at"), "outbound_type": F.when(i % 4 == 0, "dns").when(i % 4 == 1, "direct")})
    try:
        accounting.listed(c, ("id", "no such column"))
    except ValueError:
        return accounting.listed(accounting.without_dns(c), ("id", "network", "created"))
    raise AssertionError("an unknown column was listed")


@query("SELECT n_name AS tag, row_number() OVER (ORDER BY n_nationkey = 12 DESC, n_nationkey) AS place FROM nation")
def default_goes_first(spark, sf_dir):
    proxies = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("tag"), F.col("n_nationkey").alias("ordinal"))
    default = proxies.where("ordinal = 12").first().tag
    return accounting.default_first(proxies, default).coalesce(1).select("tag", (F.monotonically_increasing_id() + 1).alias("place"))


@query(f"""WITH {FLOWS}, n AS (SELECT id, upload * CAST(power(900, event_id % 5) AS BIGINT) AS n FROM flows), k AS (SELECT *, CASE WHEN n >= 1125899906842624 THEN 5 WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM n)
    SELECT id, CASE WHEN k = 0 THEN n || ' B' ELSE printf('%.1f', round_even(n / power(1024, k), 1)) || ' ' || ['KB', 'MB', 'GB', 'TB', 'PB'][k] END AS size FROM k""")
def sizes_formatted(spark, sf_dir):
    n = F.col("upload") * F.pow(F.lit(900), F.col("event_id") % 5).cast("long")
    return flows(spark, sf_dir).select("id", scalar.human_bytes(n).alias("size"))


@query(f"""WITH {FLOWS}, a AS (SELECT id, event_id % 33 AS bits, dst_ip, CASE WHEN event_id % 9 = 0 THEN 4294967295 ELSE dst_ip END AS four, CASE WHEN event_id % 9 = 0 THEN 4294967295 ELSE src_ip END AS six FROM flows)
    SELECT id, CASE WHEN four < 4294967295 THEN lpad(lower(to_hex(four + 1)), 8, '0') END AS next_four, '20010db8' || lpad(lower(to_hex(six + 1)), 24, '0') AS next_six, lpad(lower(to_hex(dst_ip | ((CAST(1 AS BIGINT) << CAST(32 - bits AS INT)) - 1))), 8, '0') AS last_four FROM a""")
def addresses_after(spark, sf_dir):
    """The next address of either family, with a carry over 32 bits, and the broadcast address of a prefix around an address."""
    h, i = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0")), F.col("event_id")
    top = lambda c: F.when(i % 9 == 0, F.lit(4294967295)).otherwise(F.col(c))
    return flows(spark, sf_dir).select("id", net.after(h(top("dst_ip"), 8)).alias("next_four"), net.after(F.concat(F.lit("20010db8"), h(top("src_ip"), 24))).alias("next_six"), net.last_of(h("dst_ip", 8), i % 33).alias("last_four"))


@query(f"""WITH {HOSTS}, p AS (SELECT DISTINCT 't' || page_id % 4 AS tag, host AS suffix FROM hosts WHERE page_id % 10 = 0 AND host <> '' UNION SELECT 't9', 'example.org')
    SELECT page_id, EXISTS (SELECT 1 FROM p WHERE tag IN ('t0', 't9') AND (host = suffix OR ends_with(host, '.' || suffix))) AS preferred FROM hosts""")
def preferred_by_table(spark, sf_dir):
    """Rules that ask for who prefers a name, answered by a join to a table of preferences."""
    h = hosts(spark, sf_dir)
    p = h.where("page_id % 10 = 0 AND host <> ''").select(F.concat(F.lit("t"), F.col("page_id") % 4).alias("tag"), F.col("host").alias("suffix")).distinct().unionByName(literal(spark, [("t9", "example.org")], "tag string, suffix string"))
    df = enrich.preferred(h, p, "page_id")
    return df.select("page_id", predicate(df, parse_rule({"preferred_by": ["t0", "t9"]})).alias("preferred"))


@query(f"""WITH {FLOWS}, e AS (SELECT event_id AS q, event_id * 37 % 211 AS m, event_id % 6 <> 0 AS m_ok, event_id * 53 % 199 AS n, event_id % 10 < 3 AS n_ok, event_id * 29 % 173 AS r, event_id % 4 <> 0 AS r_ok FROM flows)
    SELECT q AS query_id, CASE WHEN m_ok AND (NOT n_ok OR m <= n) THEN 'm' WHEN n_ok THEN 'n' ELSE 'r' END AS tag, CASE WHEN m_ok AND (NOT n_ok OR m <= n) THEN m WHEN n_ok THEN n ELSE greatest(m, n, r) END AS answered_ms, NOT m_ok AND NOT n_ok AND NOT r_ok AS failed FROM e""")
def dns_race_speculative(spark, sf_dir):
    """Two evaluations race, and a route that was started ahead counts only if both fail."""
    i = F.col("event_id")
    told = F.array(*[F.struct(F.lit(k).alias("rule_idx"), F.lit(tag).alias("tag"), (ms % most).alias("completed_ms"), ok.alias("ok"), F.lit(tag != "r").alias("race"), F.lit(tag == "r").alias("route")) for k, (tag, ms, most, ok) in enumerate((("m", i * 37, 211, i % 6 != 0), ("n", i * 53, 199, i % 10 < 3), ("r", i * 29, 173, i % 4 != 0)))])
    each = flows(spark, sf_dir).select(i.alias("query_id"), F.explode(told).alias("e")).select("query_id", "e.*")
    return dns.race(each.select("query_id", "tag", "completed_ms", "ok"), each.select("query_id", "rule_idx", "tag", "race", "route")).select("query_id", "tag", "answered_ms", "failed")
