"""The registered queries of the rule and traffic operators, each beside its SQL.

The tables hold no connections, so flows and hosts are the projections of FIXTURES.md, and rules and
lookup tables are small literals that both sides share.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.net import merged, prefix_range
from .operators import accounting, lookup, selection, sniff, timeseries, usage
from .plans import dns, route
from .plans.compile import predicate
from .plans.rules import RuleSet, parse_rule, parse_rule_set
from .sources import filterlist
from .sources.tables import flows, hosts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FLOWS = """flows AS (SELECT 'ev-' || event_id AS id, event_id, ts AS created_at, 'u' || user_id AS auth_user, event_type AS inbound,
    CASE WHEN event_id % 3 = 0 THEN 'udp' ELSE 'tcp' END AS network, 167772160 + (event_id * 40503) % 65536 AS src_ip, (event_id * 2654435761) % 4294967296 AS dst_ip,
    CAST(json_extract_string(props, '$.k') AS INT) * 100 AS dst_port, CAST(floor(value * 100) AS BIGINT) AS upload, CAST(floor(value * 1000) AS BIGINT) AS download FROM events)"""
HOSTS = "hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def in_prefixes(column: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"{column} BETWEEN {lo} AND {hi}" for _, lo, hi in merged(prefixes)) + ")"


# Rules

MATCH_SET = {"version": 3, "rules": [{"domain_suffix": "example.com"}, {"domain_keyword": "th"}, {"domain_regex": r"^m\."}, {"domain_suffix": ".example.net", "domain": "example.net"}, {"domain": "nothing.example"}]}


@query(rf"""WITH {HOSTS}
    SELECT page_id, 0 AS rule_idx FROM hosts WHERE host = 'example.com' OR host LIKE '%.example.com'
    UNION ALL SELECT page_id, 1 FROM hosts WHERE contains(host, 'th')
    UNION ALL SELECT page_id, 2 FROM hosts WHERE regexp_matches(host, '^m\.')
    UNION ALL SELECT page_id, 3 FROM hosts WHERE host = 'example.net' OR host LIKE '%.example.net'""")
def ruleset_match_all(spark, sf_dir):
    return route.matches(hosts(spark, sf_dir), parse_rule_set(MATCH_SET).rules).select("page_id", "rule_idx")


ROUTES = [
    {"inbound": "error", "network": "udp", "action": "reject"},
    {"ip_cidr": ["10.0.0.0/8", "128.0.0.0/9"], "port_range": ["5000:"], "outbound": "a"},
    {"type": "logical", "mode": "and", "rules": [{"inbound": ["click", "view"]}, {"port": [100, 200, 300, 4200], "invert": True}], "outbound": "b"},
    {"auth_user": ["u1", "u2", "u3"], "action": "bypass"},
    {"source_ip_cidr": "10.0.128.0/17", "action": "hijack-dns"},
    {"network": "tcp", "port_range": ["0:999", "9000:9900"], "outbound": "c"},
]
ROUTE_SQL = f"""CASE WHEN inbound = 'error' AND network = 'udp' THEN 0
    WHEN {in_prefixes("dst_ip", ["10.0.0.0/8", "128.0.0.0/9"])} AND dst_port BETWEEN 5000 AND 65535 THEN 1
    WHEN inbound IN ('click', 'view') AND NOT dst_port IN (100, 200, 300, 4200) THEN 2
    WHEN {in_prefixes("src_ip", ["10.0.128.0/17"])} THEN 4
    WHEN network = 'tcp' AND (dst_port BETWEEN 0 AND 999 OR dst_port BETWEEN 9000 AND 9900) THEN 5 END"""
#: Rejected and hijacked connections leave by no outbound; only those that no rule decides leave by the default.
OUTBOUND_SQL = "CASE WHEN rule_idx = 1 THEN 'a' WHEN rule_idx = 2 THEN 'b' WHEN rule_idx = 5 THEN 'c' WHEN rule_idx IS NULL THEN 'direct' END"


def routed(spark, sf_dir) -> DataFrame:
    return route.route(flows(spark, sf_dir), [parse_rule(r) for r in ROUTES])


@query(f"WITH {FLOWS}, r AS (SELECT id, {ROUTE_SQL} AS rule_idx FROM flows) SELECT id, rule_idx, {OUTBOUND_SQL} AS outbound FROM r")
def route_first_match(spark, sf_dir):
    return routed(spark, sf_dir).select("id", "rule_idx", "outbound")


@query(f"WITH {FLOWS}, r AS (SELECT *, {ROUTE_SQL} AS rule_idx FROM flows) SELECT {OUTBOUND_SQL} AS outbound, count(*) AS n, CAST(sum(upload) AS BIGINT) AS upload, CAST(sum(download) AS BIGINT) AS download FROM r GROUP BY 1")
def route_default_share(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("outbound").agg(F.count("*").alias("n"), F.sum("upload").alias("upload"), F.sum("download").alias("download"))


LOOKUPS = [
    {"inbound": "error", "action": "reject"},
    {"port": [0, 4200, 9900], "port_range": "7000:7100", "outbound": "a"},
    {"ip_cidr": ["10.0.0.0/8", "128.0.0.0/9", "93.184.216.0/24"], "outbound": "b"},
    {"auth_user": ["u1", "u2", "u3"], "outbound": "c"},
    {"network": "udp", "outbound": "d"},
]
LOOKUP_SQL = f"""WITH {FLOWS} SELECT id, CASE WHEN inbound = 'error' THEN 0 WHEN dst_port IN (0, 4200, 9900) OR dst_port BETWEEN 7000 AND 7100 THEN 1
    WHEN {in_prefixes("dst_ip", ["10.0.0.0/8", "128.0.0.0/9", "93.184.216.0/24"])} THEN 2 WHEN auth_user IN ('u1', 'u2', 'u3') THEN 3 WHEN network = 'udp' THEN 4 END AS rule_idx FROM flows"""


@query(LOOKUP_SQL)
def route_lookup_case(spark, sf_dir):
    return route.route(flows(spark, sf_dir), [parse_rule(r) for r in LOOKUPS]).select("id", "rule_idx")


@query(LOOKUP_SQL)
def route_first_match_join(spark, sf_dir):
    return route.by_lookup(flows(spark, sf_dir), [parse_rule(r) for r in LOOKUPS], "id").select("id", "rule_idx")


@query(f"""WITH {FLOWS}, s AS (SELECT id, dst_port, inbound, CASE WHEN dst_port < 1000 THEN 0 WHEN inbound = 'view' THEN 1 WHEN inbound = 'error' THEN 2 END AS rule_idx FROM flows)
    SELECT id, rule_idx, CASE rule_idx WHEN 0 THEN 8080 WHEN 1 THEN 53 ELSE dst_port END AS dst_port, CASE WHEN rule_idx = 0 THEN 'a' WHEN rule_idx = 1 THEN 'b' WHEN rule_idx IS NULL THEN 'direct' END AS outbound,
    CASE rule_idx WHEN 0 THEN 'route' WHEN 1 THEN 'bypass' WHEN 2 THEN 'reject' ELSE 'route' END AS action FROM s""")
def route_overrides(spark, sf_dir):
    """Rules that decide change the destination as well; a rejected connection has no outbound."""
    rules = [{"port_range": ":999", "outbound": "a", "override_port": 8080}, {"inbound": "view", "action": "bypass", "outbound": "b", "override_port": 53}, {"inbound": "error", "action": "reject"}]
    return route.route(flows(spark, sf_dir), [parse_rule(r) for r in rules]).select("id", "rule_idx", "dst_port", "outbound", "action")


@query(f"""WITH {FLOWS}, s AS (SELECT id, dst_port, nullif(inbound, 'click') AS inbound, network, CASE WHEN network = 'udp' AND dst_port = 4400 THEN 80 ELSE dst_port END AS port FROM flows)
    SELECT id, CASE WHEN coalesce(inbound = 'view', false) AND port < 1000 THEN 1 WHEN port = 80 THEN 2 WHEN NOT coalesce(inbound = 'error', false) THEN 3 END AS rule_idx, port AS dst_port FROM s""")
def route_staged(spark, sf_dir):
    """route-options changes the port that later rules see."""
    df = flows(spark, sf_dir).withColumn("inbound", F.nullif("inbound", F.lit("click")))
    rules = [{"network": "udp", "port": 4400, "action": "route-options", "override_port": 80}, {"inbound": "view", "port_range": ":999", "outbound": "a"}, {"port": 80, "outbound": "b"}, {"inbound": "error", "invert": True, "outbound": "c"}]
    return route.route(df, [parse_rule(r) for r in rules]).select("id", "rule_idx", "dst_port")


@query(f"""WITH {FLOWS}, m AS (SELECT id, nullif(inbound, 'click') AS inbound, nullif(dst_port, 4200) AS dst_port, network FROM flows)
    SELECT id, NOT coalesce(inbound = 'view', false) AS not_view, NOT (coalesce(inbound = 'view', false) OR coalesce(dst_port BETWEEN 0 AND 5000, false)) AS neither,
    coalesce(inbound IN ('view', 'error'), false) AND NOT network = 'udp' AS both_of FROM m""")
def logical_invert(spark, sf_dir):
    df = flows(spark, sf_dir).select("id", F.nullif("inbound", F.lit("click")).alias("inbound"), F.nullif("dst_port", F.lit(4200)).alias("dst_port"), "network")
    p = lambda raw: predicate(df, parse_rule(raw))
    return df.select(
        "id", p({"inbound": "view", "invert": True}).alias("not_view"),
        p({"type": "logical", "mode": "or", "invert": True, "rules": [{"inbound": "view"}, {"port_range": ":5000"}]}).alias("neither"),
        p({"type": "logical", "mode": "and", "rules": [{"inbound": ["view", "error"]}, {"network": "udp", "invert": True}]}).alias("both_of"),
    )


PAGE_FLOWS = f"{HOSTS}, f AS (SELECT page_id, host, CASE WHEN page_id % 2 = 0 THEN 443 ELSE 80 END AS dst_port FROM hosts)"


def page_flows(spark, sf_dir) -> DataFrame:
    return hosts(spark, sf_dir).withColumn("dst_port", F.when(F.col("page_id") % 2 == 0, 443).otherwise(80))


def _set(*rules) -> dict:
    return {"s": RuleSet(5, tuple(parse_rule(r, headless=True) for r in rules))}


@query(f"""WITH {PAGE_FLOWS} SELECT page_id, dst_port = 443 AND (contains(host, 'th') OR host LIKE '%.example.com' OR host = 'example.com') AS matched FROM f""")
def ruleset_merge_single(spark, sf_dir):
    """A set with one plain rule joins its groups with the rule's: the address groups become one OR."""
    df = page_flows(spark, sf_dir)
    return df.select("page_id", predicate(df, parse_rule({"domain_keyword": "th", "port": 443, "rule_set": "s"}), sets=_set({"domain_suffix": "example.com"})).alias("matched"))


@query(f"""WITH {PAGE_FLOWS} SELECT page_id, dst_port = 443 AND contains(host, 'th') AND (host LIKE '%.example.com' OR host = 'example.com' OR host LIKE '%.example.org' OR host = 'example.org') AS matched FROM f""")
def ruleset_multi_and(spark, sf_dir):
    """A set with two rules is a condition of its own."""
    df = page_flows(spark, sf_dir)
    return df.select("page_id", predicate(df, parse_rule({"domain_keyword": "th", "port": 443, "rule_set": "s"}), sets=_set({"domain_suffix": "example.com"}, {"domain_suffix": "example.org"})).alias("matched"))


@query(f"""WITH {FLOWS} SELECT id, dst_ip FROM flows WHERE {in_prefixes("dst_ip", ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"])}""")
def private_addr_filter(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.where(predicate(df, parse_rule({"ip_is_private": True}))).select("id", "dst_ip")


@query(f"WITH {FLOWS} SELECT id, dst_port FROM flows WHERE dst_port BETWEEN 0 AND 900 OR dst_port BETWEEN 4000 AND 5500 OR dst_port >= 9800")
def port_range_filter(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.where(predicate(df, parse_rule({"port_range": [":900", "4000:5500", "9800:", "9:1"]}))).select("id", "dst_port")


@query(f"""WITH {FLOWS}, q AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 16 ELSE 1 END AS query_type, dst_ip, inbound FROM flows)
    SELECT event_id, CASE WHEN query_type = 1 AND {in_prefixes("dst_ip", ["0.0.0.0/2"])} THEN 'near' WHEN query_type = 1 AND NOT {in_prefixes("dst_ip", ["128.0.0.0/1"])} AND inbound <> 'error' THEN 'middle'
        WHEN inbound IN ('click', 'error') THEN 'far' ELSE 'default' END AS server FROM q""")
def dns_walk(spark, sf_dir):
    """Rules that depend on addresses are asked of address queries only, and reject answers that do not fit."""
    df = flows(spark, sf_dir).select("event_id", "inbound", F.when(F.col("event_id") % 4 == 0, 16).otherwise(1).alias("query_type"), F.array("dst_ip").alias("response_addresses"))
    rules = [{"ip_cidr": "0.0.0.0/2", "server": "near"}, {"type": "logical", "mode": "and", "rules": [{"ip_cidr": "128.0.0.0/1", "invert": True}, {"inbound": "error", "invert": True}], "server": "middle"}, {"inbound": ["click", "error"], "server": "far"}]
    return dns.walk(df, [parse_rule(r) for r in rules]).select("event_id", "server")


# Lookups

SUFFIXES = [("example.com", 3), (".example.net", 1), ("org", 2), ("tionsh.example.net", 0), ("nowhere.test", 4)]


@query(f"""WITH {HOSTS}, s(suffix, idx) AS (VALUES {values(SUFFIXES)})
    SELECT page_id, min(idx) AS idx FROM hosts JOIN s ON CASE WHEN suffix LIKE '.%' THEN ends_with(host, suffix) ELSE host = suffix OR ends_with(host, '.' || suffix) END GROUP BY page_id""")
def domain_suffix_join(spark, sf_dir):
    return lookup.first_suffix(hosts(spark, sf_dir), literal(spark, SUFFIXES, "suffix string, idx int"), "page_id")


CATEGORIES = [("a", 1, "ample.com"), ("a", 0, "th.example.org"), ("b", 2, "th"), ("b", 3, "^m[.]"), ("b", 1, ".net"), ("c", 0, "none.example"), ("d", 3, "o.*n"), ("d", 2, "er")]
CATEGORY_SQL = f"""{HOSTS}, items(code, type, value) AS (VALUES {values(CATEGORIES)}), h AS (SELECT DISTINCT host FROM hosts WHERE host <> ''),
    hit AS (SELECT host, code, min(type) AS type FROM h JOIN items ON CASE type WHEN 0 THEN host = value WHEN 1 THEN ends_with(host, value) WHEN 2 THEN contains(host, value) ELSE regexp_matches(host, value) END GROUP BY 1, 2)"""


@query(f"WITH {CATEGORY_SQL} SELECT host, code, type FROM hit")
def geosite_lookup_first(spark, sf_dir):
    return lookup.category_lookup(hosts(spark, sf_dir), literal(spark, CATEGORIES, "code string, type int, value string"))


@query(f"WITH {CATEGORY_SQL} SELECT code, count(*) AS n FROM hit GROUP BY code")
def category_counts(spark, sf_dir):
    return lookup.category_counts(geosite_lookup_first(spark, sf_dir))


KINDS = ("domain", "domain_suffix", "domain_keyword", "domain_regex")


@query(f"""WITH {HOSTS}, items AS (SELECT 'c' || page_id % 7 AS code, page_id % 4 AS type, host AS value FROM hosts WHERE host <> ''), f AS (SELECT code, {', '.join(f'coalesce(list_sort(list(value) FILTER (type = {k})), []) AS {n}' for k, n in enumerate(KINDS))} FROM items GROUP BY code)
    SELECT code, {', '.join(f'array_to_string({n}, chr(10)) AS {n}' for n in KINDS)} FROM f""")
def category_export(spark, sf_dir):
    items = hosts(spark, sf_dir).where("host <> ''").select(F.concat(F.lit("c"), F.col("page_id") % 7).alias("code"), (F.col("page_id") % 4).cast("int").alias("type"), F.col("host").alias("value"))
    return lookup.category_rule(items).select("code", *[F.array_join(n, "\n").alias(n) for n in KINDS])


RANGES = [(*prefix_range(p)[1:], code) for p, code in (("0.0.0.0/3", "A"), ("16.0.0.0/5", "B"), ("17.128.0.0/9", "C"), ("96.0.0.0/4", "D"), ("200.10.0.0/16", "E"), ("200.10.7.0/24", "F"), ("250.1.2.3/32", "G"))]


@query(f"WITH {FLOWS}, r(lo, hi, code) AS (VALUES {values(RANGES)}) SELECT id, code FROM flows JOIN r ON dst_ip BETWEEN lo AND hi")
def cidr_range_join(spark, sf_dir):
    return lookup.range_join(flows(spark, sf_dir).select("id", "dst_ip"), literal(spark, RANGES, "lo long, hi long, code string"), "dst_ip").select("id", "code")


@query(f"WITH {FLOWS}, r(lo, hi, code) AS (VALUES {values(RANGES)}) SELECT id, coalesce((SELECT min_by(code, hi - lo) FROM r WHERE dst_ip BETWEEN lo AND hi), 'unknown') AS code FROM flows")
def country_lookup(spark, sf_dir):
    ranges = lookup.disjoint(literal(spark, RANGES, "lo long, hi long, code string"))
    return lookup.range_lookup(flows(spark, sf_dir).select("id", "dst_ip"), ranges, "dst_ip", "unknown").select("id", "code")


@query(f"""WITH {FLOWS}, k AS (SELECT id, event_id, created_at AS ts, dst_ip % 97 AS ip FROM flows), m AS (SELECT ip, ts, 'h' || event_id AS value, 3600 * (1 + event_id % 24) AS ttl_s FROM k WHERE event_id % 5 = 0),
    m1 AS (SELECT ip, ts, max(value) AS value, max_by(ttl_s, value) AS ttl_s FROM m GROUP BY ip, ts), q AS (SELECT id, ip, ts FROM k WHERE event_id % 5 <> 0)
    SELECT q.id, CASE WHEN q.ts < m1.ts + to_seconds(m1.ttl_s) THEN m1.value END AS value FROM q ASOF LEFT JOIN m1 ON q.ip = m1.ip AND q.ts >= m1.ts""")
def reverse_map_asof(spark, sf_dir):
    k = flows(spark, sf_dir).select("id", "event_id", F.col("created_at").alias("ts"), (F.col("dst_ip") % 97).alias("ip"))
    m = k.where("event_id % 5 = 0").select("ip", "ts", F.concat(F.lit("h"), F.col("event_id")).alias("value"), (F.lit(3600) * (1 + F.col("event_id") % 24)).alias("ttl_s"))
    return lookup.asof_join(k.where("event_id % 5 <> 0").select("id", "ip", "ts"), m, "ip").select("id", "value")


CHAINS = "g AS (SELECT 'c' || c_custkey AS tag, CASE WHEN c_custkey % 50 <> 0 THEN 'c' || (c_custkey - 1) WHEN c_custkey // 50 % 5 = 3 THEN 'c' || (c_custkey + 49) ELSE 'leaf' || c_custkey END AS now FROM customer)"


@query(f"""WITH RECURSIVE {CHAINS}, w AS (SELECT tag, now AS leaf, tag || '>' || now AS chain, 1 AS n FROM g UNION ALL SELECT w.tag, g.now, chain || '>' || g.now, n + 1 FROM w JOIN g ON w.leaf = g.tag WHERE n < 60),
    e AS (SELECT w.tag, leaf, chain FROM w LEFT JOIN g ON w.leaf = g.tag WHERE g.tag IS NULL) SELECT DISTINCT g.tag, e.leaf, e.chain FROM g LEFT JOIN e ON g.tag = e.tag""")
def group_chain(spark, sf_dir):
    """A group for each customer, which stands for the one before: chains of up to fifty, some of them cycles."""
    k = F.col("c_custkey")
    now = F.when(k % 50 != 0, F.concat(F.lit("c"), k - 1)).when(F.expr("c_custkey div 50 % 5 = 3"), F.concat(F.lit("c"), k + 49)).otherwise(F.concat(F.lit("leaf"), k))
    groups = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), k).alias("tag"), now.alias("now"))
    return lookup.resolve_chain(groups).select("tag", "leaf", F.array_join("chain", ">").alias("chain"))


HOST_LINES = [("h0", "m.tionsh.example.net", "10.0.0.1", 1, 0), ("h1", "m.tionsh.example.net", "10.0.0.2", 0, 0), ("h2", "example.com", "10.0.0.3", 1, 0), ("h3", "example.com", "10.0.0.4", 1, 1)]


@query(f"""WITH {HOSTS}, t(k, name, address, source_idx, line) AS (VALUES {values(HOST_LINES)}), b AS (SELECT name, min(source_idx) AS s FROM t GROUP BY name)
    SELECT page_id, (SELECT string_agg(address, ',' ORDER BY line) FROM t JOIN b ON t.name = b.name AND t.source_idx = b.s WHERE t.name = hosts.host) AS addresses FROM hosts""")
def hosts_addresses(spark, sf_dir):
    table = literal(spark, HOST_LINES, "k string, name string, address string, source_idx int, line int").drop("k")
    return lookup.hosts_lookup(hosts(spark, sf_dir), table).select("page_id", F.array_join("addresses", ",").alias("addresses"))


# Every mark of a filter line with every other, on parts of hosts in turn; and lines that mean something else.
PARTS = ["th.example.org", "on*.example.net", "er", "m.tionsh.example.com", "an*e", "example.com", "st.example", "in*h.example.org", "re"]
MARKED = [(x, start, PARTS[k % len(PARTS)], end, important) for k, (x, start, end, important) in enumerate(product(("", "@@"), ("", "|", "||"), ("", "^"), ("", "$important")))]
OTHER_LINES = ["! note", "/^on[a-z]+\\./", "/un(closed/", "some/path", "0.0.0.0 atth.example.net", "127.0.0.1 localhost", "example.net^$dnstype=A"]


def _marked_sql() -> str:
    """For each class of lines, whether one of them is about the host."""
    kinds: dict[int, list[str]] = {k: ["false"] for k in range(4)}
    for x, start, part, end, important in MARKED:
        pattern = {"": "", "|": "^", "||": r"(^|\.)"}[start] + part.replace(".", r"\.").replace("*", ".*") + ("$" if end else "")
        kinds[2 * bool(important) + bool(x)].append(f"regexp_matches(host, '{pattern}')")
    kinds[0] += [r"regexp_matches(host, '^on[a-z]+\.')", "host = 'atth.example.net'"]
    return ", ".join(f"{' OR '.join(tests)} AS k{k}" for k, tests in kinds.items())


@query(rf"WITH {HOSTS}, h AS (SELECT DISTINCT host FROM hosts WHERE host <> ''), k AS (SELECT host, {_marked_sql()} FROM h) SELECT host, NOT k3 AND (k2 OR NOT k1 AND k0) AS blocked FROM k")
def filterlist_match(spark, sf_dir):
    return filterlist.match(hosts(spark, sf_dir), filterlist.parse(literal(spark, [(x,) for x in ["".join(m) for m in MARKED] + OTHER_LINES], "value string")))


LISTED = """p AS (SELECT k, page_id, host FROM hosts, range(40) AS r(k) WHERE host <> ''), items AS (SELECT DISTINCT 'c' || k % 7 AS code, 2 AS type, substr(host, CAST(1 + (page_id + k) % 6 AS INT), CAST(3 + k % 5 AS INT)) || CASE WHEN k % 4 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS value FROM p
    UNION SELECT DISTINCT 'r' || k % 3, 3, '^' || substr(host, 1, CAST(1 + k % 4 AS INT)) || '[a-z.]*' || substr(host, CAST(length(host) - k % 5 AS INT)) || '$' FROM p)"""


@query(f"""WITH {HOSTS}, {LISTED}, h AS (SELECT DISTINCT host FROM hosts WHERE host <> '')
    SELECT host, code, min(type) AS type FROM h JOIN items ON CASE type WHEN 2 THEN contains(host, value) ELSE regexp_matches(host, value) END GROUP BY host, code""")
def pattern_list_match(spark, sf_dir):
    """Hosts against a list of keywords and patterns made from every page, forty lines each."""
    part = lambda at, n: F.substring("host", at.cast("int"), n.cast("int"))
    k, h = F.col("k"), hosts(spark, sf_dir)
    lines = h.where("host <> ''").select("page_id", "host", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    words = lines.select(F.concat(F.lit("c"), k % 7).alias("code"), F.lit(2).alias("type"), F.concat(part(1 + (F.col("page_id") + k) % 6, 3 + k % 5), F.when(k % 4 == 0, F.col("page_id").cast("string")).otherwise("")).alias("value"))
    shapes = lines.select(F.concat(F.lit("r"), k % 3).alias("code"), F.lit(3).alias("type"), F.concat(F.lit("^"), part(F.lit(1), 1 + k % 4), F.lit("[a-z.]*"), F.substring("host", F.length("host") - k % 5, F.lit(1 << 20)), F.lit("$")).alias("value"))
    return lookup.category_lookup(h, words.unionByName(shapes).distinct())


# Accounting


@query(f"WITH {FLOWS} SELECT CAST(sum(upload) AS BIGINT) AS upload, CAST(sum(download) AS BIGINT) AS download FROM flows")
def traffic_total(spark, sf_dir):
    return accounting.totals(flows(spark, sf_dir))


COUNTED = {"inbounds": ["click", "view"], "outbounds": ["a", "b", ""], "users": ["u1", "u2", "u3", "u4"]}
COUNTERS = f"""{FLOWS}, r AS (SELECT *, {ROUTE_SQL} AS rule_idx FROM flows), o AS (SELECT *, {OUTBOUND_SQL} AS outbound FROM r),
    n AS (SELECT 'inbound' AS kind, inbound AS tag, upload, download FROM o WHERE inbound IN ('click', 'view') UNION ALL SELECT 'outbound', outbound, upload, download FROM o WHERE outbound IN ('a', 'b')
          UNION ALL SELECT 'user', auth_user, upload, download FROM o WHERE auth_user IN ('u1', 'u2', 'u3', 'u4')),
    c AS (SELECT kind || '>>>' || tag || '>>>traffic>>>uplink' AS name, CAST(sum(upload) AS BIGINT) AS value FROM n GROUP BY 1 UNION ALL SELECT kind || '>>>' || tag || '>>>traffic>>>downlink', CAST(sum(download) AS BIGINT) FROM n GROUP BY 1)"""


@query(f"WITH {COUNTERS} SELECT name, value FROM c")
def traffic_by_dimension(spark, sf_dir):
    return accounting.counters(routed(spark, sf_dir), **COUNTED)


@query(f"WITH {COUNTERS}, p(x) AS (VALUES ('user>>>'), ('>>>uplink'), ('u1')) SELECT name, value FROM c JOIN p ON contains(name, x)")
def stats_query_patterns(spark, sf_dir):
    """A counter that fits several patterns comes back once for each."""
    return accounting.query_counters(traffic_by_dimension(spark, sf_dir), ["user>>>", ">>>uplink", "u1"])


@query(f"""WITH {FLOWS}, p AS (SELECT *, upload // 100 AS up_p, download // 100 AS down_p, CASE WHEN event_id % 11 = 0 THEN '' ELSE auth_user END AS u FROM flows)
    SELECT u AS user, CAST(sum(upload) AS BIGINT) AS uplink_bytes, CAST(sum(download) AS BIGINT) AS downlink_bytes, CAST(coalesce(sum(up_p) FILTER (network = 'udp'), 0) AS BIGINT) AS uplink_packets,
    CAST(coalesce(sum(down_p) FILTER (network = 'udp'), 0) AS BIGINT) AS downlink_packets, count(*) FILTER (network <> 'udp') AS tcp_sessions, count(*) FILTER (network = 'udp') AS udp_sessions FROM p GROUP BY u""")
def ssm_user_stats(spark, sf_dir):
    df = flows(spark, sf_dir).withColumns({"upload_packets": F.floor(F.col("upload") / 100), "download_packets": F.floor(F.col("download") / 100), "auth_user": F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("auth_user"))})
    return accounting.user_stats(df)


@query(f"""WITH {FLOWS}, t AS (SELECT CAST(floor(epoch(created_at) / 60) AS BIGINT) * 60 AS tick, CAST(sum(upload) AS BIGINT) AS up, CAST(sum(download) AS BIGINT) AS down FROM flows GROUP BY 1)
    SELECT tick, up, down, CAST(sum(up) OVER (ORDER BY tick) AS BIGINT) AS total_up, CAST(sum(down) OVER (ORDER BY tick) AS BIGINT) AS total_down FROM t""")
def traffic_per_tick(spark, sf_dir):
    return accounting.per_tick(flows(spark, sf_dir), 60)


CHANGES = f"""{FLOWS}, ev AS (SELECT auth_user AS id, event_id AS seq, CASE inbound WHEN 'signup' THEN 'NEW' WHEN 'error' THEN 'CLOSED' ELSE 'UPDATE' END AS type, epoch_us(created_at) // 1000 AS ts_ms, upload AS up_delta, download AS down_delta FROM flows)"""


@query(f"""WITH {CHANGES}, f AS (SELECT id, max(seq) FILTER (type = 'NEW') AS s FROM ev GROUP BY id), e AS (SELECT ev.* FROM ev JOIN f ON ev.id = f.id AND seq >= s)
    SELECT id, CAST(coalesce(sum(up_delta) FILTER (type <> 'CLOSED'), 0) AS BIGINT) AS uplink_total, CAST(coalesce(sum(down_delta) FILTER (type <> 'CLOSED'), 0) AS BIGINT) AS downlink_total,
    max_by(CASE WHEN type = 'UPDATE' THEN up_delta ELSE 0 END, seq) AS uplink, max_by(CASE WHEN type = 'UPDATE' THEN down_delta ELSE 0 END, seq) AS downlink,
    min(ts_ms) FILTER (type = 'NEW') AS created_ms, max_by(ts_ms, seq) FILTER (type = 'CLOSED') AS closed_ms FROM e GROUP BY id""")
def changelog_fold(spark, sf_dir):
    ev = flows(spark, sf_dir).select(
        F.col("auth_user").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("inbound") == "signup", "NEW").when(F.col("inbound") == "error", "CLOSED").otherwise("UPDATE").alias("type"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("ts_ms"), F.col("upload").alias("up_delta"), F.col("download").alias("down_delta"),
    )
    return accounting.apply_changes(ev)


@query(f"""WITH {FLOWS}, s AS (SELECT auth_user AS id, event_id, upload % 300 // 100 * 50 AS up, download % 200 // 100 * 70 AS down FROM flows),
    d AS (SELECT *, up - coalesce(lag(up) OVER w, 0) AS du, down - coalesce(lag(down) OVER w, 0) AS dd FROM s WINDOW w AS (PARTITION BY id ORDER BY event_id)),
    h AS (SELECT *, du >= 0 AND dd >= 0 AND (du > 0 OR dd > 0) AS had FROM d), b AS (SELECT *, coalesce(lag(had) OVER (PARTITION BY id ORDER BY event_id), false) AS before FROM h)
    SELECT id, event_id AS ts, CASE WHEN had THEN du ELSE 0 END AS up_delta, CASE WHEN had THEN dd ELSE 0 END AS down_delta FROM b WHERE had OR before""")
def connection_deltas(spark, sf_dir):
    s = flows(spark, sf_dir).select(F.col("auth_user").alias("id"), F.col("event_id").alias("ts"), F.expr("upload % 300 div 100 * 50").alias("upload"), F.expr("download % 200 div 100 * 70").alias("download"))
    return accounting.change_events(s)


@query(f"""WITH RECURSIVE {FLOWS}, t AS (SELECT DISTINCT inbound AS key, epoch_us(created_at) // 1000 AS ms FROM flows), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms) AS n FROM t),
    s AS (SELECT key, n, ms, ms AS last, CAST(NULL AS BIGINT) AS idle FROM o WHERE n = 1 UNION ALL SELECT o.key, o.n, o.ms, CASE WHEN o.ms - last < 5400000 THEN last ELSE o.ms END, CASE WHEN o.ms - last >= 5400000 THEN o.ms - last END FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
    SELECT key, ms AS at_ms, idle AS idle_ms FROM s WHERE idle >= 7200000""")
def idle_gaps_ignoring(spark, sf_dir):
    """Breaks of two hours where touches within an hour and a half of the last refresh do not refresh."""
    return accounting.idle_gaps(flows(spark, sf_dir).select("inbound", F.col("created_at").alias("ts")), "inbound", gap_s=7200, ignore_s=5400)


@query(f"""WITH {FLOWS}, t AS (SELECT DISTINCT inbound AS key, epoch_us(created_at) // 1000 AS ms FROM flows), l AS (SELECT key, list(ms ORDER BY ms) AS a FROM t GROUP BY key),
    w AS (SELECT key, unnest(a) AS ms, unnest(list_prepend(NULL, a[1:len(a) - 1])) AS prev FROM l) SELECT key, CAST(ms AS BIGINT) AS at_ms, CAST(ms - prev AS BIGINT) AS idle_ms FROM w WHERE ms - prev >= 1800000""")
def idle_gaps(spark, sf_dir):
    """Breaks of half an hour; every touch refreshes, so a gap is a plain difference here."""
    return accounting.idle_gaps(flows(spark, sf_dir).select("inbound", F.col("created_at").alias("ts")), "inbound", gap_s=1800, ignore_s=0)


CLOSED = f"{FLOWS}, c AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN created_at + to_seconds(event_id % 600) END AS closed_at FROM flows)"


def closed_flows(spark, sf_dir) -> DataFrame:
    return flows(spark, sf_dir).withColumn("closed_at", F.when(F.col("event_id") % 7 != 0, F.col("created_at") + F.make_dt_interval(secs=F.col("event_id") % 600)))


@query(f"WITH {CLOSED} SELECT id, closed_at, upload, download FROM c WHERE closed_at IS NOT NULL ORDER BY closed_at DESC, id DESC LIMIT 1000")
def recent_closed_topn(spark, sf_dir):
    return accounting.recent_closed(closed_flows(spark, sf_dir)).select("id", "closed_at", "upload", "download")


@query(f"WITH {FLOWS} SELECT id, upload + download AS total FROM flows ORDER BY total DESC, id DESC LIMIT 100")
def top_connections(spark, sf_dir):
    return accounting.top(flows(spark, sf_dir), "total", 100).select("id", (F.col("upload") + F.col("download")).alias("total"))


@query(f"WITH {CLOSED} SELECT id, inbound FROM c WHERE closed_at IS NULL")
def active_connections(spark, sf_dir):
    return accounting.in_state(closed_flows(spark, sf_dir), "active").select("id", "inbound")


@query(f"""WITH {FLOWS}, s AS (SELECT auth_user, event_id, (upload * 7919) % 4294967296 AS counter, download AS gauge FROM flows)
    SELECT auth_user, event_id, ((counter - lag(counter) OVER w) % 4294967296 + 4294967296) % 4294967296 AS counter_delta, gauge FROM s WINDOW w AS (PARTITION BY auth_user ORDER BY event_id)""")
def timeline_deltas(spark, sf_dir):
    s = flows(spark, sf_dir).select("auth_user", "event_id", ((F.col("upload") * 7919) % 4294967296).alias("counter"), F.col("download").alias("gauge"))
    return accounting.deltas(s, "auth_user", "event_id", ["counter"], ["counter"]).select("auth_user", "event_id", "counter_delta", "gauge")


# Usage

#: Invented prices for a million tokens.
PRICES = [
    ("^large-2(?:-|$)", {"input": 4.5, "output": 21.0, "cache_read": 0.7, "cache_5m": 5.25, "cache_1h": 8.5, "premium": {"input": 8.0, "output": 31.5, "cache_read": 1.3, "cache_5m": 9.75, "cache_1h": 16.5}}),
    ("^large", {"input": 11.0, "output": 52.0, "cache_read": 1.2, "cache_5m": 13.5, "cache_1h": 23.0}),
    ("^small-[01]$", {"input": 0.4, "output": 1.7, "cache_read": 0.06, "cache_5m": 0.55, "cache_1h": 0.9}),
]
OTHERS = {"input": 2.2, "output": 9.5, "cache_read": 0.35, "cache_5m": 2.9, "cache_1h": 4.7}
REQUESTS = """q AS (SELECT CASE l_partkey % 4 WHEN 0 THEN 'large-2-x' WHEN 1 THEN 'large-3' WHEN 2 THEN 'small-1' ELSE 'other' END AS model, CASE WHEN l_linenumber % 2 = 0 THEN 1000000 ELSE 200000 END AS context_window,
    CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE CAST(epoch(l_shipdate) AS BIGINT) // 604800 * 604800 END AS week_start, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'u' || (o_custkey % 10) END AS user,
    CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_quantity AS BIGINT) * 13 AS output_tokens, l_orderkey % 500 AS cache_read_tokens, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey % 70 END AS cache_5m_tokens,
    CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_suppkey % 9 END AS cache_1h_tokens, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 50 ELSE 0 END AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    cells AS (SELECT model, context_window, week_start, user, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(cache_5m_tokens) AS BIGINT) AS cache_5m_tokens, CAST(sum(cache_1h_tokens) AS BIGINT) AS cache_1h_tokens, CAST(sum(CASE WHEN total = 0 THEN cache_5m_tokens + cache_1h_tokens ELSE total END) AS BIGINT) AS cache_total_tokens FROM q GROUP BY 1, 2, 3, 4)"""


def _price_sql(name: str) -> str:
    out = "CASE"
    for pattern, p in PRICES:
        plain = f"{p[name]}::DOUBLE"
        out += f" WHEN regexp_matches(model, '{pattern}') THEN " + (f"CASE WHEN context_window >= 1000000 THEN {p['premium'][name]}::DOUBLE ELSE {plain} END" if "premium" in p else plain)
    return f"{out} ELSE {OTHERS[name]}::DOUBLE END"


def _cost_sql() -> str:
    p = _price_sql
    writes = f"CASE WHEN cache_5m_tokens > 0 OR cache_1h_tokens > 0 THEN cache_5m_tokens * {p('cache_5m')} + cache_1h_tokens * {p('cache_1h')} ELSE cache_total_tokens * {p('cache_5m')} END"
    return f"CAST(floor((input_tokens * {p('input')} + output_tokens * {p('output')} + cache_read_tokens * {p('cache_read')} + {writes}) / 1000000 * 100 + 0.5) AS BIGINT)"


def usage_requests(spark, sf_dir) -> DataFrame:
    li, o = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    third = F.col("l_linenumber") % 3 == 0
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr("CASE l_partkey % 4 WHEN 0 THEN 'large-2-x' WHEN 1 THEN 'large-3' WHEN 2 THEN 'small-1' ELSE 'other' END").alias("model"), F.when(F.col("l_linenumber") % 2 == 0, 1000000).otherwise(200000).alias("context_window"),
        F.when(F.col("l_suppkey") % 5 == 0, F.lit(0)).otherwise(F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 604800) * 604800).cast("long").alias("week_start"),
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 10)).alias("user"), (F.col("l_quantity").cast("long") * 100).alias("input_tokens"), (F.col("l_quantity").cast("long") * 13).alias("output_tokens"),
        (F.col("l_orderkey") % 500).alias("cache_read_tokens"), F.when(third, F.lit(0)).otherwise(F.col("l_partkey") % 70).alias("cache_5m_tokens"), F.when(third, F.lit(0)).otherwise(F.col("l_suppkey") % 9).alias("cache_1h_tokens"),
        F.when(third, F.col("l_partkey") % 50).otherwise(F.lit(0)).alias("cache_total_tokens"),
    )


@query(f"WITH {REQUESTS} SELECT * FROM cells")
def usage_cells(spark, sf_dir):
    return usage.cells(usage_requests(spark, sf_dir))


@query(f"""WITH {REQUESTS}, a AS (SELECT model, context_window, week_start, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in usage.TOKENS)} FROM cells GROUP BY 1, 2, 3),
    ac AS (SELECT week_start, {_cost_sql()} AS c FROM a), uc AS (SELECT user, week_start, {_cost_sql()} AS c FROM cells WHERE user <> ''),
    v AS (SELECT 'total' AS view, NULL AS user, NULL AS week_start, sum(c) AS c FROM ac UNION ALL SELECT 'user', user, NULL, sum(c) FROM uc GROUP BY user UNION ALL SELECT 'week', NULL, week_start, sum(c) FROM ac WHERE week_start > 0 GROUP BY week_start
    UNION ALL SELECT 'user_week', user, week_start, sum(c) FROM uc WHERE week_start > 0 GROUP BY user, week_start) SELECT view, user, week_start, CAST(c AS DOUBLE) / 100 AS cost FROM v""")
def usage_cost_summary(spark, sf_dir):
    priced = lambda: usage.cost(usage.price(F.col("model"), PRICES, OTHERS, F.col("context_window") >= 1000000))
    return usage.summary(usage.cells(usage_requests(spark, sf_dir)), priced)


FAMILIES = [("^ECONOMY (?:BRUSHED|POLISHED)", {"input": 1.0}), ("TIN$", {"input": 2.0}), ("^PROMO", {"input": 3.0}), ("1[0-9]$", {"input": 4.0})]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^ECONOMY (?:BRUSHED|POLISHED)') THEN 1.0::DOUBLE WHEN regexp_matches(p_type, 'TIN$') THEN 2.0::DOUBLE WHEN regexp_matches(p_type, '^PROMO') THEN 3.0::DOUBLE WHEN regexp_matches(p_type, '1[0-9]$') THEN 4.0::DOUBLE ELSE 9.0::DOUBLE END AS price FROM part")
def price_family_lookup(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", usage.price(F.col("p_type"), FAMILIES, {"input": 9.0})["input"].alias("price"))


# Time series


@query(f"""WITH {FLOWS}, r AS (SELECT auth_user, upload, count(*) OVER (PARTITION BY auth_user) AS n, row_number() OVER (PARTITION BY auth_user ORDER BY upload) AS k FROM flows)
    SELECT auth_user, round(avg(upload), 6) AS mean FROM r WHERE k <= n - CASE WHEN n * 5 // 100 BETWEEN 1 AND n - 1 THEN n * 5 // 100 ELSE 0 END GROUP BY auth_user""")
def trimmed_mean(spark, sf_dir):
    return timeseries.upper_trimmed_mean(flows(spark, sf_dir), "auth_user", "upload").select("auth_user", F.round("mean", 6).alias("mean"))


@query(f"WITH {FLOWS}, l AS (SELECT auth_user, list_sort(list(upload)) AS u FROM flows GROUP BY auth_user) SELECT auth_user, u[len(u) // 2 + 1] AS median FROM l")
def upper_median(spark, sf_dir):
    return timeseries.upper_median(flows(spark, sf_dir), "auth_user", "upload")


STABLE = f"""{FLOWS}, v AS (SELECT auth_user, event_id, 100000 + upload % 9000 AS x FROM flows), a AS (SELECT *, avg(x) OVER w AS average, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY auth_user ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, stddev_pop(average) OVER (PARTITION BY auth_user ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS spread FROM a),
    t AS (SELECT auth_user, event_id, average, n >= 4 AS ready, n >= 4 AND spread <= average * (0.9::DOUBLE / 100) AS stable FROM s)"""


def stability(spark, sf_dir) -> DataFrame:
    v = flows(spark, sf_dir).select("auth_user", "event_id", (F.lit(100000) + F.col("upload") % 9000).alias("x"))
    return timeseries.moving_stability(v, "auth_user", "event_id", "x", tolerance_pct=0.9)


@query(f"WITH {STABLE} SELECT auth_user, event_id, round(average, 6) AS average, ready, stable, CASE WHEN stable THEN 'high' WHEN ready THEN 'medium' ELSE 'low' END AS confidence FROM t")
def moving_stability(spark, sf_dir):
    return stability(spark, sf_dir).withColumn("average", F.round("average", 6))


@query(f"WITH {STABLE} SELECT auth_user, greatest(min(event_id) - 3, 0) AS lower, min(event_id) AS upper FROM t WHERE stable GROUP BY auth_user")
def measurement_window(spark, sf_dir):
    return timeseries.measurement_window(stability(spark, sf_dir), "auth_user", "event_id")


@query(f"""WITH {FLOWS}, l AS (SELECT inbound, auth_user, list(CAST(upload % 1000 AS DOUBLE) ORDER BY event_id) AS u FROM flows GROUP BY inbound, auth_user)
    SELECT inbound || auth_user AS key, round(list_reduce(u, lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * a END), 6) AS ewma, len(u) AS n FROM l""")
def ewma(spark, sf_dir):
    v = flows(spark, sf_dir).select(F.concat("inbound", "auth_user").alias("key"), "event_id", (F.col("upload") % 1000).alias("x"))
    return timeseries.ewma(v, "key", ["event_id"], "x").select("key", F.round("ewma", 6).alias("ewma"), F.col("n").cast("long").alias("n"))


ROUNDS = {"tcp": "event_id % 90", "tls": "event_id % 2 * (event_id % 130)", "http_first": "upload % 200", "http_loaded": "upload % 700 + 1"}


@query(f"""WITH {FLOWS}, r AS (SELECT auth_user, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in ROUNDS.items())} FROM flows),
    l AS (SELECT auth_user, {', '.join(f'list_sort(list({n}) FILTER ({n} > 0)) AS {n}_s' for n in ROUNDS)} FROM r GROUP BY auth_user),
    m AS (SELECT auth_user, {', '.join(f'coalesce(list_avg({n}_s[1:len({n}_s) - CASE WHEN len({n}_s) * 5 // 100 BETWEEN 1 AND len({n}_s) - 1 THEN len({n}_s) * 5 // 100 ELSE 0 END]), 0) AS {n}' for n in ROUNDS)} FROM l),
    p AS (SELECT *, list_filter([tcp, tls, http_first], lambda x: x > 0) AS parts FROM m)
    SELECT auth_user, CASE WHEN http_loaded <= 0 OR len(parts) = 0 THEN 0 ELSE CAST(floor((60000.0::DOUBLE / list_avg(parts) + 60000.0::DOUBLE / http_loaded) / 2 + 0.5) AS INT) END AS rpm FROM p""")
def rpm(spark, sf_dir):
    r = flows(spark, sf_dir).selectExpr("auth_user", *[f"cast({e} as double) as {n}" for n, e in ROUNDS.items()])
    return timeseries.responsiveness(r, "auth_user")


@query(f"""WITH {FLOWS}, s AS (SELECT auth_user, event_id AS i, upload % 5000 AS bps FROM flows WHERE event_id % 4 <> 0), w AS (SELECT auth_user, max(event_id) // 2 AS lower, max(event_id) // 2 + 300 AS upper FROM flows GROUP BY auth_user),
    g AS (SELECT s.auth_user, bps, i BETWEEN lower AND upper AS inside FROM s JOIN w ON s.auth_user = w.auth_user), k AS (SELECT auth_user, bps FROM (SELECT *, bool_or(inside) OVER (PARTITION BY auth_user) AS found FROM g) WHERE inside OR NOT found),
    r AS (SELECT auth_user, bps, count(*) OVER (PARTITION BY auth_user) AS n, row_number() OVER (PARTITION BY auth_user ORDER BY bps) AS k FROM k),
    m AS (SELECT auth_user, avg(bps) AS mean FROM r WHERE k <= n - CASE WHEN n * 5 // 100 BETWEEN 1 AND n - 1 THEN n * 5 // 100 ELSE 0 END GROUP BY auth_user), t AS (SELECT auth_user, CAST(sum(upload) AS BIGINT) AS b FROM flows GROUP BY auth_user)
    SELECT t.auth_user, CAST(coalesce(floor(mean + 0.5), b * 8 // 10) AS BIGINT) AS capacity FROM t LEFT JOIN m ON t.auth_user = m.auth_user""")
def capacity(spark, sf_dir):
    f = flows(spark, sf_dir)
    samples = f.where("event_id % 4 <> 0").select("auth_user", F.col("event_id").alias("interval"), (F.col("upload") % 5000).alias("bps"))
    window = f.groupBy("auth_user").agg(F.max("event_id").alias("m")).selectExpr("auth_user", "m div 2 as lower", "m div 2 + 300 as upper")
    spans = f.groupBy("auth_user").agg(F.sum("upload").alias("total_bytes")).withColumn("seconds", F.lit(10))
    return timeseries.capacity(samples, window, spans, "auth_user")


@query(f"""WITH {FLOWS}, p AS (SELECT id, nullif(event_id % 3, 2) AS m1, nullif(event_id % 4, 3) AS m2, nullif(event_id % 5, 4) AS m3, event_id % 7 = 0 AS f1, nullif(event_id % 2, 1) = 0 AS f2 FROM flows)
    SELECT id, CASE WHEN m1 IS NULL OR m2 IS NULL THEN 'unknown' WHEN m1 = m2 THEN 'endpoint_independent' WHEN m3 IS NULL THEN 'unknown' WHEN m2 = m3 THEN 'address_dependent' ELSE 'address_and_port_dependent' END AS mapping,
    CASE WHEN f1 THEN 'endpoint_independent' WHEN coalesce(f2, false) THEN 'address_dependent' ELSE 'address_and_port_dependent' END AS filtering FROM p""")
def nat_class(spark, sf_dir):
    p = flows(spark, sf_dir).selectExpr("id", "nullif(event_id % 3, 2) as mapped1", "nullif(event_id % 4, 3) as mapped2", "nullif(event_id % 5, 4) as mapped3", "event_id % 7 = 0 as filter1", "nullif(event_id % 2, 1) = 0 as filter2")
    return timeseries.nat_class(p).select("id", "mapping", "filtering")


# Selection and state


@query(f"""WITH RECURSIVE {FLOWS}, h AS (SELECT auth_user AS g, event_id, CASE WHEN upload % 7 <> 0 THEN CAST(CASE WHEN upload % 13 = 0 THEN 65500 + upload % 36 ELSE upload % 900 + 1 END AS INT) END AS delay, network = 'tcp' AS capable FROM flows),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) AS k FROM h), c AS (SELECT g, min(event_id) FILTER (capable) AS first, max(event_id) AS cur FROM o GROUP BY g), cap AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) AS j FROM o WHERE capable),
    w AS (SELECT c.g, CAST(0 AS BIGINT) AS j, coalesce(cap.delay, 0) AS m, CASE WHEN cap.delay IS NOT NULL THEN c.cur END AS pick FROM c LEFT JOIN cap ON cap.g = c.g AND cap.event_id = c.cur
          UNION ALL SELECT w.g, cap.j, CASE WHEN delay IS NOT NULL AND (m = 0 OR m > (delay + 50) % 65536) THEN delay ELSE m END, CASE WHEN delay IS NOT NULL AND (m = 0 OR m > (delay + 50) % 65536) THEN cap.event_id ELSE pick END FROM w JOIN cap ON cap.g = w.g AND cap.j = w.j + 1),
    e AS (SELECT g, max_by(pick, j) AS _p, arg_max(CASE WHEN pick IS NULL THEN -1 ELSE pick END, j) AS p FROM w GROUP BY g)
    SELECT e.g AS "group", CASE WHEN p >= 0 THEN p ELSE first END AS pick, p >= 0 AS measured FROM e JOIN c ON e.g = c.g""")
def latency_select(spark, sf_dir):
    delay = F.expr("CASE WHEN upload % 7 <> 0 THEN cast(CASE WHEN upload % 13 = 0 THEN 65500 + upload % 36 ELSE upload % 900 + 1 END as int) END")
    m = flows(spark, sf_dir).select(F.col("auth_user").alias("group"), F.struct(F.col("event_id").alias("ordinal"), F.col("event_id").alias("tag"), delay.alias("delay"), (F.col("network") == "tcp").alias("capable")).alias("m"))
    g = m.groupBy("group").agg(F.collect_list("m").alias("members"), F.max("m.tag").alias("current"))
    return selection.latency_pick(g)


@query("""SELECT o_orderkey, CASE WHEN left_s >= 0 THEN 'hit' WHEN left_s + 86400 * 200 > 0 THEN 'stale' ELSE 'expired' END AS state, CASE WHEN left_s >= 0 THEN left_s WHEN left_s + 86400 * 200 > 0 THEN 1 END AS ttl
    FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - CAST(epoch(TIMESTAMP '1996-06-01 00:00:00') AS BIGINT) AS left_s FROM orders)""")
def cache_freshness(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderdate", "expire_at")
    return selection.freshness(o, F.lit("1996-06-01 00:00:00").cast("timestamp"), 86400 * 200).select("o_orderkey", "state", "ttl")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 3 THEN 41 WHEN 4 THEN 6 ELSE 1 END AS type, CAST(l_partkey % 60 AS BIGINT) AS ttl, CAST(l_suppkey % 60 AS BIGINT) AS minttl FROM lineitem),
    s AS (SELECT l_orderkey, coalesce(list(ttl ORDER BY l_linenumber, ttl, minttl) FILTER (l_linenumber <= 2 AND l_orderkey % 3 <> 0), []) AS a, list(ttl ORDER BY l_linenumber, ttl, minttl) FILTER (l_linenumber >= 4) AS n, (list(ttl ORDER BY ttl, minttl) FILTER (l_linenumber = 4))[1] AS soa, (list(minttl ORDER BY ttl, minttl) FILTER (l_linenumber = 4))[1] AS soa_min FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN len(a) = 0 AND soa IS NOT NULL THEN least(soa, soa_min) ELSE list_reduce(list_concat([0::BIGINT], a, coalesce(n, [])), lambda x, t: CASE WHEN x = 0 OR t > 0 AND t < x THEN t ELSE x END) END AS ttl FROM s""")
def min_ttl(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", F.expr("CASE l_linenumber WHEN 3 THEN 41 WHEN 4 THEN 6 ELSE 1 END").alias("type"), (F.col("l_partkey") % 60).alias("ttl"), (F.col("l_suppkey") % 60).alias("minttl")).alias("r"))
    g = r.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    part = lambda test: F.filter("r", lambda x: test(x["l_linenumber"]))
    answer = F.filter("r", lambda x: (x["l_linenumber"] <= 2) & (F.col("l_orderkey") % 3 != 0))
    return g.select("l_orderkey", selection.min_ttl(answer, part(lambda n: n >= 4), part(lambda n: n == 3)).alias("ttl"))


@query(f"WITH {HOSTS}, f AS (SELECT host, min(page_id) AS m FROM hosts WHERE host <> '' GROUP BY host) SELECT host AS domain, 3323068416 + 1 + row_number() OVER (ORDER BY m, host) AS address FROM f")
def fakeip_alloc(spark, sf_dir):
    return selection.synthetic_addresses(hosts(spark, sf_dir).where("host <> ''").select(F.col("host").alias("domain"), F.col("page_id").alias("seq")), 3323068416, 1 << 17)


POOL_SIZE = 23


@query(f"""WITH RECURSIVE {FLOWS}, q AS (SELECT inbound AS pool, 'd' || dst_ip % 41 AS domain, row_number() OVER (PARTITION BY inbound ORDER BY event_id) AS n FROM flows),
    s AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ring, CAST(-1 AS BIGINT) AS last FROM q
          UNION ALL SELECT s.pool, q.n, CASE WHEN list_contains(ring, domain) THEN ring WHEN len(ring) < {POOL_SIZE - 3} THEN list_append(ring, domain) ELSE list_transform(ring, lambda x, i: CASE WHEN i - 1 = (last + 1) % {POOL_SIZE - 3} THEN domain ELSE x END) END,
                 CASE WHEN list_contains(ring, domain) THEN last ELSE last + 1 END FROM s JOIN q ON q.pool = s.pool AND q.n = s.n + 1),
    e AS (SELECT pool, arg_max(ring, n) AS ring FROM s GROUP BY pool) SELECT pool, unnest(ring) AS domain, CAST(1001 + generate_subscripts(ring, 1) AS BIGINT) AS address FROM e""")
def addresses_issued_again(spark, sf_dir):
    """More domains ask than a pool has addresses; the requests come in two parts, the second going on from what the first left."""
    q = flows(spark, sf_dir).select(F.col("inbound").alias("pool"), F.concat(F.lit("d"), F.col("dst_ip") % 41).alias("domain"), F.col("event_id").alias("seq"))
    early = q.where(F.col("seq") < 500)
    return selection.allocated(q.where(F.col("seq") >= 500), 1000, POOL_SIZE, held=selection.allocated(early, 1000, POOL_SIZE)).select("pool", "domain", "address")


@query(f"""WITH RECURSIVE {FLOWS}, q AS (SELECT 'n' || dst_ip % 40 AS key, event_id AS id, epoch_us(created_at) // 1000 AS at_ms, 1000 * 3600 * (event_id % 9) AS took_ms FROM flows),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, id) AS n FROM q),
    s AS (SELECT key, n, id, id AS leader, at_ms + greatest(took_ms, 1) AS busy FROM o WHERE n = 1
          UNION ALL SELECT o.key, o.n, o.id, CASE WHEN o.at_ms >= busy THEN o.id ELSE leader END, CASE WHEN o.at_ms >= busy THEN o.at_ms + greatest(took_ms, 1) ELSE busy END FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
    SELECT id, leader FROM s""")
def requests_coalesced(spark, sf_dir):
    """Questions that come while the same one is being asked wait for its answer."""
    q = flows(spark, sf_dir).select(F.concat(F.lit("n"), F.col("dst_ip") % 40).alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("at_ms"), (F.col("event_id") % 9 * 3_600_000).alias("took_ms"))
    return selection.coalesced(q).select("id", "leader")


@query(f"""WITH {FLOWS}, a AS (SELECT id, [lpad(lower(to_hex(dst_ip)), 8, '0'), '20010db8' || lpad(lower(to_hex(src_ip)), 24, '0'), lpad(lower(to_hex(src_ip)), 8, '0')] AS x FROM flows)
    SELECT id, array_to_string(list_concat(list_filter(x, lambda y: length(y) = 8), list_filter(x, lambda y: length(y) = 32)), ',') AS v4_first, array_to_string(list_concat(list_filter(x, lambda y: length(y) = 32), list_filter(x, lambda y: length(y) = 8)), ',') AS v6_first FROM a""")
def address_order(spark, sf_dir):
    h = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    x = F.array(h("dst_ip", 8), F.concat(F.lit("20010db8"), h("src_ip", 24)), h("src_ip", 8))
    return flows(spark, sf_dir).select("id", F.array_join(selection.address_order(x), ",").alias("v4_first"), F.array_join(selection.address_order(x, True), ",").alias("v6_first"))


@query(f"""WITH {FLOWS}, p AS (SELECT id, event_id % 6 AS k FROM flows) SELECT id, CASE k WHEN 0 THEN 'ssh' WHEN 1 THEN 'http' WHEN 2 THEN 'bittorrent' WHEN 4 THEN 'rdp' END AS protocol,
    CASE WHEN k = 1 THEN 'h' || id || '.example' END AS domain, CASE WHEN k = 0 THEN 'x_' || id END AS client, k IN (3, 5) AS need_more FROM p""")
def sniff_streams(spark, sf_dir):
    payload = F.expr(r"""CASE event_id % 6 WHEN 0 THEN concat('SSH-2.0-x_', id, '\r\n') WHEN 1 THEN concat('GET / HTTP/1.1\r\nHost: H', id, '.example:80\r\n\r\n') WHEN 2 THEN concat(chr(19), 'BitTorrent protocol', id)
        WHEN 3 THEN 'SSH-2' WHEN 5 THEN 'hello' END""").cast("binary")
    rdp = F.unhex(F.lit("030000130ee000000000000100080003000000"))
    df = flows(spark, sf_dir).select("id", F.when(F.col("event_id") % 6 == 4, rdp).otherwise(payload).alias("payload"))
    return sniff.classify(df).select("id", "protocol", "domain", "client", "need_more")

