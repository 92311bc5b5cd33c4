"""Sources and sinks: filter lists, hosts files, binary rule sets, category files, timelines."""

import itertools

import pytest
from pyspark.sql import functions as F

from flowtrail.plans.compile import predicate
from flowtrail.plans.rules import RuleError, RuleSet, parse_rule, parse_rule_set, rule_set_json
from flowtrail.sources import binary, filterlist, tables

#: (exclude, start, name, end, important): every mark with every other, each on a name of its own and on one that all share.
MARKS = list(itertools.product(("", "@@"), ("", "|", "||"), ("", "^"), ("", "$important")))
LINES = [(x, start, name, end, important) for k, (x, start, end, important) in enumerate(MARKS) for name in (f"own{k}.test", f"w{k}*d.test", f"both{k % 5}.test")]
PATTERNS = [(x, "", f"/^re{k}[0-9]+\\./", "", important) for k, (x, important) in enumerate([("", ""), ("@@", ""), ("@@", "$important")])]  # one that begins with a slash has no options


def finds(line, host):
    """Whether the line is about the host, in plain string tests."""
    _, start, name, end, _ = line
    if name.startswith("/"):
        label = host.split(".")[0]
        return "." in host and label.startswith(name[2:5]) and label[3:].isdigit()
    head, _, tail = name.partition("*")
    places = [i for i in range(len(host)) if host.startswith(head, i)]
    places = [i for i in places if not start or i == 0 or start == "||" and host[i - 1] == "."]
    rest = [host[i + len(head) :] for i in places]
    if "*" in name:
        return any(r.endswith(tail) if end else tail in r for r in rest)
    return any(not end or r == "" for r in rest)


def blocked(host, lines):
    kinds = {(bool(x[4]), bool(x[0])) for x in lines if finds(x, host)}
    return (True, True) not in kinds and ((True, False) in kinds or (False, True) not in kinds and (False, False) in kinds)


NAMES = sorted({x[2].replace("*", "mid") for x in LINES}) + [f"re{k}7.test" for k in range(3)] + ["re1.test", "other.test"]
HOSTS = [pre + name + post for name in NAMES for pre in ("", "www.", "not") for post in ("", ".zz", "zz")]


def lines(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


def written_out(xs):
    return ["".join(x) for x in xs]


def test_filter_list(spark):
    every = LINES + PATTERNS
    parsed = filterlist.parse(lines(spark, written_out(every)))
    hosts, want = spark.createDataFrame([(h,) for h in HOSTS], "host string"), {h: blocked(h, every) for h in HOSTS}
    assert 20 < sum(want.values()) < len(want) - 20
    assert {r.host: r.blocked for r in filterlist.match(hosts, parsed).collect()} == want
    rule = filterlist.to_rule(parsed)
    m = predicate(hosts, parse_rule(rule, headless=True))
    assert {r.host: r.m for r in hosts.select("host", m.alias("m")).collect()} == want
    assert sorted(filterlist.from_rule(rule)) == sorted(written_out(every))
    with pytest.raises(RuleError):
        filterlist.from_rule({"port": 1})


ODD = ["/ba(d/", "/org$/", "/a**/", "/x{1001}/", "/(?=look)/", "/^li(ne|st)[0-9]*\\.test$/", "/[[:digit:]]{3}/", "/(?i)UPPER/", "st*r.test"]


def test_lists_of_any_length_mean_the_same(spark):
    """Patterns without a meaning are passed over and `$` is the end of the text, in a list of ten lines and of 50,000."""
    hosts = ["x.org", "x.org\n", "bad.test", "line7.test", "list.test", "line7.testx", "a123.test", "upper.test", "star.test", "stxr.test", "none.test"]
    want = {"x.org", "line7.test", "list.test", "a123.test", "upper.test", "star.test", "stxr.test"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    filler = spark.range(50_000).selectExpr("concat('fil', id, '*ler.test') AS value")
    for given in (lines(spark, ODD), lines(spark, ODD).union(filler)):
        made = filterlist.match(df, filterlist.parse(given))
        assert {r.host for r in made.where("blocked").collect()} == want
        assert "NestedLoop" not in made._jdf.queryExecution().toString() and "Cartesian" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("xs, hit, free", [(["192.168.7.7 router", "fe80::7 router #note", "0.0.0.0 pop.test"], ["pop.test"], ["x.pop.test", "mypop.test", "router"]), (["a.raw.test", "raw2.test"], ["a.raw.test", "raw2.test"], ["raw.test", "b.raw2.test", "xraw2.test"])])
def test_hosts_lines_and_raw_domains(spark, xs, hit, free):
    hosts = spark.createDataFrame([(h,) for h in hit + free], "host string")
    got = {r.host: r.blocked for r in filterlist.match(hosts, filterlist.parse(lines(spark, xs))).collect()}
    assert got == {**dict.fromkeys(hit, True), **dict.fromkeys(free, False)}


def test_dropped_lines(spark):
    xs = ["", "! c", "# c", "||a.example^$third-party", "a.example/path", "a.example?x", "a##b", "~a.example", "@@||^", "/\\d+\\.\\d+/", "/^10\\.1/", "/(https?:\\/\\/)99.1/", "/7/", "/256\\.1/", "||b.example^$dnsrewrite=0.0.0.0", "|https://c.example^", "1.2.3.4 d.example"]
    got = {r.value: r.dropped for r in filterlist.parse(lines(spark, xs)).collect()}
    assert "" not in got and "! c" not in got
    assert {k for k, v in got.items() if v is None} == {"/\\d+\\.\\d+/", "/256\\.1/", "||b.example^$dnsrewrite=0.0.0.0", "|https://c.example^"}  # only a number up to 255 makes an address


def test_hosts_file(spark):
    df = spark.createDataFrame([(0, "# comment"), (1, "10.0.0.1 A.example b.example # x"), (2, "10.0.0.2"), (3, " ::1\tA.example. ")], "line int, value string")
    assert sorted((r.name, r.address, r.line) for r in tables.hosts_file(df).collect()) == [("a.example", "10.0.0.1", 1), ("a.example", "::1", 3), ("b.example", "10.0.0.1", 1)]


RULES = {
    "version": 5,
    "rules": [
        {"query_type": [1, 65535], "network": "tcp", "domain": ["b.example", "a.example", "日本.example"], "domain_suffix": ["example.com", ".example.net", "a.example"], "domain_keyword": "x", "domain_regex": ["^a$", "b"]},
        {"source_ip_cidr": ["10.0.0.0/8", "2001:db8::/33"], "ip_cidr": ["1.2.3.4/32", "192.168.0.0/16"], "source_port": 1, "source_port_range": ":9", "port": [80, 443], "port_range": "1:2", "invert": True},
        {"type": "logical", "mode": "and", "invert": True, "rules": [{"process_name": "p"}, {"type": "logical", "mode": "or", "rules": [{"process_path": "/p"}, {"package_name": "q"}]}]},
        {"process_path_regex": "z", "package_name_regex": "y", "wifi_ssid": "s", "wifi_bssid": "t", "network_type": ["wifi", "ethernet"], "network_is_expensive": True, "network_is_constrained": True, "network_interface_address": {"wifi": ["10.1.0.0/16"]}, "default_interface_address": ["fd00::/8"]},
    ],
}


def test_binary_rule_set_round_trip(spark, tmp_path):
    original = parse_rule_set(RULES)
    data = binary.write_rule_set(original)
    back = rule_set_json(binary.read_rule_set(data))
    order = lambda x: sorted(map(order, x), key=str) if isinstance(x, list) else {k: order(v) for k, v in x.items()} if isinstance(x, dict) else x
    assert order(back["rules"][0]) == order(rule_set_json(original)["rules"][0]) and back["rules"][2:] == rule_set_json(original)["rules"][2:]
    assert order(back) == order(rule_set_json(original))
    (tmp_path / "a.srs").write_bytes(data)
    (tmp_path / "b.srs").write_bytes(data)
    assert binary.rules_of_files(spark, f"{tmp_path}/*.srs").count() == 8
    assert tables.rule_sets(spark, {"a": f"{tmp_path}/{{tag}}.srs"})["a"].version == 5


def test_domain_set_of_many_names():
    names = ["".join(p) + ".example" for p in itertools.product("abc", repeat=5)]
    r = binary.Reader(binary._domains(names[::2], names[1::2]))
    domains, suffixes = binary._read_domains(r)
    assert sorted(domains) == sorted(names[::2]) and sorted(suffixes) == sorted(names[1::2])


@pytest.mark.parametrize("damage", [lambda d: b"XRS" + d[3:], lambda d: d[:3] + b"\x63" + d[4:], lambda d: d[:-10], lambda d: d[:4], lambda d: b""])
def test_malformed_binary_rule_sets(damage):
    with pytest.raises(RuleError):
        binary.read_rule_set(damage(binary.write_rule_set(parse_rule_set(RULES))))


def test_nesting_limit():
    rule = {"port": 1}
    for _ in range(102):
        rule = {"type": "logical", "mode": "or", "rules": [rule]}
    with pytest.raises(RuleError):
        parse_rule(rule, headless=True)


def test_category_file_round_trip(spark, tmp_path):
    items = {"b": [(0, "x.example"), (3, "^é$")], "a": [(1, ".net")], "c": []}
    data = binary.write_categories(items)
    assert list(binary.read_categories(data)) == [("a", 1, ".net"), ("b", 0, "x.example"), ("b", 3, "^é$")]
    (tmp_path / "geo.db").write_bytes(data)
    assert binary.categories_of_files(spark, f"{tmp_path}/geo.db").count() == 3
    with pytest.raises(RuleError):
        list(binary.read_categories(b"\x01" + data[1:]))


def test_json_rule_sets_load_all_or_none(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"version": 2, "rules": [{"domain": "a"}]}')
    (tmp_path / "y.json").write_text('{"version": 9, "rules": []}')
    assert tables.rule_sets(spark, {"x": f"{tmp_path}/x.json"})["x"] == RuleSet(2, (parse_rule({"domain": "a"}, headless=True),))
    with pytest.raises(RuleError):
        tables.rule_sets(spark, {"x": f"{tmp_path}/x.json", "y": f"{tmp_path}/y.json"})
    with pytest.raises(ValueError):
        tables.rule_sets(spark, {"z": f"{tmp_path}/z.txt"})


def test_timeline(spark, tmp_path):
    rows = spark.createDataFrame([(1, "sample", {"up": 5}, {"w": 1.5})], "t long, kind string, counters map<string,long>, gauges map<string,double>").select(F.timestamp_seconds("t").alias("ts"), "kind", "counters", "gauges")
    tables.write_timeline(rows, f"{tmp_path}/t")
    tables.write_timeline(rows, f"{tmp_path}/t")
    assert tables.timeline(spark, f"{tmp_path}/t").where("counters['up'] = 5").count() == 2
