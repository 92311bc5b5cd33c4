"""Filter lists of domain rules: parsing, matching and conversion, as tables of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import label_suffixes
from ..operators.patterns import matches, quoted
from ..plans.rules import RuleError
from ..session import small, written

DOMAIN_NAME = r"^[A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?(\.[A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?)*\.?\z"
ADDRESS = r"^(\d+\.\d+\.\d+\.\d+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)\z"
#: What may stand before the first number of a pattern over addresses.
ADDRESS_PREFIX = r"^(\(https?\?:\\/\\/\)|\^)"
ZERO = ("0.0.0.0", "::", "0:0:0:0:0:0:0:0")


def _is_domain(c: Column) -> Column:
    return F.regexp(c, F.lit(DOMAIN_NAME)) & F.regexp(c, F.lit("[A-Za-z_-]")) & (F.length(c) <= 253)


def parse(lines: DataFrame) -> DataFrame:
    """Adds to lines (value): pattern, raw, exclude, important, suffix, start, end, regex, and why a line is dropped (null: kept).

    Blank lines and comments are not rules and not in the result. Hosts-style lines with an unspecified
    address are exact domains, with another address they are passed over.
    """
    d = lines.where((F.col("value") != "") & ~F.col("value").startswith("!") & ~F.col("value").startswith("#"))
    d = d.withColumn("raw_line", _is_domain(F.col("value")))
    fields = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    hosts = ~F.col("raw_line") & (F.size(fields) == 2) & F.regexp(fields[0], F.lit(ADDRESS)) & _is_domain(F.get(fields, F.lit(1)))
    d = d.withColumns({"hosts": hosts, "address": fields[0], "name": F.get(fields, F.lit(1))})
    line = F.regexp_replace("value", r"\|$", "")
    with_options = ~line.startswith("/") & F.contains(line, F.lit("$"))
    options = F.when(with_options, F.split(F.regexp_extract(line, r"\$(.*)$", 1), ",")).otherwise(F.expr("cast(array() as array<string>)"))
    rewritten = F.concat_ws("|", *[F.lit(f"dnsrewrite={z}") for z in ZERO])
    good = lambda o: (o == "important") | F.startswith(o, F.lit("important=")) | F.array_contains(F.split(rewritten, r"\|"), o)
    d = d.withColumns({"bad_option": F.exists(options, lambda o: ~good(o)), "important": F.exists(options, lambda o: F.startswith(o, F.lit("important"))), "p": F.when(with_options, F.regexp_extract(line, r"^([^$]*)\$", 1)).otherwise(line)})
    d = d.withColumns({"exclude": F.col("p").startswith("@@"), "p": F.regexp_replace(F.regexp_replace("p", "^@@", ""), r"\|$", "")})
    d = d.withColumns({"suffix": F.col("p").startswith("||"), "start": F.col("p").startswith("|") & ~F.col("p").startswith("||"), "p": F.regexp_replace("p", r"^\|\|?", "")})
    d = d.withColumns({"end": F.col("p").endswith("^"), "p": F.regexp_replace("p", r"\^$", "")})
    d = d.withColumn("regex", F.col("p").startswith("/") & F.col("p").endswith("/") & (F.length("p") > 1))
    scheme = ~F.col("regex") & F.contains("p", F.lit("://"))
    d = d.withColumns({"suffix": F.col("suffix") | scheme, "p": F.when(F.col("regex"), F.substring("p", 2, F.length("p") - 2)).when(scheme, F.regexp_extract("p", r"://(.*)$", 1)).otherwise(F.col("p"))})
    checked = F.replace(F.concat(F.when(F.regexp("p", F.lit(r"^[.-]")), "r").otherwise(""), F.col("p")), F.lit("*"), F.lit("x"))
    plain_why = (
        F.when(F.contains("p", F.lit("/")), "path").when(F.regexp("p", F.lit("[?&]")), "query").when(F.regexp("p", F.lit(r"[\[\]()!#]")), "cosmetic")
        .when(F.contains("p", F.lit("~")), "modifier").when(F.col("p") == "", "empty").when(~_is_domain(checked), "not a domain")
    )
    first = F.regexp_extract(F.regexp_replace("p", ADDRESS_PREFIX, ""), r"^(\d+)(\\?\.|\z)", 1)
    of_address = F.coalesce(F.expr("try_cast(first as long)").between(0, 255), F.lit(False))
    d = d.withColumn("first", first).withColumn("of_address", of_address)
    why = F.when(F.col("bad_option"), "modifier").when(F.col("regex"), F.when(F.col("of_address"), "address pattern")).otherwise(plain_why)
    raw = F.col("raw_line")
    host = F.col("hosts")
    d = d.withColumn("dropped", F.when(raw, None).when(host, F.when(F.col("address").isin(*ZERO), None).otherwise("hosts")).otherwise(why))
    plain = lambda c, of_raw, of_host: F.when(raw, of_raw).when(host, of_host).otherwise(F.col(c))
    return d.select(
        *lines.columns, F.when(raw, F.col("value")).when(host, F.col("name")).otherwise(F.col("p")).alias("pattern"), (raw | host).alias("raw"),
        *[plain(c, False, c in ("start", "end")).alias(c) for c in ("exclude", "important", "suffix", "start", "end", "regex")], "dropped",
    )


COLUMNS = ("pattern", "raw", "exclude", "important", "suffix", "start", "end", "regex")


def kept_lines(parsed: DataFrame) -> DataFrame:
    """The lines that are kept. They are written first: a condition on why a line is dropped would be put in terms of the line itself, over and over."""
    return written(parsed.select(*COLUMNS, "dropped"), "filter-lines").where("dropped is null").drop("dropped").distinct()


def line_regex(line: str) -> str:
    """A filter line without options as a pattern over hosts."""
    suffix, start, end = line.startswith("||"), line.startswith("|") and not line.startswith("||"), line.endswith("^")
    body = ".*".join(re.escape(x) for x in line.removeprefix("||").removeprefix("|").removesuffix("^").split("*"))
    return (r"(^|\.)" if suffix else "^" if start else "") + body + ("$" if end else "")


def _pattern() -> Column:
    """A line as a pattern: a regular one as it is, of others `*` is any text and the bounds are those of the line."""
    any_text = F.replace(quoted(F.col("pattern")), F.lit(r"\*"), F.lit(".*"))
    whole = F.concat(F.when(F.col("suffix"), r"(^|\.)").when(F.col("start"), "^").otherwise(""), any_text, F.when(F.col("end"), "$").otherwise(""))
    return F.when(F.col("regex"), F.col("pattern")).otherwise(whole)


def match(hosts: DataFrame, parsed: DataFrame) -> DataFrame:
    """host and blocked for distinct hosts. Important exceptions go before important rules, then exceptions, then rules.

    `||x^` and exact lines, which are nearly all of most lists, are looked up by equality; the others
    are found by the trigrams that they need (operators/patterns.py). A list of raw domains only matches
    exactly. A pattern without a meaning is passed over. All of this is the same for a list of any length.
    """
    kept = kept_lines(parsed)
    if not kept.where("not raw").limit(1).count():
        kept = kept.withColumns({"start": F.lit(True), "end": F.lit(True)})
    kept = kept.withColumns({"pattern": F.when(F.col("regex"), F.col("pattern")).otherwise(F.lower("pattern")), "kind": F.col("important").cast("int") * 2 + F.col("exclude").cast("int")})
    simple = ~F.col("regex") & F.col("end") & ~F.contains("pattern", F.lit("*")) & (F.col("suffix") | F.col("start"))
    h = hosts.select(F.lower("host").alias("host")).where("host <> ''").distinct()
    tails = h.select("host", F.posexplode(label_suffixes(F.col("host"))).alias("at", "tail"))
    table = small(kept.where(simple).select("pattern", "suffix", "kind").distinct())
    equal = tails.join(table, F.col("tail") == F.col("pattern")).where(F.col("suffix") | (F.col("at") == 0)).select("host", "kind")
    tried = matches(h, kept.where(~simple).select(_pattern().alias("pattern"), "kind"))
    kinds = equal.unionByName(tried).groupBy("host").agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"k{k}") for k in range(4)])
    has = lambda k: F.coalesce(F.col(f"k{k}"), F.lit(0)) == 1
    blocked = ~has(3) & (has(2) | ~has(1) & has(0))
    return h.join(kinds, "host", "left").select("host", blocked.alias("blocked"))


def dropped_counts(parsed: DataFrame) -> DataFrame:
    """Why lines are dropped, and how many for each reason."""
    return written(parsed.select("dropped"), "filter-dropped").where("dropped is not null").groupBy("dropped").agg(F.count("*").alias("n"))


#: Lines that one rule may hold as a literal.
RULE_LINES = 100_000


def to_rule(parsed: DataFrame) -> dict:
    """The kept lines as one rule of a rule set. The lines become a literal of RULE_LINES at most; a longer list is an error."""
    rows = written(parsed.select(*COLUMNS, "dropped"), "filter-lines").where("dropped is null").limit(RULE_LINES + 1).collect()
    if len(rows) > RULE_LINES:
        raise RuleError(f"over {RULE_LINES} lines do not make one rule")
    if all(r.raw for r in rows):
        return {"domain": [r.pattern for r in rows]}

    def lines(important: bool, exclude: bool) -> dict | None:
        some = [r for r in rows if r.important == important and r.exclude == exclude]
        if not some:
            return None
        text = lambda r: ("||" if r.suffix else "|" if r.start else "") + r.pattern + ("^" if r.end else "")
        out = {"adguard_domain": [text(r) for r in some if not r.regex], "domain_regex": [r.pattern for r in some if r.regex]}
        return {k: v for k, v in out.items() if v}

    rule = lines(False, False)
    for important, exclude in ((False, True), (True, False), (True, True)):
        other = lines(important, exclude)
        if other is None:
            continue
        if exclude:
            other = other | {"invert": True}
            rule = {"type": "logical", "mode": "and", "rules": [other, rule]} if rule else {"type": "logical", "mode": "and", "rules": [other, {"domain_regex": "a^"}]}
        else:
            rule = {"type": "logical", "mode": "or", "rules": [other, rule]} if rule else other
    return rule or {}


def from_rule(rule: dict) -> list[str]:
    """The lines of a rule that to_rule made; other shapes are an error."""
    if set(rule) == {"domain"}:
        return rule["domain"] if isinstance(rule["domain"], list) else [rule["domain"]]
    out: list[str] = []
    while True:
        important = rule.get("mode") == "or"
        if rule.get("type") == "logical":
            first, rest = rule["rules"]
            exclude = bool(first.get("invert"))
            later = rest.get("type") == "logical" and rest.get("mode") == "or"
            mark = important or exclude and later
            out += _lines(first, exclude, mark)
            rule = rest
            continue
        if rule != {"domain_regex": "a^"}:
            out += _lines(rule, False, False)
        return out


def _lines(rule: dict, exclude: bool, important: bool) -> list[str]:
    if not set(rule) <= {"adguard_domain", "domain_regex", "invert"}:
        raise RuleError("not a rule made from a filter list")
    return [("@@" if exclude else "") + x + ("$important" if important else "") for x in [*rule.get("adguard_domain", []), *(f"/{r}/" for r in rule.get("domain_regex", []))]]
