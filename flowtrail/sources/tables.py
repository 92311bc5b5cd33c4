"""Recorded inputs as tables: flows, hosts, hosts files, timelines, rule-set sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import RuleSet, parse_rule_set

TIMELINE = "ts timestamp, kind string, counters map<string,bigint>, gauges map<string,double>"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections as a projection of events, which have none: see FIXTURES.md, section 2."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(
        F.concat(F.lit("ev-"), i).alias("id"), i.alias("event_id"), F.col("ts").alias("created_at"), F.concat(F.lit("u"), F.col("user_id")).alias("auth_user"), F.col("event_type").alias("inbound"),
        F.when(i % 3 == 0, "udp").otherwise("tcp").alias("network"), (F.lit(167772160).cast("long") + (i * 40503) % 65536).alias("src_ip"), ((i * 2654435761) % 4294967296).alias("dst_ip"),
        (F.get_json_object("props", "$.k").cast("int") * 100).alias("dst_port"), F.floor(F.col("value") * 100).cast("long").alias("upload"), F.floor(F.col("value") * 1000).cast("long").alias("download"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))


def hosts_file(lines: DataFrame, source_idx: int = 0) -> DataFrame:
    """name, address, source_idx, line of a hosts file (value, line): comments cut, many names to an address."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    kept = lines.select("line", parts.alias("p")).where(F.size("p") >= 2)
    return kept.select(F.explode(F.slice("p", 2, 1 << 30)).alias("name"), F.col("p")[0].alias("address"), F.lit(source_idx).alias("source_idx"), "line").withColumn("name", F.regexp_replace(F.lower("name"), r"\.$", ""))


def rule_sets(spark: SparkSession, paths: dict[str, str]) -> dict[str, RuleSet]:
    """Rule sets in source form by tag. `{tag}` in a path stands for the tag; the form follows the extension.

    All sets are read and checked before any is returned, so a bad one leaves what is in use untouched.
    """
    out = {}
    for tag, path in paths.items():
        path = path.replace("{tag}", tag)
        if path.endswith(".json"):
            out[tag] = parse_rule_set(spark.read.text(path, wholetext=True).first().value)
        elif path.endswith(".srs"):
            from .binary import read_rule_set

            out[tag] = read_rule_set(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
        else:
            raise ValueError(f"rule set {tag}: the format of {path} is not known")
    return out


def timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMELINE).json(path)


def write_timeline(rows: DataFrame, path: str) -> None:
    """Appends samples as JSON lines."""
    rows.write.mode("append").json(path)
