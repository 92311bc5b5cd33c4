"""What connections get before rules are asked: owner, neighbour, names for addresses, address family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import asof_join, small, suffix_join

MISSING = "no name for this synthetic address"


def enrich(df: DataFrame, processes: DataFrame | None = None, neighbours: DataFrame | None = None, synthetic: DataFrame | None = None, pool: tuple[int, int] | None = None, answers: DataFrame | None = None, at: str = "created_at") -> DataFrame:
    """df with process_path, user_id, src_mac, src_hostname, domain, origin_ip, error and ip_version, in this order.

    df has network, src_ip, src_port, dst_ip (LONG: IPv4, or keys) and may have domain. processes: network,
    src_ip, src_port, process_path, user_id. neighbours: src_ip, src_mac, src_hostname. synthetic: address,
    domain, of addresses in `pool` (first, last). answers: dst_ip, `at`, value (name) and ttl_s.

    A destination in the pool is replaced by its name: origin_ip keeps the address and dst_ip is null; a name
    that is missing is an error of that row. Other rows without a domain get the name that was answered
    last for their address and has not expired. Lookup tables are unique by their keys.
    """
    out = df if "domain" in df.columns else df.withColumn("domain", F.lit(None).cast("string"))
    if processes is not None:
        out = out.join(small(processes), ["network", "src_ip", "src_port"], "left")
    if neighbours is not None:
        out = out.join(small(neighbours), "src_ip", "left")
    out = out.withColumns({"origin_ip": F.lit(None).cast(df.schema["dst_ip"].dataType), "error": F.lit(None).cast("string")})
    if synthetic is not None and pool is not None:
        names = small(synthetic.select(F.col("address").alias("dst_ip"), F.col("domain").alias("_name")))
        inside = F.coalesce(F.col("dst_ip").between(*pool), F.lit(False))
        out = out.join(names, "dst_ip", "left")
        named = inside & F.col("_name").isNotNull()
        out = out.withColumns({
            "error": F.when(inside & F.col("_name").isNull(), MISSING), "origin_ip": F.when(named, F.col("dst_ip")),
            "domain": F.when(named, F.col("_name")).otherwise(F.col("domain")), "dst_ip": F.when(~named, F.col("dst_ip")),
        }).drop("_name")
    if answers is not None:
        found = asof_join(out, answers, "dst_ip", at)
        blank = (F.coalesce("domain", F.lit("")) == "") & F.col("error").isNull()
        out = found.withColumn("domain", F.when(blank, F.col("value")).otherwise(F.col("domain"))).drop("value")
    six = F.length("dst_ip") == 32 if df.schema["dst_ip"].dataType.simpleString() == "string" else F.lit(False)
    return out.withColumn("ip_version", F.when(F.col("dst_ip").isNotNull(), F.when(six, 6).otherwise(4)))


def preferred(df: DataFrame, preferences: DataFrame, row_id: str, host: str = "host") -> DataFrame:
    """df with preferred: the tags whose suffixes (preferences: tag, suffix) the host has, for rules with preferred_by. row_id is unique."""
    tags = suffix_join(df.select(row_id, host), preferences, host).groupBy(row_id).agg(F.sort_array(F.collect_set("tag")).alias("preferred"))
    return df.join(tags, row_id, "left").withColumn("preferred", F.coalesce("preferred", F.expr("cast(array() as array<string>)")))


def rejected(questions: DataFrame, rejections: DataFrame) -> DataFrame:
    """questions (transport, qname, qtype, ts) with rejected: whether an answer of this transport to the question was rejected before and is remembered still.

    rejections: transport, qname, qtype, ts and ttl_s. One shuffle, as of the question's time.
    """
    key = F.concat_ws("\x00", "transport", "qname", F.col("qtype").cast("string"))
    maps = rejections.select(key.alias("_key"), "ts", F.lit("rejected").alias("value"), "ttl_s")
    return asof_join(questions.withColumn("_key", key), maps, "_key").withColumn("rejected", F.col("value").isNotNull()).drop("_key", "value")
