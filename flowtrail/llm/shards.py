"""Sharding by fixed virtual slots (DataFrame functions only).

Records are hashed into a fixed number of virtual slots, bytes are summed for each slot, and a
versioned map from slot to shard is stored under a name. Rebalancing loads the latest version, edits it
and stores the next; records never rehash. The law kept is `bytes`: the shards' sizes are near equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, shared_dir, table

#: Slots: a record's slot is the first three hexadecimal digits of its key, or fewer bits of them.
SLOTS = 4096
#: Largest over smallest shard from which rebalance() moves slots.
TOLERANCE = 1.02


def virtual_slot(key: Column, n_slots: int = SLOTS) -> Column:
    """The slot of a record's key, an md5 in hexadecimal."""
    return F.pmod(F.conv(F.substring(key, 1, 3), 16, 10).cast("int"), F.lit(n_slots))


def keyed(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null: that of no bytes), nth and vslot; a row for each input row.

    The key is the md5 of id, checksum, size and nth, the number among rows equal in these, so that rows
    without an id, or with one id for all, are spread like others. Equal rows are counted before anything
    is shuffled and numbered when they are told apart again.
    """
    text, name = F.coalesce(F.col(text_col), F.lit("")), fresh("id")
    rows = docs.select(F.col(id_col).alias(name), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy(name, "size", "text_crc32").agg(F.count("*").alias("n")).select(name, "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(name).cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.col("nth").cast("string")).cast("binary"))
    return rows.select(F.col(name).alias("id"), "size", "text_crc32", "nth", virtual_slot(key, n_slots).alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """One row for each slot in use: at most n_slots rows, whatever the input's size."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assign(slots: DataFrame, n_shards: int, version: int = 1, loads: Column | None = None) -> DataFrame:
    """A map: the largest slot goes to the shard with the least bytes so far, and so on. loads: what the shards have before.

    The fold is over the slot table, which has n_slots rows at most by construction.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "rows")))
    start = F.struct((F.array_repeat(F.lit(0).cast("long"), n_shards) if loads is None else loads).alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("map"))

    def step(a: Column, x: Column) -> Column:
        at = (F.array_position(a["loads"], F.array_min(a["loads"])) - 1).cast("int")
        # One pass for the index, one for the update: both over n_shards numbers.
        return F.struct(
            F.transform(a["loads"], lambda v, i: F.when(i == at, v - x["neg"]).otherwise(v)).alias("loads"),
            F.concat(a["map"], F.array(F.struct(x["vslot"].alias("vslot"), at.alias("shard")))).alias("map"),
        )

    folded = slots.agg(ordered.alias("s")).select(F.explode(F.aggregate("s", start, step)["map"]).alias("m"))
    return folded.select(F.lit(version).alias("version"), "m.vslot", "m.shard")


def save(shard_map: DataFrame, name: str) -> int:
    """Store a map (version, vslot, shard) under a name as its next version, and give that; a version is written once and never changed.

    It is written aside and published by one rename, which fails where another writer has published that version
    meanwhile. A map may be empty.
    """
    spark = shard_map.sparkSession
    version, staged = (latest(spark, name) or 0) + 1, f"{_folder(spark, name)}/_{fresh('staged')}"
    shard_map.drop("version").write.parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    none = jvm.java.lang.reflect.Array.newInstance(getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE.getClass(), 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(staged).toUri(), conf).rename(path(staged), path(f"{_folder(spark, name)}/version={version}"), none)
    return version


def latest(spark: SparkSession, name: str) -> int | None:
    """The number of a named map's last version, None if it has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, name))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)


def load(spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
    """The latest version of a named map, or the one asked for."""
    version = version or latest(spark, name)
    if version is None:
        raise ValueError(f"no shard map is named {name}")
    return spark.read.schema("vslot int, shard int").parquet(f"{_folder(spark, name)}/version={version}").select(F.lit(version).alias("version"), "vslot", "shard")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shard-maps/{name}"


def grow(shard_map: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, edited for one more shard.

    Each shard hands over its largest slots while it stays at or above the new mean; all of them go
    to the new shard, and no slot moves between old shards. The maps have n_slots rows at most.
    """
    sized = shard_map.join(F.broadcast(slots), "vslot")
    shard, order = Window.partitionBy("shard"), [F.desc("bytes"), "vslot"]
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(n_shards + 1)
    moved = F.sum("bytes").over(shard) - F.sum("bytes").over(shard.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) >= F.col("mean")
    return sized.withColumn("mean", mean).select((F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"))


def rebalance(spark: SparkSession, name: str, slots: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The latest map, after an edit where the slots' present sizes ask for one: the next version is stored then.

    Slots that came into use go to the shard with the least bytes. Where the largest shard then has more
    than `tolerance` times the smallest, every shard above the mean gives up its smallest slots while it
    stays at or above the mean, and these go out again, the largest first to the shard with the least bytes.
    """
    version = latest(spark, name)
    old = load(spark, name, version)
    held = slots.join(F.broadcast(old.drop("version")), "vslot", "left")
    w = Window.partitionBy("shard")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards)  # over n_slots rows at most
    rest = F.sum("bytes").over(w) - F.sum("bytes").over(w.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    held = table(held.withColumn("mean", mean).withColumn("rest", rest), "shard-held")
    loads = held.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("b"))
    low, high, n = loads.agg(F.min("b"), F.max("b"), F.count("*")).first()
    uneven = n > 0 and (n < n_shards or high > tolerance * low)
    goes = F.col("shard").isNull() | (F.col("rest") >= F.col("mean")) if uneven else F.col("shard").isNull()
    if not held.where(goes).limit(1).count():
        return old
    stays = held.where(~goes)
    had = stays.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("had")).first().had
    start = F.array(*[F.lit((had or {}).get(s, 0)).cast("long") for s in range(n_shards)])
    new = assign(held.where(goes).select("vslot", "bytes", "rows"), n_shards, version + 1, start).unionByName(stays.select(F.lit(version + 1).alias("version"), "vslot", "shard"))
    save(table(new, "shard-map"), name)
    return load(spark, name)


def placed(rows: DataFrame, shard_map: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with shard and slot, the record's place in its shard, gapless from 0.

    Rows are ranked within their virtual slot, and a slot's first place is the sum of the row counts of the
    slots before it, so no shard's rows are in one task.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = shard_map.join(F.broadcast(slots), "vslot").select("version", "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size", "nth"))
    out = rows.withColumn("rank", rank).join(F.broadcast(first), "vslot")  # n_slots rows at most
    return out.select("id", "size", "text_crc32", "vslot", "version", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, map, slot sizes).

    records: id, size, text_crc32, vslot, version, shard and slot. Ties on the id take places in order of
    checksum and size; equal rows are interchangeable. An empty table gives empty results. Under a `name`
    that has no map yet the first one is stored; where there is one, its latest version is rebalanced for
    these documents. Without a name the map is new and nothing else reads it.
    """
    spark = docs.sparkSession
    rows = table(keyed(docs, n_slots, id_col, text_col), "shard-rows")
    slots = table(slot_sizes(rows), "shard-slots")
    fixed = name or fresh("map")
    if name is None or latest(spark, name) is None:
        save(assign(slots, n_shards), fixed)
        shard_map = load(spark, fixed)
    else:
        shard_map = rebalance(spark, fixed, slots, n_shards)
    return placed(rows, shard_map, slots).withColumnRenamed("id", id_col), shard_map, slots
