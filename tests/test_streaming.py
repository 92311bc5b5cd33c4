"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from flowtrail.operators import accounting
from flowtrail.sources.tables import flows
from flowtrail.streaming import changelog

SF = "/root/testdata/sf0.001"


def run(df, name, mode="update"):
    # A query with processing-time timeouts would run batches without data for ever.
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
        df.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_states_follow_the_changelog(spark, tmp_path):
    schema = "id string, seq long, type string, ts_ms long, up_delta long, down_delta long"
    events = [("a", 1, "NEW", 0, 1, 1), ("b", 2, "UPDATE", 0, 9, 9), ("a", 3, "UPDATE", 1, 5, 6), ("c", 4, "NEW", 2, 0, 0), ("a", 5, "CLOSED", 10, 0, 0), ("c", 6, "UPDATE", 11, 2, 3)]
    for i in (0, 3):
        spark.createDataFrame(events[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(changelog.states(stream), "states")
    got = {r.id: (r.uplink_total, r.downlink_total, r.uplink, r.closed_ms) for r in spark.table("states").groupBy("id").agg(F.max_by("uplink_total", "uplink_total").alias("uplink_total"), F.max("downlink_total").alias("downlink_total"), F.max_by("uplink", F.coalesce("closed_ms", "uplink_total")).alias("uplink"), F.max("closed_ms").alias("closed_ms")).collect()}
    batch = {r.id: (r.uplink_total, r.downlink_total, r.uplink, r.closed_ms) for r in accounting.apply_changes(spark.createDataFrame(events, schema)).collect()}
    assert got == batch == {"a": (6, 7, 0, 10), "c": (2, 3, 2, None)}


def test_traffic_per_tick(spark, tmp_path):
    batch = flows(spark, SF).select("created_at", "upload", "download")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    run(changelog.per_tick(stream, 3600, "100 days"), "ticks", "complete")
    got = {(int(r.tick.timestamp()), r.up, r.down) for r in spark.table("ticks").collect()}
    want = {(r.tick, r.up, r.down) for r in accounting.per_tick(batch, 3600).collect()}
    assert got == want
