"""Streams with state of their own: any split into batches, silence told by a timer, snapshots that overlap, replays."""

import random

import pytest
from pyspark.sql import functions as F

from flowtrail.operators import accounting
from flowtrail.plans.rules import RuleError
from flowtrail.sources import store
from flowtrail.streaming import subscribe

SAMPLE = "id string, ts long, upload long, download long"


def in_files(spark, path, schema, parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.mark.parametrize("cuts", [[], [1], [40, 41, 90]])
def test_deltas_for_any_split(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    totals, rows = {}, []
    for ts in range(120):
        key = rng.choice(["a", "a", "b", None])
        up, down = totals.get(key, (0, 0))
        totals[key] = rng.choice([(up, down), (up + rng.randint(0, 5), down), (up, down + 3), (1, 0)])
        rows.append((key, ts, *totals[key]))
    rows = [r for r in rows if r[0]]
    parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]
    with subscribe.settings(spark):
        store.to_batches(subscribe.deltas(in_files(spark, tmp_path / "in", SAMPLE, parts)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema("id string, ts long, up_delta long, down_delta long").parquet(str(tmp_path / "out")).drop("batch").collect()
    want = accounting.change_events(spark.createDataFrame(rows, SAMPLE)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20


def test_silence_gives_one_zero(spark, tmp_path):
    """a falls silent: its timer gives one zero, and no second one comes later."""
    at = "2024-01-01 00:{:02d}:00"
    parts = [[("a", at.format(0), 5, 5), ("b", at.format(0), 1, 1)], [("b", at.format(30), 2, 2)], [("b", at.format(50), 3, 3)], [("b", at.format(59), 4, 4)]]
    schema = "id string, t string, upload long, download long"
    stream = in_files(spark, tmp_path / "in", schema, parts).select("id", F.to_timestamp("t").alias("ts"), "upload", "download")
    with subscribe.settings(spark):
        store.to_batches(subscribe.deltas(stream, quiet="10 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("id = 'a'").orderBy("ts").collect()
    assert [(r.up_delta, r.down_delta) for r in got] == [(5, 5), (0, 0)]


EVENT = "id string, seq long, type string, ts_ms long, up_delta long, down_delta long"


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_then_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.choice("abcdef"), i, rng.choice(["NEW", "UPDATE", "UPDATE", "UPDATE", "CLOSED"]), 10 * i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(80)]
    snapshot = accounting.apply_changes(spark.createDataFrame(events[:40], EVENT)).withColumn("seq", F.lit(39).cast("long"))
    changes = in_files(spark, tmp_path / "in", EVENT, [events[20:50], events[50:51], events[51:]])
    with subscribe.settings(spark):
        subscribe.subscribe(changes, snapshot, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    told = spark.read.schema("id string, reset boolean, batch long").parquet(str(tmp_path / "out"))
    assert told.where("reset").count() == snapshot.count() and told.where("reset and batch > 0").count() == 0
    got = subscribe.subscribed(spark, str(tmp_path / "out")).drop("seq")
    want = accounting.apply_changes(spark.createDataFrame(events, EVENT))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_batches_are_replaced_whole(spark, tmp_path):
    stream = in_files(spark, tmp_path / "in", "x long", [[(1,), (2,)], [(3,)]])

    def fails_late(batch):
        if batch.where("x = 3").count():
            batch.write.mode("append").parquet(str(tmp_path / "out" / "batch=1"))  # half-written before the failure
            raise RuntimeError("the writer is lost")
        return batch

    with pytest.raises(Exception, match="the writer is lost"):
        store.to_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), fails_late).awaitTermination()
    store.to_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.x for r in spark.read.schema("x long").parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_an_invalid_update_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "rules")
    assert store.current(spark, folder) is None
    assert store.publish(spark, folder, '{"version": 2, "rules": [{"domain": "a"}]}') == 1
    for bad in ("", "{", "[]", '{"version": 99, "rules": []}', '{"version": 2, "rules": [{"domain_regex": ["ok", "("]}]}', '{"version": 2, "rules": [{"type": "logical", "mode": "and", "rules": [{"process_path_regex": "a**"}]}]}'):
        with pytest.raises(RuleError):
            store.publish(spark, folder, bad)
    version, rules = store.current(spark, folder)
    assert version == 1 and rules.rules[0].fields["domain"] in (["a"], ("a",))
    store._Folder(spark, folder).write("versions/2.json", "staged by a writer that was lost")
    assert store.publish(spark, folder, '{"version": 2, "rules": [{"port": 1}]}') == 3
    assert store.current(spark, folder)[0] == 3


def test_usage_document(spark, tmp_path):
    import json

    path = str(tmp_path / "usage.json")
    for n in (1, 2):
        store.save_usage(spark.createDataFrame([("u", n)], "user string, tokens long"), path)
    assert json.loads((tmp_path / "usage.json").read_text())["cells"] == [{"user": "u", "tokens": 2}]
