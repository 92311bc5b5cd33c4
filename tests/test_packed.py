"""What streams with state are handed: a connection's rows packed, and parts that several tasks write."""

import random

import pytest

from flowtrail import item_queries, queries
from flowtrail.operators import accounting
from flowtrail.sources import store
from flowtrail.streaming import subscribe

SAMPLE = "id string, ts long, upload long, download long"


def samples(n, ids):
    rng = random.Random(n)
    return [(f"c{rng.randrange(ids)}", ts, rng.choice([0, 50, 100]), rng.choice([0, 70])) for ts in rng.sample(range(n), n)]


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_rows_are_packed_by_id(spark, monkeypatch, block):
    monkeypatch.setattr(subscribe, "PACK_ROWS", block)
    rows = [*samples(500, 9), (None, 1000, 1, 2), (None, 999, 3, None), ("c0", 1001, None, 4)]
    got = subscribe.packed(spark.createDataFrame(rows, SAMPLE).repartition(5), "ts", ["ts", "upload", "download"]).collect()
    assert sorted(((r.id, *x) for r in got for x in zip(r.ts, r.upload, r.download)), key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])
    assert all(r.ts == sorted(r.ts) for r in got)
    if block > len(rows):
        assert len(got) == len({r[0] for r in rows})


def test_parts_arrive_in_order_from_several_tasks(spark, tmp_path, monkeypatch):
    """A query that stops and goes on after each part, with a connection's rows in several packs, gives what the batch form gives."""
    monkeypatch.setattr(subscribe, "PACK_ROWS", 50)
    df = spark.createDataFrame(samples(400, 6), SAMPLE).repartition(5)
    monkeypatch.setattr(item_queries, "shared", lambda spark, name: str(tmp_path / name))
    with subscribe.settings(spark):
        for stream in item_queries._arriving(df, "test-parts", "ts"):
            store.to_batches(subscribe.deltas(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema("id string, ts long, up_delta long, down_delta long, batch long").parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, (r[:4] for r in got))) == sorted(map(tuple, accounting.change_events(df).collect()))
    assert {r.batch for r in got} == {0, 1, 2, 3}
    assert len(list((tmp_path / "test-parts").glob("*.parquet"))) == 4 * 5  # one file a part before


def test_a_snapshot_is_written_before_a_stream_starts_from_it(spark, monkeypatch):
    """It is read for the state of the first batch and for what that batch tells, and was computed for each before."""
    plans, start = [], subscribe.subscribe

    def seen(changes, snapshot, *folders):
        plans.append(snapshot._jdf.queryExecution().optimizedPlan().toString())
        return start(changes, snapshot, *folders)

    monkeypatch.setattr(subscribe, "subscribe", seen)
    sf_dir = "/root/testdata/sf0.001"
    got = item_queries.subscription(spark, sf_dir)
    want = queries.QUERIES["changelog_fold"](spark, sf_dir).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len(plans) == 4 and not any("Aggregate" in p or "Join" in p for p in plans)
