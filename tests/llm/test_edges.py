"""Ids of other types, names of any letters, empty tables, and memory that is counted in bytes."""

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowtrail.llm import bpe, chat, shards, toxicity, warc
from flowtrail.llm.common import fresh


@pytest.fixture(scope="module")
def named(docs):
    """Documents whose ids are text."""
    return docs.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_ids_that_are_text(spark, docs, named):
    as_text = lambda df: [(None if r[0] is None else f"id {r[0]}", *r[1:]) for r in df.collect()]
    assert plain(bpe.encode(named).collect()) == plain(as_text(bpe.encode(docs)))
    sparse = toxicity.Ftrl(l1=1.0)
    weights = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(20, 60)], "doc_id long, toxic int"), sparse)
    assert plain(toxicity.score(named, weights).collect()) == plain(as_text(toxicity.score(docs, weights)))
    trained = toxicity.train(named, spark.createDataFrame([(f"id {i}", i % 2) for i in range(20, 60)], "doc_id string, toxic int"), sparse)
    assert trained[0].any()
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.lit("user").alias("role"), "text")
    a = chat.parse(chat.conversations(turns)).select("conv_id", "n_turns", "formatted")
    b = chat.parse(chat.conversations(turns.withColumn("conv_id", F.concat(F.lit("id "), F.col("conv_id").cast("string"))))).select("conv_id", "n_turns", "formatted")
    assert plain(b.collect()) == plain(as_text(a))


def test_pages_whose_ids_are_text(spark):
    pages = spark.createDataFrame([("b", "http://x/1", "same"), ("a/ü 1\r\n", "http://x/2", "same"), (None, "http://x/3", "same"), ("c", "http://x/4", None), ("c", "http://x/4", "")], "page_id string, url string, html string")
    got = {(r.seq, r.type, r.refers_to) for r in warc.through_archives(pages.withColumns({"a.b": F.lit(1), "seq": F.lit("clash"), "name": F.lit("clash")})).collect()}
    assert {x for x in got if x[0] != "c"} == {("a/ü 1\r\n", "response", None), ("b", "revisit", "a/ü 1\r\n"), (None, "revisit", "a/ü 1\r\n")}
    assert {x for x in got if x[0] == "c"} == {("c", "response", None), ("c", "revisit", "c")}


def test_the_pipeline_with_ids_that_are_text(spark, named, tmp_path):
    named.withColumn("a.b", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.schema["doc_id"].dataType.simpleString() == "string" and out.count() > 0
    docs = named.withColumn("a.b", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_a_shard_map_that_begins_empty(spark, docs, none):
    name = fresh("begins-empty")
    records, shard_map, _ = shards.shard(none, name=name)
    assert records.count() == 0 and shard_map.count() == 0 and shards.latest(spark, name) == 1
    records, _, slots = shards.shard(docs, name=name)
    assert records.count() == docs.count() and shards.latest(spark, name) == 2
    assert records.select("version").distinct().collect()[0].version == 2
    sizes = [r.b for r in records.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert sum(sizes) == slots.agg(F.sum("bytes")).first()[0]
    again, _, _ = shards.shard(docs, name=name)
    assert again.count() == docs.count()


def test_a_map_that_is_written_in_part_is_none(spark, docs):
    name = fresh("half")
    staged = docs.select(F.lit(0).alias("vslot"), F.lit(0).alias("shard"))
    staged.write.parquet(f"{shards._folder(spark, name)}/_staged")
    assert shards.latest(spark, name) is None
    with pytest.raises(ValueError):
        shards.load(spark, name)
    assert shards.shard(docs, name=name)[0].count() == docs.count()


def test_two_writers_of_one_version(spark, docs, monkeypatch):
    name = fresh("two")
    _, shard_map, _ = shards.shard(docs, name=name)
    monkeypatch.setattr(shards, "latest", lambda spark, name: None)  # the other one has not seen it
    with pytest.raises(Exception, match="exist"):
        shards.save(shard_map, name)


def test_words_are_remembered_by_bytes(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(bpe.RANKS)
    v = bpe.Vocabulary(open(path, "rb").read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 2_000)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    most = 0
    for k in range(60):
        text = " ".join(f"some{k}word{j}" for j in range(5)) + " " + "long" * k
        assert list(v.encode([text])) == [enc.encode(text, disallowed_special=())]
        most = max(most, v.held)
    assert most < 2_000 + 20 * (bpe.ENTRY + 400)


def test_best_paths_of_a_tree_with_very_many_leaves(spark):
    nodes = [(1, 1, None, 0.0)] + [(1, k, 1, float(k * 37 % 101)) for k in range(2, 600)]
    got = chat.paths(spark.createDataFrame(nodes, "tree long, node long, parent long, score double"), top=5)
    best = sorted(((-s, k) for _, k, p, s in nodes if p == 1))[:5]
    assert {(r.rank, r.leaf) for r in got.collect()} == {(i + 1, k) for i, (_, k) in enumerate(best)}
