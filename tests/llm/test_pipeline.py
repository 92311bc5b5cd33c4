"""The pipeline and the registered queries."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from flowtrail.llm import bpe, exact, mixing, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_compose(spark, clashing):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    docs, seen = clashing, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen.append(out.count())
        docs = out.persist()
    assert 0 < seen[2] <= seen[1] <= seen[0] < clashing.count() and seen[4] == seen[3]


def test_workers_get_few_rows_of_long_texts_at_once(spark):
    """Also where a stage is run by itself, in a session that nothing prepared."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(5_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_000).alias("text"))
    spark.conf.unset(setting)
    made = dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, None)
    sizes = docs.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.nbytes])}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 5_000_000
    assert made.agg(F.sum("n_tokens")).first()[0] == 5_000 * made.first().n_tokens


def test_a_block_takes_little_memory(monkeypatch):
    """Words that a worker need not remember go with their block."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst      ", k=2_000)) for _ in range(1_200)]
    v = bpe.Vocabulary(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    tracemalloc.start()
    n = sum(len(ids) for _, block in bpe._blocks(batch) for ids in v.encode(block))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000_000 and most < 80_000_000, (n, most)


def test_empty_input(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0


def test_pipeline_against_brute_force(spark):
    """The stages' rules in plain Python: policy v2, largest id of equal texts, smallest id of texts linked at a Jaccard similarity of 0.8, words of the mix."""
    from tests.llm.test_documents import brute_targets, lower, measured
    from tests.llm.test_near import groups

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = []
    for r in rows:
        n, chars, symbols, dup, rep, lines = measured(r[1])
        if not (n < 10 or 100 * rep > 20 * n or symbols > n or 2 * dup > lines or chars > 40 * n):
            kept.append(r)
    last = {}
    for r in kept:
        k = lower(r[1])
        last[k] = max(last.get(k, r[0]), r[0])
    kept = [r for r in kept if last[lower(r[1])] == r[0]]
    kept = [min(kept[i] for i in g) for g in groups([r[1] for r in kept])]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    total = Counter()
    for r in kept:
        total[r[2]] += len(word.findall(r[1]))
    goal, at = brute_targets(dict(total)), Counter()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN).ranks, special_tokens={})
    order = lambda r: hashlib.md5(f"{r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
    want = Counter()
    for r in sorted(kept, key=order):
        ends = [m.end() for m in word.finditer(r[1])]
        for p in range(2):
            n = min(int(goal[r[2]] + 1e-9) - total[r[2]] * p - at[r[2]], len(ends))
            if n > 0:
                want[r[0], len(enc.encode_ordinary(r[1] if n == len(ends) else r[1][: ends[n - 1]]))] += 1
        at[r[2]] += len(ends)
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_registration():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in q) == 1
    assert "pipeline" in q and set(o) <= set(q)


def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    r = duck().execute(queries.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    plain = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=key)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", ["op3_byte_bpe", "op4_toxicity", "op7_simhash"])
def test_queries_give_a_row_for_each_document(spark, name):
    out = queries.queries()[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert out.count() == ids.count() and out.select("doc_id").exceptAll(ids).count() == 0


def test_stage_functions_are_the_operators(spark, docs):
    assert quality.keep(docs).count() == quality.apply_policy(quality.ledger(docs)).where("kept").count()
    assert exact.distinct_texts(docs).count() == exact.verdicts(docs).where("kept").count()
    assert mixing.mixed(docs).count() == mixing.curriculum(docs).agg(F.sum(F.size("passes"))).first()[0]


def test_stages_with_the_names_that_the_code_uses(spark, docs):
    """Names of inner columns, as columns of the documents: every stage keeps them as they are."""
    names = ("_i", "_d", "_digest", "_nth", "_s", "_n", "_p", "_at", "_size", "row", "key", "id", "a", "b", "x", "y", "i", "s", "root", "node", "rank", "first", "md5", "copies", "copy", "start", "inside", "passes", "schedule", "words", "_near_row", "n_rules", "h", "same")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    out = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, None)
        assert out.columns == wide.columns
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in names)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from flowtrail.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    far.conf = SimpleNamespace(get=lambda key, default=None: "hdfs://shared/")
    assert common.shared_dir(far) == "hdfs://shared"


def test_tables_are_forgotten(spark):
    from pathlib import Path

    from flowtrail.llm import common

    t = common.table(spark.range(3), "gone")
    assert Path(t._folder.removeprefix("file://")).exists()
    common.forget(t)
    assert not Path(t._folder.removeprefix("file://")).exists()
