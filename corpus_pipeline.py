"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage works on everything its predecessor kept. The first three keep rows of documents, the
fourth repeats and orders them as the mix has them, the last gives one row of token ids for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowtrail.llm import bpe, exact, mixing, near, quality
from flowtrail.llm.common import table
from flowtrail.session import prepare


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir)


STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.keep(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact.distinct_texts(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: near.one_of_each(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("byte_bpe", lambda spark, docs, sf_dir: bpe.encode(docs, bpe.digests, bpe.DIGESTS)),
]
#: Each may be run by itself, so each prepares the session.
STAGES = [(name, _prepared(stage)) for name, stage in STAGES]

#: BPE has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each but the last written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
