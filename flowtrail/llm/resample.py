"""Importance resampling towards a target: weights from hashed n-gram counts, Gumbel noise, and an exact draw.

A feature is a run of one or two words and falls into one of BUCKETS. The raw corpus and the target are counted
by bucket, and a bucket's gain is the logarithm of the target's share over the raw share: an array of
BUCKETS numbers, which scores every document. The eligible rows are stored as sorted runs, one a partition.
How many rows each score has says where the draw ends and cuts the scores into slices; a slice's part of every run
is merged by a tournament tree, which knows its first rank beforehand and stops when the draw is complete.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A word, in UTF-8 after A-Z were lower-cased: no control character, space, ASCII mark or DEL.
_word = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
#: Drawn rows that a task merges at a time.
SLICE_ROWS = 100_000
#: Bytes of words and checksums that a worker remembers, and those of an entry besides its word.
HELD, ENTRY = 1 << 26, 250


class Hasher:
    """Buckets of a text's features. Remembers the checksums of words, in HELD bytes and those of one text."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, bytes]] = {}
        self.held = 0

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every run of one and two of them."""
        words = _word.findall((text or "").encode().lower())
        if self.held > HELD:
            self.known, self.held = {}, 0
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w), b" " + w
            self.held += len(w) + ENTRY
        one = [known[w] for w in words]
        crc = zlib.crc32
        two = [crc(b[1], a[0]) for a, b in zip(one, one[1:])]
        return len(words), np.array([a[0] for a in one] + two, np.int64) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, counts = Hasher(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch["text"].to_pylist():
            counts += np.bincount(hasher(t)[1], minlength=BUCKETS)
    some = counts.nonzero()[0]
    yield pa.record_batch({"bucket": pa.array(some, pa.int64()), "n": pa.array(counts[some])})


def counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows; each task sends BUCKETS numbers at most."""
    per = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in per.collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths, floored; one is added to every count."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(name: object, seed: int = SEED) -> int:
    """A Gumbel variate in thousandths, from the digest of the id alone. A null id stands for an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight (the floored mean of gains; 0 without features), score (weight and noise) and eligible, a row for each row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gain = Hasher(), held.value
        for batch in batches:
            rows = []
            for name, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                n, found = hasher(t)
                weight = int(gain[found].sum()) // len(found) if n else 0
                rows.append((len(found), weight, weight + noise(name, seed), n >= min_words))
            columns = list(zip(*rows)) or [(), (), (), ()]
            made = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.bool_())]
            yield pa.record_batch([batch["id"], *made], names=["id", "n_features", "weight", "score", "eligible"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"id {kind}, n_features long, weight long, score long, eligible boolean")


class Tournament:
    """Rows of k sorted runs in one order. Every inner node keeps the loser of its match, so the next winner costs one match a level."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers, self.winner = self._seed()

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _seed(self) -> tuple[list[int], int]:
        k = len(self.runs)
        at, losers = [0] * k + list(range(k)), [0] * max(k, 1)
        for node in range(k - 1, 0, -1):
            a, b = at[2 * node], at[2 * node + 1]
            at[node], losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return losers, at[1] if k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (row := self.heads[self.winner]) is not None:
            yield row
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


#: What orders rows: higher scores, then smaller ids, null last; the others part rows with one id.
ORDER = ("score", "id", "n_features", "weight")


def _order() -> list:
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]


def _ranked(first: int, drawn: int, runs: dict[int, list[tuple]]) -> Iterator[tuple]:
    """Rows of a slice with their first rank, and how many of their copies are drawn; first: rows that come before the slice."""
    for row in Tournament(list(runs.values())):
        (less, none, name, n_features, weight), copies = row
        n = min(copies, max(drawn - first, 0))
        yield None if none else name, n_features, weight, -less, copies, first + 1, n
        first += copies


def _merge(drawn: int):
    """Merges each slice's runs. Rows come by slice and run, and in order within a run; one slice is held at a time."""
    names = ["id", "n_features", "weight", "score", "copies", "first_rank", "n_drawn"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, runs, kinds = None, 0, {}, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*_ranked(first, drawn, runs)), kinds)], names=names)

        for batch in batches:
            kinds = [batch["id"].type, *[pa.int64()] * 6]
            for slice_, run, before, score, name, n_features, weight, copies in zip(*(batch[c].to_pylist() for c in ("slice", "run", "before", *ORDER, "copies"))):
                if slice_ != now:
                    if runs:
                        yield out()
                    now, first, runs = slice_, before, {}
                first = min(first, before)
                runs.setdefault(run, []).append(((-score, name is None, 0 if name is None else name, n_features, weight), copies))
        if runs:
            yield out()

    return merge


def draw(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n_features, weight, score and rank of rows of scored(): rank is 1, 2, ... for the drawn, null for others.

    Of N eligible rows, floor(percent * N / 100) are drawn, those of the highest scores, ties to smaller ids, null
    last. Rows equal in all columns are counted before anything is shuffled and told apart again at the end.
    A slice is all rows of some scores: as the noise has a density of at most 1/e, a score has about
    one of 2,700 rows of different ids at most, so slices stay small whatever the rows are.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    # Sorted runs: every partition writes its rows in order, under its number.
    counted = rows.groupBy("id", "n_features", "weight", "score", "eligible").agg(F.count("*").alias("copies"))
    runs = table(counted.sortWithinPartitions(*_order()).withColumn("run", F.spark_partition_id()), "resample-runs")
    # The scores are whole thousandths within some 130,000 values, as gains are logarithms of counts: that bounds these rows.
    per_score = runs.where("eligible").groupBy("score").agg(F.sum("copies").alias("n")).collect()
    per_score.sort(key=lambda r: -r.score)
    drawn = sum(r.n for r in per_score) * percent // 100
    width = max(1, min(SLICE_ROWS, math.ceil(drawn / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    places, before = [], 0
    for r in per_score:
        if before >= drawn:
            break
        places.append((r.score, before // width, before))
        before += r.n
    placed = F.broadcast(spark.createDataFrame(places, "score long, slice long, before long"))
    merged = runs.where("eligible").join(placed, "score").select("slice", "run", "before", *ORDER, "copies").repartition("slice").sortWithinPartitions("slice", "run", *_order())
    kind = rows.schema["id"].dataType.simpleString()
    merged = merged.mapInArrow(_merge(drawn), f"id {kind}, n_features long, weight long, score long, copies long, first_rank long, n_drawn long")
    lowest = places[-1][0] if places else None
    rest = runs.where(~F.col("eligible") | F.lit(lowest is None) | (F.col("score") < F.lit(lowest)))
    rest = rest.select("id", "n_features", "weight", "score", "copies", F.lit(None).cast("long").alias("first_rank"), F.lit(0).cast("long").alias("n_drawn"))
    each = merged.unionByName(rest).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return each.select("id", "n_features", "weight", "score", F.when(F.col("copy") < F.col("n_drawn"), F.col("first_rank") + F.col("copy")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """draw() of docs towards the texts of target (column text). Null and empty texts have no features and weight 0.

    Ids may be numbers or strings. Texts of any length are read whole, twice: once to be counted, once to be scored.
    """
    gain = gains(counts(docs, text_col), counts(target))
    return draw(scored(docs, gain, seed, id_col=id_col, text_col=text_col), percent).withColumnRenamed("id", id_col)
