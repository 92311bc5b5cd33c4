"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, word stems, word pairs and pairs with one word
between, hashed to DIMENSIONS coordinates. Each coordinate has its own learning rate, and L1 keeps
the weights of rare or neutral ones at zero, so the model is a short list of (coordinate, weight):
at most DIMENSIONS of them, some 16 MB, whatever the corpus. Training uses a bounded sample of
labelled rows; scoring streams over every text with the broadcast weights and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
DIMENSIONS = 1 << BITS
STEMS = (4, 5)
#: Labelled rows to learn from, at most.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
REMEMBERED = 1 << 18
_word = re.compile(r"\w+")
_known: dict[str, tuple[int, ...]] = {}
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal: alpha and beta set each coordinate's rate, l1 its sparsity, l2 its shrinkage; an example with label 1 weighs `positive`.

    l1 and positive were chosen by cross-validation over the rows to learn from, at two sizes of the test tables.
    """

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    positive: float = 2.0

    def fit(self, rows: list[np.ndarray], labels: list[int], seed: int = 0) -> tuple[np.ndarray, float]:
        """(weights, bias). The last coordinate is the bias, which is not regularised."""
        z, n, order = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.random.RandomState(seed)
        rows = [np.append(x, DIMENSIONS) for x in rows]
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                x = rows[i]
                zx, nx = z[x], n[x]
                p = 1 / (1 + np.exp(-np.clip(self._weights(zx, nx).sum(), -35, 35)))
                g = (p - labels[i]) * (self.positive if labels[i] else 1.0)
                rate = (np.sqrt(nx + g * g) - np.sqrt(nx)) / self.alpha
                z[x] = zx + g - rate * self._weights(zx, nx)
                n[x] = nx + g * g
        w = self._weights(z, n)
        return w[:-1].astype(np.float32), float(w[-1])

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of coordinates of which the last is the bias."""
        rate = (self.beta + np.sqrt(n)) / self.alpha
        w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / (rate + self.l2))
        w[-1] = -z[-1] / rate[-1]
        return w


def features(text: str | None) -> np.ndarray:
    """The coordinates of a text's features, repeats included."""
    global _known
    if len(_known) > REMEMBERED:
        _known = {}
    known, hashes = _known, []
    for w in _word.findall((text or "").lower()):
        h = known.get(w)
        if h is None:
            h = known[w] = (xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(f"{k}{w[:k]}") for k in STEMS))
        hashes.append(h)
    if not hashes:
        return np.zeros(0, np.int32)
    h = np.array(hashes, np.uint64)
    w = np.ascontiguousarray(h[:, 0])
    parts = [h.ravel(), w[:-1] * _MIX[0] ^ w[1:] * _MIX[1], w[:-2] * _MIX[2] ^ w[2:] * _MIX[3]]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and y of at most `rows` labelled documents that are not held out, by the hash of their id.

    Of several labels of one id the largest counts, of several texts the first by code point; null
    labels and ids teach nothing.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"doc_id": b["doc_id"], "y": b["y"], "x": pa.array([np.unique(features(t)).tobytes() for t in b["text"].to_pylist()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl(), rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The weights. Examples are made where the texts are; one task, which gets at most `rows` of them, fits.

    Without examples all weights are 0 and every score is 0.5.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for b in batches:
            xs += [np.frombuffer(x, np.int32) for x in b["x"].to_pylist()]
            ys += b["y"].to_pylist()
        if xs:
            w, bias = model.fit(xs, ys)
            at = np.flatnonzero(w)
            yield pa.record_batch({"at": pa.array([*at.tolist(), -1], pa.int32()), "w": pa.array([*w[at].tolist(), bias], pa.float32())})

    examples = sample(docs, labels, rows=rows)
    examples = examples.mapInArrow(_examples, f"doc_id {examples.schema['doc_id'].dataType.simpleString()}, y int, x binary")
    found = examples.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(fit, "at int, w float").collect()
    w, bias = np.zeros(DIMENSIONS, np.float32), 0.0
    for at, x in found:
        if at < 0:
            bias = x
        else:
            w[at] = x
    return w, bias


def score(docs: DataFrame, weights: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1), one row for each input row; an empty or null text scores what the bias says.

    Repeated rows score alike and all stay, texts are read whole whatever their length, further columns play
    no part, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for b in batches:
            sums = []
            for t in b["text"]:
                x = features(t.as_py())
                some = np.unique(x[w[x] != 0])  # presence, not counts
                sums.append(w[some].sum(dtype=np.float64) + bias)
            yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35))), pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def predict(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
