"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits link at 3 or fewer differing bits. The bits are cut into SEGMENTS segments in
a ring. If a pair differs in at most LIMIT bits, there is a segment from which every chain of 1, 2, ...
consecutive segments differs in at most its proportional share, length * LIMIT / SEGMENTS, of them
(the pigeonring principle). The shares of the first two segments round down to 0, so they must be
equal: that is the join key. The longer chains prune what the key lets through, and the full
Hamming check comes last. Beyond WIDE_FROM fingerprints the key takes in the next two segments as well,
whose share rounds down to 1: one side is stored once, the other asks for each of the keys that
differ in at most one bit there. That changes the cost, never the links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, table
from .linking import linked

LIMIT = 3
SEGMENTS = 7
SHINGLE = 3
SEED = 42
WIDE_FROM = 1 << 24
CHUNK = 1 << 16
#: Members of a bucket up to which its pairs are compared at once: what chance brings together short of WIDE_FROM.
DIRECT = 64
_word = re.compile(WORD.encode())


def _widths() -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, from the low end."""
    out, at = [], 0
    for i in range(SEGMENTS):
        bits = 64 // SEGMENTS + (i < 64 % SEGMENTS)
        out.append((at, bits))
        at += bits
    return out


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    words = _word.findall((text or "").encode().lower())
    if not words:
        return 0
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[SHINGLE:] + [at]
    n, ones, digest = len(ends) if len(words) >= SHINGLE else 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    if n == 1:
        ends = [at]
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[k : min(n, k + CHUNK)], ends[k : k + CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array([fingerprint(t) for t in batch["text"].to_pylist()], pa.int64())})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _segment(fp: Column, i: int) -> Column:
    at, bits = _widths()[i % SEGMENTS]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def _key(fp: Column, start: int, length: int) -> Column:
    """The bits of `length` segments from `start`, in order, below the start's number."""
    out = F.lit(start).cast("long")
    for j in range(length):
        out = F.shiftleft(out, _widths()[(start + j) % SEGMENTS][1]).bitwiseOR(_segment(fp, start + j))
    return out


def _chain_mask(start: int, length: int) -> int:
    """The bits of `length` segments from `start`, as a signed integer."""
    m = sum(((1 << bits) - 1) << at for at, bits in (_widths()[(start + j) % SEGMENTS] for j in range(length)))
    return m - (1 << 64) if m >> 63 else m


def _viable(x: Column, start: Column) -> Column:
    """Every chain of the differing bits x from start keeps within its share.

    Shares are whole bits, so of the chains with the same share the longest decides.
    """
    share = [length * LIMIT // SEGMENTS for length in range(1, SEGMENTS + 1)]
    ok = F.bit_count(x) <= LIMIT
    for length in range(1, SEGMENTS):
        if share[length - 1] != share[length]:
            mask = F.element_at(F.array(*[F.lit(_chain_mask(s, length)) for s in range(SEGMENTS)]), start + 1)
            ok = ok & (F.bit_count(x.bitwiseAND(mask)) <= share[length - 1])
    return ok


def links(classes: DataFrame, wide: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp) that differ in at most LIMIT bits; each once.

    All of them, which grows with the square of a dense group; groups() needs linked() only.
    """
    left, right = _stored(classes, _asked if wide else _exact, wide).alias("x"), _stored(classes, _exact, wide).alias("y")
    pairs = left.join(right, (F.col("x.start") == F.col("y.start")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _near(F.col("x.fp"), F.col("y.fp"), F.col("x.start")))
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()  # a pair may be viable from several starts


def _near(a: Column, b: Column, start: Column) -> Column:
    return _viable(a.bitwiseXOR(b), start)


def _exact(s: int, length: int) -> list[int]:
    return [0]


def _asked(s: int, length: int) -> list[int]:
    """No difference, or one bit of the third and fourth segment."""
    return [0] + [1 << k for k in range(sum(_widths()[(s + j) % SEGMENTS][1] for j in (2, 3)))]


def _stored(classes: DataFrame, flips: Callable[[int, int], list[int]], wide: bool) -> DataFrame:
    """fp, start and key: a row for each start and each of the flips of its key."""
    length, fp = 4 if wide else 2, F.col("fp")
    keys = [F.array(*[F.struct(F.lit(s).alias("start"), _key(fp, s, length).bitwiseXOR(F.lit(m)).alias("key")) for m in flips(s, length)]) for s in range(SEGMENTS)]
    return classes.select("fp", F.explode(F.flatten(F.array(*keys))).alias("k")).select("fp", "k.*")


def index(classes: DataFrame, wide: bool = False) -> DataFrame:
    """classes (fp, and other columns) with a row for each start and key, as `bucket`, under which near fingerprints meet."""
    keys = _stored(classes.select("fp").distinct(), _asked if wide else _exact, wide).withColumnRenamed("key", "bucket")
    return classes.join(keys, "fp")


def near(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether two rows of index() that share a bucket differ in at most LIMIT bits, and by the chains from their start."""
    return _near(x("fp"), y("fp"), x("start"))


def connected(classes: DataFrame, wide: bool = False) -> DataFrame:
    """(node, root) for the fingerprints that link with others, without all pairs of a dense group.

    Where the key is wide, both sides are stored under every key that differs in at most one bit, so that
    two linked fingerprints share a bucket.
    """
    index = _stored(classes, _asked if wide else _exact, wide)
    return linked(index, ["start", "key"], "fp", ["fp"], lambda x, y: _near(x("fp"), y("fp"), x("start")), direct=DIRECT, finer=None if wide else _finer)


def _finer(rows: DataFrame) -> DataFrame:
    """Rows under the third and fourth segment from their start, and under each value that differs from these in one bit: what links from there shares one."""
    of = lambda s: [_key(F.col("fp"), (s + 2) % SEGMENTS, 2).bitwiseXOR(F.lit(m)) for m in _asked(s, 4)]
    return rows.withColumn("finer", F.explode(F.coalesce(*[F.when(F.col("start") == s, F.array(*of(s))) for s in range(SEGMENTS)])))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fp, component_id (the smallest doc_id reachable, itself included).

    Texts without words, null included, have fingerprint 0 and link like any other. Equal fingerprints
    are one class: links are sought between classes only, and a class of any size is one row there.
    The component of rows that all lack an id is null. Ids may be numbers or strings, ordered by value or
    code point. Rows that repeat an id have a row each. An empty table gives an empty result.
    """
    rows = table(fingerprints(docs, id_col, text_col), "simhash-rows")
    classes = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = connected(classes, wide=classes.count() > WIDE_FROM).withColumnRenamed("node", "fp")
    least = roots.join(classes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = roots.join(least, "root").select("fp", "component_id")
    named = table(classes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-components")
    forget(classes)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
