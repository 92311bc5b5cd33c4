"""Near-duplicates by SimHash and word shingles: texts link at a Jaccard similarity of 0.8 or more of their sets of five words.

Pairs whose SimHashes differ in three bits or fewer are found first, by pigeonring (simhash.py), and compared exactly. What
links without that is found by shingles. No link is lost, whatever the order of shingles: of two sets with a similarity of 4/5 or more, each
keeps at least 4/5 of its shingles in the other, so the first n - ceil(4n/5) + 1 of each, in one
order for all, share a shingle (prefix filter), and with one shingle more they share two. The sizes and the places of the first shared shingle
prune pairs that can't reach the similarity; so do bitmaps of 1,024 bits, one for each set, in which every
shingle flips a bit: sets differ in at least as many shingles as their bitmaps do in bits, and similar ones
in a ninth of their sizes' sum at most. The rest are compared shingle by shingle. The order puts shingles that a sample of the texts has often last, so that boilerplate is seldom a join key.
The sample changes the cost, never the links. Texts that share a shingle are compared with one of
them first, that which has it earliest, so the one with the fewest words of its own: the members of a
dense group link to it, and not each to each (linking.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import few, forget, fresh, quoted, table, without
from .linking import linked
from .simhash import SEED, _word

SHINGLE = 5
#: One text in SAMPLE is counted; shingles in OFTEN or more of those go last, at most HOT of them (16 MB).
SAMPLE, OFTEN, HOT = 20, 4, 1_000_000
KEY, SIZE, PREFIX, BITS, PRINT = "key", "size", "prefix", "bits", "fp"
N_BITS = 10  # of a shingle, that say which bit it flips
HELD = 4_000_000  # shingles (32 MB) that a worker holds while it compares


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's runs of SHINGLE words, sorted; fewer words are one run, none give no shingle."""
    words = _word.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, at, digest = b" ".join(words), [], 0, xxhash.xxh64_intdigest
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[SHINGLE:] + [at] if len(words) >= SHINGLE else [at]
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the shingles that share their first N_BITS bits, as LONGs."""
    odd = np.bincount((s >> np.uint64(64 - N_BITS)).astype(np.int64), minlength=1 << N_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch["text"].to_pylist():
            yield pa.record_batch({"s": pa.array(shingles(t).view(np.int64))})


def _often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and in how many of them they are."""
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    n = some.mapInArrow(_hashes, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = n.orderBy(F.desc("n"), "s").limit(HOT).toArrow()
    s, n = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _keyed(hot: np.ndarray, counts: np.ndarray):
    """The set's key, size and bitmap, the shingles of its prefix in order, and the text's SimHash, for each row of row, id and text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prefixes, bits, prints = [], [], [], [], []
            for t in batch["text"].to_pylist():
                s = shingles(t)
                n = len(s)
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(n)
                bits.append(bitmap(s))
                prints.append(simhash.fingerprint(t))
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.lexsort((s, np.where(hot[at] == s, counts[at], 0)))]
                prefixes.append(s[: n - (4 * n + 4) // 5 + 2].view(np.int64))  # the prefix and one more
            new = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.record_batch([batch["row"], batch["id"], *new], names=["row", "id", KEY, SIZE, PREFIX, BITS, PRINT])

    return add


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text in many pairs is cut into shingles once, while the worker holds at most HELD of them."""
    known: dict[int, np.ndarray] = {}
    held = 0

    def of(key: int, text: str) -> np.ndarray:
        nonlocal known, held
        s = known.get(key)
        if s is None:
            if held > HELD:
                known, held = {}, 0
            s = known[key] = shingles(text)
            held += len(s)
        return s

    for batch in batches:
        ok = [similar(of(a, x), of(b, y)) for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "x", "y")))]
        yield pa.record_batch({c: batch[c].filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})


def _fits(x, y):
    """The sizes and the places of a shared shingle of two sets leave room for the similarity."""
    n, m, i, j = x(SIZE), y(SIZE), x("i"), y("i")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave room for the similarity."""
    of = lambda side: sets.select(F.col(KEY).alias(side), F.struct(SIZE, BITS).alias(f"_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    differ = F.aggregate(F.zip_with(f"_a.{BITS}", f"_b.{BITS}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(9 * differ <= F.col(f"_a.{SIZE}") + F.col(f"_b.{SIZE}")).select("a", "b")


def connected(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the keys of sets that are similar to others. sets: row, key, size, prefix, bits, fp, a row for each set; texts: row, text.

    Sets whose SimHashes are near link first, each link compared exactly; shingles then add what three bits of a fingerprint leave out.
    """

    def links(pairs: DataFrame) -> DataFrame:
        pairs = table(_alike(pairs, sets), "near-alike")
        wanted = table(pairs.select(F.explode(F.array("a", "b")).alias(KEY)).distinct().join(sets.select(KEY, "row"), KEY), "near-wanted")
        some = table(texts.join(few(wanted), "row").select(KEY, "text"), "near-texts")
        both = pairs.join(some.select(F.col(KEY).alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col(KEY).alias("b"), F.col("text").alias("y")), "b")
        found = table(both.select("a", "b", "x", "y").mapInArrow(_compared, "a long, b long"), "near-links")
        forget(pairs, wanted, some)
        return found

    def finer(rows: DataFrame) -> DataFrame:
        """Prefixes with one shingle more share two: the rows under each shingle that comes after theirs."""
        after = F.explode(F.slice(PREFIX, F.col("i") + 2, F.size(PREFIX)))
        return rows.join(sets.select(KEY, PREFIX), KEY).select(*rows.columns, after.alias("finer"))

    index = sets.select(KEY, SIZE, F.posexplode(PREFIX).alias("i", "s")).where((F.col(SIZE) > 0) & (F.col("i") <= F.col(SIZE) - F.ceil(4 * F.col(SIZE) / 5)))
    return linked(index, ["s"], KEY, ["i", KEY], _fits, links, finer=finer, known=by_fingerprint(sets, links))


def by_fingerprint(sets: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the keys of sets that links() finds similar among those whose SimHashes differ in simhash.LIMIT bits or fewer."""
    some = sets.where(F.col(SIZE) > 0).select(KEY, SIZE, F.col(PRINT).alias("fp"))
    near = lambda x, y: simhash.near(x, y) & (5 * F.least(x(SIZE), y(SIZE)) >= 4 * F.greatest(x(SIZE), y(SIZE)))
    wide = some.count() > simhash.WIDE_FROM
    return linked(simhash.index(some, wide), ["start", "bucket"], KEY, [KEY], near, links, direct=simhash.DIRECT, finer=None if wide else simhash._finer)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of rows that links connect: that of the smallest id, nulls last; every column as it was.

    Of rows that share that id, or all lack one, one stays. Texts without words, null included, are one
    group. Rows with equal sets are one class, found by a 64-bit key, and links are sought between classes.
    An empty table gives an empty result.

    The rows are written once with a number each; only the numbers of rows that go are joined to them.
    """
    number, kind = fresh("row"), docs.schema[id_col].dataType.simpleString()
    rows = table(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = table(texts.mapInArrow(_keyed(*_often(texts)), f"row long, id {kind}, {KEY} long, {SIZE} int, {PREFIX} array<long>, {BITS} array<long>, {PRINT} long"), "near-sets")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = table(made.groupBy(KEY).agg(F.min(rank).alias("rank")), "near-classes")
    # Of rows with equal sets all but the first go; the first stands for the set.
    again = table(made.select("row").join(few(classes.select("rank.row")), "row", "left_anti"), "near-again")
    sets = table(made.join(few(again), "row", "left_anti"), "near-sets")
    roots = connected(sets, texts.select("row", "text")).withColumnRenamed("node", KEY)
    of_root = classes.join(roots, KEY)
    stays = of_root.groupBy("root").agg(F.min("rank").alias("first"))
    goes = table(of_root.join(stays, "root").where("rank.row <> first.row").select(F.col("rank.row").alias(number)).unionByName(again.withColumnRenamed("row", number)), "near-goes")
    forget(made, classes, again, sets)
    return without(rows, number, goes, goes.limit(0)).select(*quoted(*docs.columns))
