"""Document fingerprints from prefix polynomial hashes.

A text's code points are summed as c[j] * B^j modulo a prime, for two bases B, and the sums over all prefixes
are kept. The difference of two of them, divided by a power of B, is the hash of the span between: any two spans,
of one text or of two, are compared in constant time, and the longest common extension from two places
is found by binary search. Prefix arrays also put texts together: those of a text's beginning and another's
are the arrays of the joined text.

A fingerprint has the length, the hash of the whole span, and a sketch of the spans of a fixed width from every
place: the smallest of their mixed hashes, the n-th copy of a span counting as a span of its own. Two
sketches estimate what share of both texts' spans is common to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The modulus, 2^31 - 1, and two bases below it.
PRIME, BASES = (1 << 31) - 1, (1_103_515_249, 742_938_285)
#: Widths of the sketched spans; texts below SHORT code points have a sketch of the first as well.
NARROW, WIDE, SHORT = 5, 16, 128
#: Entries of a sketch, and the bytes of each.
ENTRIES, WIDTH = 48, 5
_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15))  # odd multipliers


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME: its bits from the 31st on count once more."""
    prime, low = _U(PRIME), _U(31)
    x = (x & prime) + (x >> low)
    x = (x & prime) + (x >> low)
    return np.where(x >= prime, x - prime, x)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) at least; the table doubles when a longer text comes."""
    have = _tables.get(base, np.ones(1, _U))
    while len(have) < n:
        have = np.concatenate([have, _mod(have * _U(pow(base, len(have), PRIME)))])
    _tables[base] = have
    return have


_INVERSE = tuple(pow(b, -1, PRIME) for b in BASES)


class Prefixes:
    """Prefix arrays of a text: sums[k][i] is the hash of the first i code points in base k."""

    def __init__(self, sums: tuple[np.ndarray, ...]) -> None:
        self.sums, self.n = sums, len(sums[0]) - 1

    @classmethod
    def of(cls, text: str) -> Prefixes:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U) + _U(1)
        n = len(points)
        return cls(tuple(_mod(np.concatenate([np.zeros(1, _U), np.cumsum(_mod(points * _powers(b, n)[:n]))])) for b in BASES))

    def span(self, start: int, end: int) -> int:
        """The hash of the code points from start up to end: 62 bits, the same wherever they stand."""
        out = 0
        for s, inverse in zip(self.sums, _INVERSE):
            out = out << 31 | (int(s[end]) - int(s[start])) * int(_powers(inverse, start + 1)[start]) % PRIME
        return out

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """How many code points from i on here and from j on in other are the same."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def joined(self, i: int, other: Prefixes, j: int) -> Prefixes:
        """The prefix arrays of the first i code points here and then the first j of other."""
        return Prefixes(tuple(np.concatenate([s[: i + 1], _mod(s[i] + _mod(t[1 : j + 1] * _powers(b, i + 1)[i]))]) for s, t, b in zip(self.sums, other.sums, BASES)))

    def spans(self, width: int) -> np.ndarray:
        """The hashes of the spans of this width from every place; a shorter text is one span, an empty one none."""
        if self.n <= width:
            return np.array([self.span(0, self.n)][: self.n], _U)
        a, b = (_mod((s[width:] + _U(PRIME) - s[:-width]) * _powers(i, self.n)[: self.n - width + 1]) for s, i in zip(self.sums, _INVERSE))
        return a << _U(31) | b


def _sketch(spans: np.ndarray) -> np.ndarray:
    """The ENTRIES smallest of the mixed hashes, ascending."""
    x = np.sort(spans)
    if len(x) > 1:  # the n-th copy of a span is another span
        place = np.arange(len(x))
        starts = np.concatenate([[0], np.where(x[1:] != x[:-1], place[1:], 0)])
        x = x + (place - np.maximum.accumulate(starts)).astype(_U) * _MIX[2]
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    x = (x ^ (x >> _U(31))) >> _U(64 - 8 * WIDTH)
    return np.sort(np.partition(x, ENTRIES - 1)[:ENTRIES] if len(x) > ENTRIES else x)


def _bytes(entries: tuple[int, ...]) -> bytes:
    return b"".join(x.to_bytes(WIDTH, "big") for x in entries)


class Fingerprint(NamedTuple):
    n: int
    whole: int
    narrow: tuple[int, ...] | None
    wide: tuple[int, ...]

    @classmethod
    def of(cls, p: Prefixes) -> Fingerprint:
        return cls(p.n, p.span(0, p.n), tuple(_sketch(p.spans(NARROW)).tolist()) if p.n < SHORT else None, tuple(_sketch(p.spans(WIDE)).tolist()))

    def __str__(self) -> str:
        """The length, the whole span's hash and both sketches, in hexadecimal but for the length."""
        digits = lambda s: _bytes(s or ()).hex()
        return f"{self.n}.{self.whole:016x}.{digits(self.narrow)}.{digits(self.wide)}"

    def packed(self) -> bytes:
        """The same in half the bytes; spelled() makes the text of it."""
        narrow = _bytes(self.narrow or ())
        return self.n.to_bytes(8, "big") + self.whole.to_bytes(8, "big") + bytes([len(narrow)]) + narrow + _bytes(self.wide)

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, narrow, wide = text.split(".")
        entries = lambda s: tuple(int(s[i : i + 2 * WIDTH], 16) for i in range(0, len(s), 2 * WIDTH))
        return cls(int(n), int(whole, 16), entries(narrow) if int(n) < SHORT else None, entries(wide))


def spelled(packed: Column) -> Column:
    """Fingerprint.packed() as text."""
    piece = lambda at, n: F.lower(F.hex(F.substring(packed, at, n)))
    narrow = F.conv(piece(17, 1), 16, 10).cast("int")
    return F.concat_ws(".", F.conv(piece(1, 8), 16, 10), piece(9, 8), piece(F.lit(18), narrow), piece(18 + narrow, F.lit(1 << 30)))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """What share of both texts' spans is common to them, estimated: 1 for equal texts, 0 if one only is empty.

    Two short texts are compared by their narrow spans. Texts of up to ENTRIES spans each have all of
    them in the sketch and are compared exactly; else the estimate's error is about 0.07.
    """
    if a[:2] == b[:2]:
        return 1.0
    x, y = (a.narrow, b.narrow) if a.narrow is not None and b.narrow is not None else (a.wide, b.wide)
    both = set(x) & set(y)
    least = sorted({*x, *y})
    if len(x) == ENTRIES or len(y) == ENTRIES:  # beyond the last entry of a full sketch nothing is known
        least = least[:ENTRIES]
    common = sum(v in both for v in least)
    return 2 * common / (len(least) + common) if least else 0.0


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint.of(Prefixes.of(text or ""))


class _Row:
    __slots__ = ("name", "text", "prefixes", "mark")

    def __init__(self, name: object, text: str | None) -> None:
        self.name, self.text = name, text or ""
        self.prefixes = Prefixes.of(self.text)
        self.mark = Fingerprint.of(self.prefixes)

    def against(self, following: _Row) -> tuple:
        """The row of the result: this text, this text with its end replaced by the beginning of the following one, and that one."""
        n = self.prefixes.n
        kept, taken = n - n // 4, min(n // 4, following.prefixes.n)
        changed = self.prefixes.joined(kept, following.prefixes, taken)
        mark = Fingerprint.of(changed)
        digest = hashlib.sha256((self.text[:kept] + following.text[:taken]).encode()).digest()
        return (
            self.name, n, digest, self.mark.packed(), mark.packed(), likeness(self.mark, mark), likeness(self.mark, following.mark),
            self.prefixes.extension(0, changed, 0), self.prefixes.extension(0, following.prefixes, 0),
        )


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, same_start long, next_same_start long"
_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
ROWS = 256  # of a batch that a task makes


def _batch(kind: pa.DataType, rows: list[tuple], **more: pa.Array) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *_KINDS])]
    return pa.record_batch([*columns, *more.values()], names=["id", *_NAMES, *more])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the next one of its partition; the first and the last come as they are as well, marked by edge."""

    def edge(row: _Row, which: str) -> pa.RecordBatch:
        return _batch(kind, [(row.name, *[None] * 8)], part=pa.array([part], pa.int32()), edge=pa.array([which]), text=pa.array([row.text]))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.string())
        return _batch(kind, rows, part=pa.nulls(len(rows), pa.int32()), edge=none, text=none)

    before, made = None, []
    for batch in batches:
        kind = batch["id"].type
        for part, name, text in zip(*(batch[c].to_pylist() for c in ("part", "id", "text"))):
            row = _Row(name, text)
            if before is None:
                yield edge(row, "first")
            else:
                made.append(before.against(row))
                if len(made) == ROWS:
                    yield out(made)
                    made = []
            before = row
    if made:
        yield out(made)
    if before is not None:
        yield edge(before, "last")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, text, following in zip(*(batch[c].to_pylist() for c in ("id", "text", "following"))):
            yield _batch(batch["id"].type, [_Row(name, text).against(_Row(None, following))])


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: its fingerprint, that of its text with the last quarter replaced by the beginning of the next text, and likenesses.

    Rows go by id, null first; rows of one id by the XXH64 of their text, null as empty; after the last comes the
    first, and a single row follows itself. A null text counts as empty: it is equal to other empty ones, and
    nothing else is like it. same_start and next_same_start are the longest common extensions from the start, of the
    edited and of the next text. Repeated rows have a row each. An empty table gives an empty result.

    The texts are range-partitioned and sorted once, and each task compares neighbours as they pass. Only the first and
    last row of each partition meet across partitions, in a join on the partition's number.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")
    made = table(ranged.mapInArrow(_along, f"id {kind}, {_RESULT}, part int, edge string, text string"), "prefix-rows")
    ends = made.where("edge is not null").select("part", "id", "text", "edge")
    firsts, lasts = ends.where("edge = 'first'"), ends.where("edge = 'last'")
    # One row a partition, without texts.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("then"))
    pairs = lasts.join(turn, "part").join(firsts.select(F.col("part").alias("then"), F.col("text").alias("following")), "then").select("id", "text", "following")
    every_row = made.where("edge is null").select("id", *_NAMES).unionByName(pairs.mapInArrow(_across, f"id {kind}, {_RESULT}"))
    as_text = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": spelled(F.col("fingerprint")), "edited_fingerprint": spelled(F.col("edited_fingerprint"))}
    return every_row.withColumns(as_text).withColumnRenamed("id", id_col)
