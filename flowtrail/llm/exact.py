"""Exact deduplication through a cuckoo-filter index over live digests.

The digest space is cut into buckets. A bucket's index is a cuckoo filter of 16-bit fingerprints and
the bucket's content: each live digest with the id that stays and the number of documents. A lookup
asks the filter first; a hit is verified against the content, so a false positive is told from a
repeat. When the filter overflows, it is made anew at twice the size from the stored keys. Deleting a
document takes its digest out of filter and content once no document has it any more.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, quoted, table, without

#: Digests a bucket is meant to hold, and keys that a map task's index holds before it is flushed.
BUCKET_KEYS = 50_000
FLUSH_KEYS = 100_000
SLOTS_A_BIN = 4
MAX_KICKS = 200


class CuckooFilter:
    """Partial-key cuckoo filter: 4 slots of 16 bits a bin, two bins for each key, deletion by fingerprint."""

    def __init__(self, bins: int = 64):
        self.bins = 1 << max(0, (bins - 1).bit_length())
        self.slots = array("H", bytes(2 * SLOTS_A_BIN * self.bins))

    def _at(self, key: bytes) -> tuple[int, int]:
        """The key's fingerprint (never 0, the empty slot) and its first bin."""
        return int.from_bytes(key[:2], "big") or 1, int.from_bytes(key[2:8], "big") & (self.bins - 1)

    def _other(self, fingerprint: int, at: int) -> int:
        return at ^ (fingerprint * 0x9E3779B1 >> 7) & (self.bins - 1)

    def _bin(self, at: int):
        return self.slots[SLOTS_A_BIN * at : SLOTS_A_BIN * (at + 1)]

    def __contains__(self, key: bytes) -> bool:
        f, at = self._at(key)
        return f in self._bin(at) or f in self._bin(self._other(f, at))

    def crowded(self, key: bytes) -> bool:
        """Both bins hold nothing but the key's own fingerprint, so no move and no size makes room for it."""
        f, at = self._at(key)
        return all(x == f for place in (at, self._other(f, at)) for x in self._bin(place))

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the filter has then lost one fingerprint and must be made anew."""
        f, at = self._at(key)
        for place in (at, self._other(f, at)):
            if self._put(f, place):
                return True
        at = self._other(f, at)
        for kick in range(MAX_KICKS):
            slot = SLOTS_A_BIN * at + kick % SLOTS_A_BIN
            f, self.slots[slot] = self.slots[slot], f
            at = self._other(f, at)
            if self._put(f, at):
                return True
        return False

    def _put(self, f: int, at: int) -> bool:
        for slot in range(SLOTS_A_BIN * at, SLOTS_A_BIN * (at + 1)):
            if not self.slots[slot]:
                self.slots[slot] = f
                return True
        return False

    def delete(self, key: bytes) -> bool:
        f, at = self._at(key)
        for place in (at, self._other(f, at)):
            for slot in range(SLOTS_A_BIN * place, SLOTS_A_BIN * (place + 1)):
                if self.slots[slot] == f:
                    self.slots[slot] = 0
                    return True
        return False


class DigestIndex:
    """A cuckoo filter in front of the stored digests: digest -> [id that stays, its row, documents].

    Digests that share the bytes which the filter reads with more others than two bins hold are in `stash`.
    """

    def __init__(self):
        self.filter, self.stash, self.content, self.false_hits, self.resizes = CuckooFilter(), set(), {}, 0, 0

    def find(self, digest: bytes) -> list | None:
        if digest not in self.filter and digest not in self.stash:
            return None
        found = self.content.get(digest)
        self.false_hits += found is None
        return found

    def add(self, digest: bytes, keep_id, row: int | None, n: int) -> None:
        """The largest id stays, of equal ids that with the smallest row; no id is below every id."""
        found = self.find(digest)
        if found is not None:
            found[2] += n
            if keep_id is not None and (found[0] is None or keep_id > found[0]):
                found[:2] = keep_id, row
            elif keep_id == found[0] and row is not None and (found[1] is None or row < found[1]):
                found[1] = row
            return
        self.content[digest] = [keep_id, row, n]
        if not self._insert(digest):
            self._resize()

    def remove(self, digest: bytes, doc_id, n: int = 1) -> bool:
        """False if the digest is not live. If the id that stays goes, it is unknown until looked up again."""
        found = self.find(digest)
        if found is None:
            return False
        found[2] -= n
        if found[2] <= 0:
            del self.content[digest]
            if digest in self.stash:
                self.stash.discard(digest)
            else:
                self.filter.delete(digest)
        elif found[0] == doc_id:
            found[:2] = None, None
        return True

    def _insert(self, digest: bytes) -> bool:
        if self.filter.crowded(digest):
            self.stash.add(digest)
            return True
        return self.filter.insert(digest)

    def _resize(self) -> None:
        bins = self.filter.bins
        while True:
            bins *= 2
            self.resizes += 1
            self.filter, self.stash = CuckooFilter(bins), set()
            if all(map(self._insert, self.content)):
                return

    def batch(self, ids: pa.DataType) -> dict[str, pa.Array]:
        kept = list(self.content.values())
        columns = [list(self.content), *([x[k] for x in kept] for k in range(3))]
        return {name: pa.array(c, t) for (name, t), c in zip((("digest", pa.binary()), ("keep_id", ids), ("keep_row", pa.int64()), ("group_size", pa.int64())), columns)}


def _merge_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, ids = DigestIndex(), pa.null()
    for batch in batches:
        ids = batch.schema.field("doc_id").type
        for digest, doc_id, row in zip(*(batch[c].to_pylist() for c in ("digest", "doc_id", "row"))):
            index.add(digest, doc_id, row, 1)
        if len(index.content) >= FLUSH_KEYS:
            yield pa.record_batch(index.batch(ids))
            index = DigestIndex()
    if index.content:
        yield pa.record_batch(index.batch(ids))


def _filled(content: pa.Table) -> DigestIndex:
    index = DigestIndex()
    for row in zip(*(content[c].to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size"))):
        index.add(*row)
    return index


def _content(bucket: int, index: DigestIndex, ids: pa.DataType) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket] * len(index.content), pa.int64()), **index.batch(ids)})


def _merge_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    return _content(key[0].as_py(), _filled(rows), rows.schema.field("keep_id").type)


def _change_bucket(key: tuple, content: pa.Table, changes: pa.Table) -> pa.Table:
    index = _filled(content)
    rows = zip(*(changes[c].to_pylist() for c in ("digest", "doc_id", "sign")))
    for digest, doc_id, sign in sorted(rows, key=lambda x: -x[2]):  # insertions first
        if sign > 0:
            index.add(digest, doc_id, None, 1)
        else:
            index.remove(digest, doc_id)
    return _content(key[0].as_py(), index, content.schema.field("keep_id").type)


def _schema(ids: str, *before: str) -> str:
    return ", ".join([*before, "digest binary", f"keep_id {ids}", "keep_row long", "group_size long"])


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and row, a number of each row. Rows are numbered anew by each evaluation: write it first."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")


def build(rows: DataFrame, n_rows: int) -> DataFrame:
    """The index's content, one row for each live digest, from rows of doc_id, digest and row.

    Each map task merges its own rows in an index of at most FLUSH_KEYS keys, so a group with a third
    of all rows sends one row a task. The number of buckets follows the number of rows.
    """
    n_buckets, ids = max(1, math.ceil(n_rows / BUCKET_KEYS)), rows.schema["doc_id"].dataType.simpleString()
    partial = rows.select("digest", "doc_id", "row").mapInArrow(_merge_locally, _schema(ids))
    return partial.select(_bucket(n_buckets), "*").groupBy("bucket").applyInArrow(_merge_bucket, _schema(ids, "bucket long"))


def change(content: DataFrame, n_buckets: int, inserted: DataFrame, deleted: DataFrame, live: DataFrame) -> DataFrame:
    """The content after inserting and deleting rows of doc_id and digest; keep_row is not kept up.

    live: the rows that remain, from which digests that lost the id that stays get their next one.
    A deletion of a digest that is not live is ignored. content must have build()'s n_buckets.
    """
    ids = live.schema["doc_id"].dataType.simpleString()
    signed = inserted.select("doc_id", "digest", F.lit(1).alias("sign")).unionByName(deleted.select("doc_id", "digest", F.lit(-1).alias("sign")))
    changed = content.groupBy("bucket").cogroup(signed.select(_bucket(n_buckets), "*").groupBy("bucket")).applyInArrow(_change_bucket, _schema(ids, "bucket long"))
    changed = table(changed, "exact-content")
    lost = changed.where(F.col("keep_id").isNull()).select("digest")
    again = live.join(lost, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("next_id"))
    return changed.join(again, "digest", "left").select("bucket", "digest", F.coalesce("keep_id", "next_id").alias("keep_id"), "group_size")


def changed_groups(docs: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """digest, keep_id and group_size of the live texts after the rows of `new` came and those of docs with an id in `gone` went.

    docs and new: doc_id, text. gone: doc_id. Rows that repeat an id go together; null ids never go.
    """
    rows, added = table(keyed(docs), "exact-rows"), table(keyed(new), "exact-new")
    n = rows.count()
    content = table(build(rows, n), "exact-content")
    ids = gone.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    deleted, left = rows.join(ids, "doc_id", "left_semi"), rows.join(ids, "doc_id", "left_anti")
    return change(content, max(1, math.ceil(n / BUCKET_KEYS)), added, deleted, left.unionByName(added)).select("digest", "keep_id", "group_size")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, digest, keep_id, group_size, kept.

    Of equal texts the largest id stays (numbers by value, strings by code point); a null id only if all
    are null. Rows equal in id and text all count; one of them is kept. An empty table gives an empty result.

    The join back is on the digest between two written tables, so that Spark splits the tasks of a
    hot digest.
    """
    rows = table(keyed(docs, id_col, text_col), "exact-rows")
    content = table(build(rows, rows.count()), "exact-content")
    return rows.join(content.drop("bucket"), "digest").select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, every column as it was; of rows equal in id and text one stays.

    Only the keys (digest and id) of rows that go are joined to the texts, which stay where they are while
    those keys are few enough to broadcast.
    """
    name = fresh("key")

    def key(digest: Column) -> Column:
        return F.concat(digest, F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")).cast("binary"), F.lit("").cast("binary"))).alias(name)

    goes = table(verdicts(docs).where("not kept").select(key(F.col("digest")), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")), "exact-goes")
    rows = docs.select("*", key(digest_of()))
    return without(rows, name, goes.where("not same").select(name), goes.where("same").select(name)).select(*quoted(*docs.columns))
