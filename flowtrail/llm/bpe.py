"""Byte-level BPE by merge replay over blocks of the corpus.

A block is a bounded run of documents in one task. Its distinct words (the pattern's matches) are laid
out as one sequence of tokens, at first one for each byte, and an inverted index maps each mergeable
pair, by the rank of what it merges to, to the positions where it stands. The merges are replayed in
rank order: all positions of the lowest rank are merged, and only their neighbours' pairs enter the
index anew. Words are independent of each other, so blocks give what one corpus-wide replay gives, and
no text leaves its task. Words replayed before in the same worker are not replayed again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: No merge: above every rank.
NONE = np.iinfo(np.int32).max
#: Places of one rank from which they are merged at once, not one by one.
MANY = 12
#: Characters of text after which a block ends.
BLOCK_CHARS = 1 << 19
#: Bytes of words and their ids that a worker remembers, besides those of the block at hand; and what an entry takes besides letters and ids.
REMEMBERED, ENTRY = 1 << 26, 180


class Vocabulary:
    """A rank file's tokens; a token's id is its rank."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.numerals = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.merges = self._merges()
        keys = np.array(sorted(self.merges), np.int64)
        self.keys, self.values = keys, np.array([self.merges[k] for k in keys.tolist()], np.int32)
        # Tokens that take part in a merge which comes before the merge that makes them.
        self.early = {x for k, r in self.merges.items() for x in (k >> 32, k & 0xFFFFFFFF) if x > r}
        self.ids = list(range(len(self.tokens)))  # one object for each id, however often it is remembered
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _merges(self) -> dict[int, int]:
        """(left id << 32 | right id) -> id of the merged token, for every pair that merges."""
        out, ranks = {}, self.ranks
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    out[a << 32 | b] = r
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of tokens, NONE where there is none."""
        wanted = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], NONE).astype(np.int32)

    def learn(self, words: set[str]) -> None:
        """Put the ids of every word among the known ones."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        rest, known = [], self.known
        for w in words:
            if w in known:
                continue
            data = w.encode()
            whole = self.ranks.get(data)
            if whole is None:
                rest.append((w, data))
            else:
                known[w] = (whole,)
                self.held += ENTRY + len(data) + 8
        for (w, data), ids in zip(rest, self.replay([data for _, data in rest])):
            known[w] = tuple(map(self.ids.__getitem__, ids))
            self.held += ENTRY + len(data) + 8 * len(ids)

    def replay(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word, by replaying all merges over all words at once."""
        text = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(text), np.cumsum([len(w) for w in words], dtype=np.int64)
        if not n:
            return
        # Arrays for single places and, over the same memory, for many at once. joins: the rank of the pair at a place.
        token, after, before, joins = (array("i", x.astype(np.int32).tobytes()) for x in (self.bytes[text], np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, NONE)))
        tokens, afters, befores, joined = (np.frombuffer(x, np.int32) for x in (token, after, before, joins))
        afters[ends - 1] = -1  # no pair crosses the end of a word
        befores[ends[:-1]] = -1
        first = np.flatnonzero(afters >= 0)
        joined[first] = self.rank(tokens[first], tokens[first + 1])
        first = first[joined[first] != NONE]
        order = np.argsort(joined[first], kind="stable")
        found, starts = np.unique(joined[first][order], return_index=True)
        index: dict[int, list] = {r: [x] for r, x in zip(found.tolist(), np.split(first[order].astype(np.int32), starts[1:]))}
        waiting, merges = list(index), self.merges.get

        def enter(r: int, at: int) -> None:
            """Put a place under the rank of its pair."""
            if r in index:
                index[r].append(at)
            else:
                index[r] = [at]
                heapq.heappush(waiting, r)

        heapq.heapify(waiting)
        while waiting:
            r = heapq.heappop(waiting)
            if (held := index.pop(r, None)) is None:
                continue
            whole = [x for x in held if isinstance(x, np.ndarray)]
            places = np.unique(np.concatenate([*whole, np.array([x for x in held if not isinstance(x, np.ndarray)], np.int32)])) if whole or len(held) >= MANY else sorted(set(held))
            if len(places) >= MANY and r not in self.early:
                places = places[joined[places] == r]
                nxt = afters[places]
                if not (nxt[:-1] == places[1:]).any():  # no two pairs share a token
                    far, near = afters[nxt], befores[places]
                    tokens[places], tokens[nxt], joined[nxt], afters[places] = r, -1, NONE, far
                    right, left = far >= 0, near >= 0
                    befores[far[right]] = places[right]
                    joined[places] = NONE
                    at = np.concatenate([places[right], near[left]])
                    new = joined[at] = self.rank(tokens[at], tokens[afters[at]])
                    some = new != NONE
                    for x, y in zip(new[some].tolist(), at[some].tolist()):
                        enter(x, y)
                    continue
            if isinstance(places, np.ndarray):
                places = places.tolist()
            for k, at in enumerate(places):
                if joins[at] != r:
                    continue  # a neighbour was merged meanwhile
                nxt = after[at]
                far = after[at] = after[nxt]
                token[at], token[nxt], joins[nxt], lowest, new = r, -1, NONE, r + 1, NONE
                if far >= 0:
                    before[far] = at
                    if (new := merges(r << 32 | token[far], NONE)) != NONE:
                        lowest = min(lowest, new)
                        enter(new, at)
                joins[at] = new
                if (near := before[at]) >= 0:
                    if (new := merges(token[near] << 32 | r, NONE)) != NONE:
                        lowest = min(lowest, new)
                        enter(new, near)
                    joins[near] = new
                if lowest <= r:  # a merge that comes before the rest of this one
                    for later in places[k + 1 :]:
                        enter(r, later)
                    break
        live = tokens >= 0
        ids, at = tokens[live].tolist(), 0
        for count in np.add.reduceat(live, np.concatenate([[0], ends[:-1]]), dtype=np.int64).tolist():
            yield ids[at : at + count]
            at += count

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text of a block."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces) if pieces else set())
        known = self.known
        for p in pieces:
            yield list(chain.from_iterable(map(known.__getitem__, p)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(data, pattern)


Finish = Callable[[Vocabulary, list[int]], tuple]


def ids_only(v: Vocabulary, ids: list[int]) -> tuple:
    return (ids,)


def digests(v: Vocabulary, ids: list[int]) -> tuple:
    """Derived from an encoding and its decoding: tokens, SHA-256 of the decimal ids and of the decoded bytes."""
    joined = " ".join(map(v.numerals.__getitem__, ids))
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()


IDS = pa.schema([("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_SQL = {pa.list_(pa.int32()): "array<int>", pa.int64(): "long", pa.string(): "string"}


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of BLOCK_CHARS characters and one text at most."""
    texts, start, n = [], 0, 0
    for i, t in enumerate(batch["text"]):
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n >= BLOCK_CHARS:
            yield batch["doc_id"].slice(start, len(texts)), texts
            texts, start, n = [], i + 1, 0
    if texts:
        yield batch["doc_id"].slice(start, len(texts)), texts


def encode(docs: DataFrame, finish: Finish = ids_only, columns: pa.Schema = IDS, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what `finish` makes of each text's ids, one row for each input row, without a shuffle.

    No special tokens: their strings are ordinary text. A null or empty text has no ids. A text of any
    length is encoded whole. Repeated rows give a row each, an empty table none; ids keep their type. The rank file is read once by the driver,
    under 1 MB, and sent with the tasks.
    """
    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data.value, pattern)
        for batch in batches:
            for ids, texts in _blocks(batch):
                made = list(zip(*(finish(v, x) for x in v.encode(texts))))
                yield pa.record_batch([ids, *[pa.array(c, f.type) for c, f in zip(made, columns)]], names=["doc_id", *columns.names])

    schema = ", ".join([f"doc_id {docs.schema[id_col].dataType.simpleString()}", *(f"{f.name} {_SQL[f.type]}" for f in columns)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, schema)
