"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when the document holds at least the threshold share
of the item's distinct word shingles. Items are partitioned by size (powers of two of their
shingle counts), and each partition has a MinHash sketch of its own length: with at most u
shingles in the partition, the sketch keeps the floor((1 - threshold) * u) + 1 smallest hash
values of an item. A document that contains the item lacks at most
floor((1 - threshold) * size) shingles, so it holds at least one value of the sketch, and
items below that number of hits need no look: the search has no false negatives, however
long the document. Candidates are then verified on the words themselves, without hashes.

Items are taken in blocks of bounded size, each broadcast to one pass over the documents; a
document is read where it lies and never shuffled.

Cases: null and empty texts hold nothing and are contained in nothing; fewer words than a
shingle make one shingle of all, so an item of one to four words is found only in texts that are
those words alone, never inside a text of five or more; repeated items and documents each give their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, prepare, shingle_hashes, shingle_set, texts_of

U64 = np.uint64
#: Bytes of item text in a block: what one broadcast carries.
BLOCK_BYTES = 32 << 20


def word_shingles(text: bytes, width: int = 5) -> set[bytes]:
    words = text.lower().split()
    k = min(width, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Sketches:
    """The MinHash sketches of a block of items, by size partition, and their inverted index."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float, width: int):
        self.threshold, self.width = threshold, width
        self.items = [(i, t) for i, t in items if t.split()]
        values, owners, self.need = [], [], []
        for owner, (_, text) in enumerate(self.items):
            shingles = shingle_set(text, width)
            upper = (1 << int(len(shingles) - 1).bit_length()) if len(shingles) > 1 else 1
            kept = shingles[: int((1 - threshold) * upper + 1e-9) + 1]
            values.append(kept)
            owners.append(np.full(len(kept), owner))
            self.need.append(max(1, len(kept) - int((1 - threshold) * len(shingles) + 1e-9)))
        value = np.concatenate(values) if values else np.zeros(0, U64)
        order = np.argsort(value, kind="stable")
        self.owner = np.concatenate(owners)[order] if values else np.zeros(0, np.int64)
        self.value, first, count = np.unique(value[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.exact: dict[int, set[bytes]] = {}
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.value >> U64(48)).astype(np.int64)] = True

    def found_in(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item id, its shingles, how many of them the text holds) of each contained item."""
        if not len(self.value):
            return []
        hashes = shingle_hashes(text, self.width)
        hashes = np.unique(hashes[self.seen[(hashes >> U64(48)).astype(np.int64)]])
        at = np.minimum(np.searchsorted(self.value, hashes), len(self.value) - 1)
        at = at[self.value[at] == hashes]
        if not len(at):
            return []
        owners = np.concatenate([self.owner[self.first[i] : self.first[i] + self.count[i]] for i in at.tolist()])
        names, hits = np.unique(owners, return_counts=True)
        words, out = None, []
        for owner, n in zip(names.tolist(), hits.tolist()):
            if n < self.need[owner]:
                continue
            if owner not in self.exact:
                self.exact[owner] = word_shingles(self.items[owner][1], self.width)
            words = word_shingles(text, self.width) if words is None else words
            own = self.exact[owner]
            shared = len(own & words)
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((self.items[owner][0], len(own), shared))
        return out


def blocks(items: DataFrame, item_col: str = "item_id") -> Iterator[Broadcast]:
    """The items as (id, text) lists, each of about BLOCK_BYTES at most, broadcast in turn."""
    spark = prepare(items.sparkSession)
    wanted = texts_of(items, item_col).withColumnRenamed("doc_id", "item_id")
    total = wanted.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for number in range(n_blocks):
        yield spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in wanted.where(block == number).toLocalIterator()])


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75, width: int = 5, item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared for each item that a document contains."""
    source = texts_of(docs)
    out = None
    for shared in blocks(items, item_col):

        def run(batches_: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, threshold, width)
            for batch in batches(batches_):
                found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in sketches.found_in(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["doc_id", "item_id", "n_shingles", "n_shared"])

        part = source.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75, width: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text_col)
    for shared in blocks(items):

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, threshold, width)
            for batch in batches(rows):
                yield batch.filter(pa.array([not sketches.found_in((t or "").encode()) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
