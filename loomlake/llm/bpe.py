"""Operator 1: byte-level BPE encoding and decoding with a segment tree over byte positions.

Every match of the splitting pattern is merged by itself. A segment tree over the byte
positions of the match holds, at each leaf, the rank of the pair that starts there, and in
each inner node the leftmost minimum below it. A merge reads the root, joins the pair, and
makes logarithmic point updates for the merged pair, the swallowed one and the live
neighbour before it. Short matches go through the same tree laid out over many matches at
once; long ones through a tree of their own, in n log n.

Cases: null text is the empty text; an empty text has no ids; repeated rows give repeated
results; a null doc_id stays null; an empty table gives no rows; other columns, whatever their
names, are not read; a long text is one row, held with its ids and at most 20,000 distinct
matches in the work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, kept, texts_of
from .pieces import Remembered

SHORT = 32
_NONE = np.iinfo(np.int64).max


class Ranks:
    """A rank file: bytes of each token, and the rank that each pair of tokens merges into."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = rank
        bits = max(8, (4 * len(self.pair)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        keys = np.fromiter(self.pair.keys(), np.int64, len(self.pair))
        values = np.fromiter(self.pair.values(), np.int64, len(self.pair))
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            landed = self.keys[slots] == keys
            self.values[slots[landed]] = values[landed]
            keys, values, slots = keys[~landed], values[~landed], (slots[~landed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into; the largest number where none does."""
        keys = a << 32 | b
        slots = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = there == keys
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            open_, keys, slots = open_[on], keys[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out


class SegmentTree:
    """Leftmost minimum over positions, with point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.node = [(_NONE, 0)] * (2 * self.size)
        for i, v in enumerate(values):
            self.node[self.size + i] = (v, i)
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def put(self, position: int, value: int) -> None:
        node, i = self.node, self.size + position
        node[i] = (value, position)
        i >>= 1
        while i:
            least = min(node[2 * i], node[2 * i + 1])
            if node[i] == least:
                break
            node[i] = least
            i >>= 1

    def least(self) -> tuple[int, int]:
        return self.node[1]


def merge_one(piece: bytes, ranks: Ranks) -> np.ndarray:
    """The ids of one match of any length."""
    token = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    n, pair = len(token), ranks.pair.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = SegmentTree([pair(token[i] << 32 | token[i + 1], _NONE) for i in range(n - 1)] + [_NONE])
    while True:
        rank, at = tree.least()
        if rank == _NONE:
            break
        gone = after[at]
        token[at], after[at] = rank, after[gone]
        tree.put(gone, _NONE)
        nxt, prv = after[at], before[at]
        if nxt < n:
            before[nxt] = at
        tree.put(at, pair(rank << 32 | token[nxt], _NONE) if nxt < n else _NONE)
        if prv >= 0:
            tree.put(prv, pair(token[prv] << 32 | rank, _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(token[i])
        i = after[i]
    return np.array(ids, np.uint32)


def merge_many(pieces: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    """The ids, as little-endian unsigned 32-bit integers, of matches of 2 to width bytes.

    One segment tree a row; width is a power of two of at most 32.
    """
    n = len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    token = np.zeros((n, width + 1), np.int64)
    token[:, :width] = ranks.single[raw]
    live = np.arange(width) < length[:, None]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    # A node is the pair's rank and, in the last five bits, its position: the minimum is the leftmost.
    tree = np.full((n, 2 * width), _NONE, np.int64)
    paired = np.arange(width - 1) < length[:, None] - 1
    rank = np.full((n, width - 1), _NONE, np.int64)
    rank[paired] = ranks.pair_ranks(token[:, : width - 1][paired], token[:, 1:width][paired])
    where = np.broadcast_to(np.arange(width - 1), rank.shape)
    tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank << 5 | where, _NONE)
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        at, merged = root & 31, root >> 5
        gone = after[rows, at]
        nxt, prv = after[rows, gone], before[rows, at]
        token[rows, at] = merged
        live[rows, gone] = False
        after[rows, at] = nxt
        before[rows, nxt] = at
        tree[rows, width + gone] = _NONE
        tree[rows, width + at] = _NONE
        touched, leaf = [rows, rows], [width + gone, width + at]
        for mine, left, right in ((nxt < length[rows], at, nxt), (prv >= 0, prv, at)):
            r, left, right = rows[mine], left[mine], right[mine]
            found = ranks.pair_ranks(token[r, left], token[r, right])
            tree[r, width + left] = np.where(found < _NONE, found << 5 | left, _NONE)
        touched.append(rows[prv >= 0])
        leaf.append(width + prv[prv >= 0])
        r, node = np.concatenate(touched), np.concatenate(leaf) >> 1
        while node[0]:
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            node = node >> 1
        rows = rows[tree[rows, 1] < _NONE]
    flat = token[:, :width][live].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Codec:
    """Encodes and decodes texts; holds the ids of the words that it has met."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = Ranks(data)
        self.split = regex.compile(pattern).findall
        self.encode = Remembered(self.ids, np.array([len(b) for b in self.ranks.bytes_of])).encode

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text; each distinct match is merged once."""
        matches = self.split(text)
        known: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for match in set(matches):
            piece = match.encode()
            whole = self.ranks.rank.get(piece)
            if whole is not None:
                known[match] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                known[match] = merge_one(piece, self.ranks).astype("<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append((match, piece))
        for width, found in by_width.items():
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                known.update(zip([m for m, _ in part], merge_many([p for _, p in part], width, self.ranks)))
        return np.frombuffer(b"".join(map(known.__getitem__, matches)), "<u4")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a Python worker for each vocabulary."""
    return kept("bpe", (hash(data), pattern), lambda: Codec(data, pattern))


def encode(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers). The vocabulary is a fixed file of a few MB."""
    return _coded(docs, vocabulary, pattern, False)


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """What decode() makes of encode(): doc_id, ids, text (the bytes that the ids decode to), in one pass of one worker a task."""
    return _coded(docs, vocabulary, pattern, True)


def _coded(docs: DataFrame, vocabulary: bytes, pattern: str, back: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "ids", "text"] if back else ["doc_id", "ids"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches(rows, 1 << 20):
            ids = own.encode([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            more = [pa.array(map(own.decode, ids), pa.binary())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *more], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, text binary" if back else "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Adds text (binary: the decoded bytes) to what encode() returns."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches(rows):
            texts = [own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, text binary")
