"""Operator 10: a binary token store whose shards carry a minimal perfect hash index.

Documents are dealt by ranges of doc_id and encoded in that order. A shard is one row of a
Parquet table: raw little-endian ids, end offsets, and an index of the shard's keys. The
index is a cascade of bit arrays (keys that meet no other in a level are settled there, the
rest go one level down); the rank of a key's bit is its slot, and the slot holds a 32-bit
fingerprint of the key and the place of its document. A lookup so reads one bit in a few
levels, one fingerprint and one offset, whatever the size of the shard.

Cases: null text is the empty text and has the end id only; null doc_id is a key of its
own and comes first; rows with the same doc_id share a slot, which names the first of them
and how many follow, and go on in the next shard where one is full; an empty table gives an
empty store; other columns, whatever their names, are not read; a long text is one row, which
a shard holds whole beyond its size.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.session import materialize, scratch

from .common import batches, kept, mix, prepare, texts_of
from .pieces import Remembered

U64 = np.uint64
NULL_KEY = -(1 << 63)
SHARD_BYTES = 2 << 20
#: Shards whose starts are broadcast; beyond, they are joined.
BROADCAST_SHARDS = 500_000
#: Keys that a shard is asked for at once.
ASKED = 10_000
COLUMNS = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, width int, payload binary, ends binary, keys binary, bits binary, fingerprints binary, places binary"


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1 without gaps."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(base + counts - bits)
            base += int(counts[-1]) if len(counts) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(U64), []
        while len(left):
            size = max(8, 2 * len(left))
            at = _level(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has a bit for it."""
        keys = keys.astype(U64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _level(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n, 4).tolist()
        levels, at = [], 4 + 4 * n
        for size in sizes:
            k = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=size).astype(bool))
            at += k
        return cls(levels)


class Tokenizer:
    """The tokenizers library over texts; holds the ids of the words that it has met.

    An added token in a text is that token, as the library has it; such texts are encoded
    whole, since the token may reach over the words that are remembered.
    """

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tokenizers

        self.own = tokenizers.Tokenizer.from_str(definition)
        self.dtype = dtype
        tokens = self.own.get_added_tokens_decoder().values()
        self.whole = [t.content for t in tokens]
        if any(t.normalized for t in tokens) and self.own.normalizer is not None:
            raise ValueError("added tokens of normalized text are not supported")
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        # A byte-level vocabulary writes each byte as one character.
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            lengths[number] = len(token)
        self.remembered = Remembered(self.ids, lengths, 400_000)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.whole:
            return self.remembered.encode(texts)
        apart = [any(t in text for t in self.whole) for text in texts]
        plain = iter(self.remembered.encode([text for text, own in zip(texts, apart) if not own]))
        return [self.ids(text).tobytes() if own else next(plain) for text, own in zip(texts, apart)]


def shard_row(part: int, number: int, keys: list[int], payloads: list[bytes], width: int) -> list:
    """One row of the store from documents in ascending key order."""
    key = np.array(keys, np.int64)
    ends = np.cumsum([len(p) // width for p in payloads]).astype("<u8")
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    distinct = key[first].view(U64)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, places = np.zeros(len(first), "<u4"), np.zeros((len(first), 2), "<u4")
    prints[slots] = fingerprint(distinct)
    places[slots, 0] = first
    places[slots, 1] = np.diff(np.r_[first, len(key)])
    return [part, number, keys[0], keys[-1], len(keys), int(ends[-1]), width, b"".join(payloads), ends.tobytes(), key.astype("<i8").tobytes(), index.to_bytes(), prints.tobytes(), places.tobytes()]


class Shard:
    """Constant-time keyed reads of one stored row."""

    def __init__(self, row: dict):
        self.width = row["width"]
        self.payload = row["payload"]
        self.ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
        self.index = PerfectHash.from_bytes(row["bits"])
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.places = np.frombuffer(row["places"], "<u4").reshape(-1, 2).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first document with each key (-1: not here) and how many have it."""
        keys = np.ascontiguousarray(keys, np.int64).view(U64)
        slots = self.index.slots(keys)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == fingerprint(keys[there])
        out, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        out[there], n[there] = self.places[slots[there]].T
        return out, n

    def start(self, place: int) -> int:
        return int(self.ends[place - 1]) if place else 0

    def ids(self, place: int) -> bytes:
        """Ids of a document as little-endian unsigned 32-bit integers."""
        raw = self.payload[self.width * self.start(place) : self.width * int(self.ends[place])]
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def write(docs: DataFrame, path: str, definition: str, end_id: int = 0) -> None:
    """Encode all texts, each with end_id after it, and write the store to path.

    The tokenizer is a byte-level one that starts a match at a single inner space. Ids take
    two bytes each where the vocabulary has at most 65,536.
    """
    spark = prepare(docs.sparkSession)
    import tokenizers

    size = tokenizers.Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    width, dtype = (2, "<u2") if size <= 1 << 16 else (4, "<u4")
    shared = spark.sparkContext.broadcast(definition)  # a vocabulary file of a few MB
    end = np.array([end_id], dtype).tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        own = kept("tokenizer", (hash(shared.value), dtype), lambda: Tokenizer(shared.value, dtype))
        keys: list[int] = []
        payloads: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row = shard_row(part, number, keys, payloads, width)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in COLUMNS.split(", ")])

        types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in COLUMNS.split(", ")]
        for batch in batches(rows, 4 << 20):
            for key, ids in zip(batch.column(0).to_pylist(), own.encode([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])):
                if held >= SHARD_BYTES:
                    yield flush()
                    keys, payloads, held, number = [], [], 0, number + 1
                keys.append(NULL_KEY if key is None else key)
                payloads.append(ids + end)
                held += len(ids) + width
        if keys:
            yield flush()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts_of(docs).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, COLUMNS).write.option("compression", "zstd").parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """part, shard, start: ids before each shard, by totals of the parts and within each part."""
    sizes = store.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    before = totals.select("part", (F.sum("_t").over(Window.orderBy("part")) - F.col("_t")).alias("_before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    # One row for each task that wrote: a proven bound.
    return sizes.withColumn("_inner", inner).join(F.broadcast(before), "part").select("part", "shard", (F.col("_before") + F.col("_inner")).alias("start"))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through its shard's index."""
    prepare(spark)
    store = spark.read.parquet(path)
    starts = shard_starts(store)
    joined = store.join(F.broadcast(starts) if store.count() <= BROADCAST_SHARDS else starts, ["part", "shard"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                shard = Shard(row)
                keys = np.frombuffer(row["keys"], "<i8")
                distinct = keys[np.r_[True, keys[1:] != keys[:-1]]]
                places, counts = shard.find(distinct)
                if (places < 0).any():
                    raise ValueError("a stored key is missing from its index")
                out: list[list] = [[], [], [], []]
                for key, place, n in zip(distinct.tolist(), places.tolist(), counts.tolist()):
                    for p in range(place, place + n):
                        ids = shard.ids(p)
                        for column, value in zip(out, (None if key == NULL_KEY else key, row["start"] + shard.start(p), len(ids) // 4, zlib.crc32(ids))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the stored documents with these keys (column doc_id); no row for others.

    Keys meet the shards whose range of ids holds them, by cells of ids: as many as there are
    shards, so that the cells of all shards are at most twice their number. A shard's keys are
    asked in groups of ASKED; its index tells, by fingerprint, whether it has each.
    """
    prepare(spark)
    store = spark.read.parquet(path)
    first = F.when(F.col("first_id") > NULL_KEY, F.col("first_id"))
    bounds = store.agg(F.min(first).alias("low"), F.max("last_id").alias("high"), F.count("*").alias("n")).first()
    width = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) // max(1, bounds["n"])))
    cell = lambda c: F.floor(F.col(c).cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)")).cast("long")
    places = store.select("part", "shard", "first_id", "last_id")
    # The shards that begin with null ids reach from the least id on too.
    low = bounds["low"] if bounds["low"] is not None else bounds["high"] or 0
    ranged = places.withColumn("_from", F.greatest("first_id", F.least(F.lit(low), "last_id"))).where(F.col("last_id") > NULL_KEY)
    cells = ranged.select("*", F.explode(F.sequence(cell("_from"), cell("last_id"))).alias("_cell"))
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("_key")).distinct()
    routed = wanted.where(F.col("_key") > NULL_KEY).withColumn("_cell", cell("_key")).join(cells, "_cell").where(F.col("_key").between(F.col("first_id"), F.col("last_id"))).select("part", "shard", "_key")
    nulls = wanted.where(F.col("_key") == NULL_KEY).join(places.withColumnRenamed("first_id", "_key"), "_key").select("part", "shard", "_key")
    routed = materialize(routed.unionAll(nulls), "asked-keys")
    groups = routed.groupBy("part", "shard").agg(F.ceil(F.count("*") / ASKED).alias("_k"))
    asked = routed.join(groups, ["part", "shard"]).groupBy("part", "shard", F.pmod(F.xxhash64("_key"), F.col("_k")).alias("_group")).agg(F.collect_list("_key").alias("asked"))
    joined = store.join(asked, ["part", "shard"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                shard, asked_ = Shard(row), np.array(row["asked"], np.int64)
                found = [(key, shard.ids(p)) for key, place, n in zip(asked_.tolist(), *map(np.ndarray.tolist, shard.find(asked_))) for p in range(place, place + n) if place >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([None if k == NULL_KEY else k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.binary())], ["doc_id", "ids"])

    return joined.mapInArrow(run, "doc_id long, ids binary")


def new_store(spark: SparkSession) -> str:
    return scratch(spark, "token-store")
