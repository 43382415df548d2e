"""Operator 9: sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in ascending id order. A balanced Feistel network permutes the
smallest domain of even bit width that holds n; a value outside 0..n-1 is put through the
network again until it falls inside (cycle walking), so the permutation is one of 0..n-1.
The permuted number p gives shard p % shards and slot p // shards: shard counts differ by
one at most, slots have no gaps, and both follow from the row number, n and the seed alone.

Cases: null ids come first in the order; equal ids are ordered by size and crc of the text;
null text has no bytes; an empty table gives no rows. Other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

ROUNDS = 6
U64 = np.uint64


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + U64(key)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & ((1 << 64) - 1) for i in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where each of these row numbers of 0..n-1 goes, or with back the number that went there."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, keys = U64((1 << half) - 1), _keys(seed)
    out = numbers.astype(U64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> U64(half), out[walk] & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_round(left, key) & mask), left
            else:
                left, right = right, left ^ (_round(right, key) & mask)
        out[walk] = left << U64(half) | right
        walk = out >= U64(n)
    return out.astype(np.int64)


def numbered(rows: DataFrame, by: list[str], partitions: int) -> tuple[DataFrame, int]:
    """Adds row_number 0..n-1 in the order of the columns, without one task for all rows.

    A range sort, a count for each partition, and running totals of these counts; only the
    counts, one for each partition, meet in one place. Every partition's rows are numbered
    from its own window, so the sort is the only exchange of rows.
    """
    from .common import prepare
    from loomlake.session import materialize

    prepare(rows.sparkSession)
    names = rows.columns

    def tag(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches_:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(at, at + k, dtype=np.int64))],
                [*names, "_part", "_at"],
            )
            at += k

    ordered = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    tagged = materialize(ordered.mapInArrow(tag, f"{schema}, _part int, _at long"), "numbered")
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start")
    )
    n = tagged.count()
    joined = tagged.join(F.broadcast(starts), "_part")  # a row for each partition of the sort
    return joined.select(*names, (F.col("_start") + F.col("_at")).alias("row_number")), n


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position (the permuted number), shard, slot."""
    spark = prepare(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, n = numbered(sized, ["doc_id", "size", "text_crc32"], partitions)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            p = permute(batch.column(3).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                ["doc_id", "size", "text_crc32", "row_number", "position", "shard", "slot"],
            )

    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, position long, shard int, slot long")
