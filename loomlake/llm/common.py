"""What the corpus operators share: document input, hashing of words and shingles, row layout."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.session import materialize, ship

U64 = np.uint64
#: An odd base for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the code and keep Arrow batches small: whole texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id long and text as UTF-8 bytes (null: empty); other columns stay behind."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def held_out(id_col: str, remainder: int):
    """True where crc32 of the id as text leaves this remainder modulo 5."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == remainder


#: What a Python worker keeps between tasks, of one operator at a time.
_KEPT: dict[str, object] = {}


def kept(kind: str, key: object, make):
    """The value of make() for this key, kept in the worker until another operator needs the room."""
    if _KEPT.get("kind") != (kind, key):
        release()
        _KEPT.update(kind=(kind, key), value=make())
    return _KEPT["value"]


def release() -> None:
    """Gives back what the worker has kept; Spark uses workers again for other operators."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its memory is then used again, if not returned


def batches(rows: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about so many bytes, so that memory follows the piece."""
    for batch in rows:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Rows of one number that are broadcast at most, some 16 MB in memory; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 400_000


def checked(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if it has BROADCAST_ROWS rows at most; count it cheaply, as a written table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def most_frequent(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the highest counts, limit at most: whole steps of a sixteenth of an octave.

    Only a count for each step, some hundred numbers, is gathered to find where to stop.
    """
    step = F.floor(F.log2(count) * 16).cast("int")
    taken, lowest = 0, None
    for row in rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > limit:
            break
        lowest = row["step"]
    return rows.where(step >= lowest) if lowest is not None else rows.where("false")


def share_of(rows: DataFrame, wanted: int, *cols: str) -> DataFrame:
    """About so many rows, or all where there are fewer: those with the lowest hashes of these columns."""
    n = rows.count()
    if n <= wanted:
        return rows
    return rows.where(F.pmod(F.xxhash64(*cols), F.lit(1 << 31)) < int((1 << 31) * wanted / n))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among these (column doc_id); null ids stay."""
    gone = checked(materialize(ids.withColumnRenamed("doc_id", "_gone"), "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (lower-cased A-Z, split at ASCII white space), in order."""
    if not text:
        return np.zeros(0, U64)
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than width make one shingle of all."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    out = np.zeros(n - k + 1, U64)
    for i in range(k):
        out = out * U64(BASE) + words[i : n - k + 1 + i]
    return mix(out + U64(k))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def groups_of(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys in rows that are sorted by key."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
