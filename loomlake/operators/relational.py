"""Containment and anti joins, last-wins, unions, and map-reduce sums over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomlake.session import materialize, ship

#: Bytes of names that one broadcast of a containment join carries.
BLOCK_BYTES = 8 << 20


def shard_sum(rows: DataFrame, shard: str, value: str) -> DataFrame:
    """Sums within each shard, then over the shards from zero; 64-bit unsigned totals as decimals."""
    own = rows.groupBy(shard).agg(F.sum(F.col(value).cast("decimal(20,0)")).alias("_own"))
    return own.agg(F.coalesce(F.sum("_own"), F.lit(0)).cast("decimal(20,0)").alias("total"), F.count("*").alias("shards"))


def containing(names: DataFrame, id_col: str, key: str, rows: DataFrame, cell: str, *more: str) -> DataFrame:
    """id_col and these columns of rows, for each row whose cell contains the key; both normalised by the caller.

    Names are taken in blocks of about BLOCK_BYTES at most, each broadcast to one pass over the
    rows, which stay where they lie: an automaton of all names of the block reads each cell
    once, so work follows the rows and what they hold, not rows times names. An empty key is
    in every cell that is not null; null keys and cells match nothing.
    """
    spark = ship(rows.sparkSession)
    wanted = names.where(F.col(key).isNotNull()).select(F.col(id_col), F.col(key))
    total = wanted.agg(F.sum(F.octet_length(key) + 32)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    schema = T.StructType([names.schema[id_col], *(rows.schema[c] for c in more)])
    source, out = rows.where(F.col(cell).isNotNull()).select(cell, *more), None
    for i in range(n):
        block = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64(key, id_col), F.lit(n)) == i)
        shared = spark.sparkContext.broadcast([tuple(r) for r in block.toLocalIterator()])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            ids, owners = [i for i, _ in shared.value], {}
            for k, (_, name) in enumerate(shared.value):
                owners.setdefault(name, []).append(k)
            always = owners.pop("", [])
            automaton = ahocorasick.Automaton()
            for name, own in owners.items():
                automaton.add_word(name, own)
            automaton.make_automaton()
            for batch in batches:
                at, hit = [], []
                for row, text in enumerate(batch.column(0).to_pylist()):
                    found = set(always)
                    for _, own in automaton.iter(text) if owners else ():
                        found.update(own)
                    at += [row] * len(found)
                    hit += [ids[k] for k in found]
                rest = [batch.column(c + 1).take(pa.array(at, pa.int64())) for c in range(len(more))]
                kind = to_arrow_type(schema[0].dataType)
                yield pa.RecordBatch.from_arrays([pa.array(hit, kind), *rest], [schema[0].name, *more])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return out


def inventory(names: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds n_rows (that contain the name) and with_version (whether one of these holds the version).

    names: id, name (normalised), version; rows: cell (normalised), detail.
    """
    found = containing(names, "id", "name", rows, "cell", "detail").join(names.select("id", "version"), "id")
    held = found.groupBy("id").agg(F.count("*").alias("n_rows"), F.bool_or(F.contains(F.col("detail"), F.col("version"))).alias("with_version"))
    joined = names.join(held, "id", "left")
    return joined.select(*names.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "with_version")


def inventory_error() -> Column:
    """missing, not_inventoried, or null, for rows of inventory()."""
    return F.when(F.col("n_rows") == 0, "missing").when(F.col("version").isNotNull() & ~F.col("with_version"), "not_inventoried")


def last_wins(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its last row in this order."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(key).agg(last).select(key, *(F.col(f"_last.{v}").alias(v) for v in values))


def union_distinct(*paths: DataFrame) -> DataFrame:
    """The distinct paths of all inputs in the order of their parts."""
    out = paths[0]
    for other in paths[1:]:
        out = out.unionAll(other)
    return out.distinct().orderBy(F.split("path", "/"))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds i, from 0 within each key in this order.

    Rows are sorted by range, so a key of any size is spread; each key's ranges are numbered
    by themselves and then moved by the counts of those before, one row a key and range.
    """
    spread = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    placed = materialize(spread, "ranges")
    own = Window.partitionBy(key, "_range").orderBy(*order)
    counts = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")).drop("_n")
    ranked = placed.withColumn("_i", F.row_number().over(own) - 1)
    before = before.withColumnsRenamed({key: "_own", "_range": "_of"})
    found = ranked.join(before, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_own")))
    return found.select(*rows.columns, (F.col("_i") + F.col("_before")).cast("long").alias("i"))
