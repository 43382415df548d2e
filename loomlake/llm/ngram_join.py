"""Operator 8: n-gram Jaccard join by T-occurrence search with DivideSkip.

Documents with equal shingle sets form a class; the search links classes. Two sets of
similarity 0.75 or more share a shingle among the first n - ceil(0.75 n) + 1 of each, in any
order that all documents use. The order puts shingles seen often last, the most frequent at
the very end, so frequent lines and passages route nothing unless a document has hardly
anything else. These first shingles are dealt out by their hash in packed arrays:

1. Each class has a parity bitmap: bit i tells whether an odd number of its shingles fall on
   i. Two bitmaps differ in no more bits than the sets differ in shingles, which bounds the
   overlap from above and drops pairs that cannot reach it before any set is moved.
2. Lists of up to LIGHT classes give all their pairs; longer lists give a star from one
   class, and keep their members for step 4. Either way a pair counts only where the
   shingles from this one on suffice for the overlap: it is found at the first they share.
   Shingles in HOT classes or more are dealt out as rows by class, and their stars are a
   grouped minimum and a join, so no list of any length is in one task.
3. Candidate pairs are gathered by one of their ends, in chunks, and each is searched with
   DivideSkip: the inverted lists of the query's shingles over the chunk's documents; the
   shorter lists are merged with a heap, the longer are probed by binary search for those
   documents that can still reach the required overlap, which decides exactly.
4. Long lists whose members the links have not joined yet: members meet those that fall into
   the same small random cell; then every block of members meets every block that may hold
   another component, each pair of blocks a group of its own. Bitmaps and positions are
   compared inside such a group, and only pairs that may be linked leave it, to be searched
   as in step 3. Nothing is capped or dropped.

The links' connected components, over one representative a class, are the answer of join(),
which so leaves pairs of one component unverified; links() verifies every pair that can be linked.

Cases: texts without words have the empty set, link with nothing and are their own
component; fewer words than a shingle make one shingle of all; rows with a null id link with
nothing and have a null component; rows with equal ids share their component; an empty table
gives no rows; other columns, whatever their names, are not read; a long text is one row of one
task, which holds some ten times its bytes; class names are 64-bit hashes of the set.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.session import materialize

from .common import batches, checked, groups_of, mix, most_frequent, prepare, release, shingle_set, signed, texts_of, without
from .components import components

U64 = np.uint64
#: Classes in a list that gives all its pairs.
LIGHT = 32
#: Shingles whose frequency decides their place in the order: what the broadcast holds at most.
FREQUENT = 1 << 20
#: Classes that repeat a shingle within what is counted at once, summed, from which it is ordered by frequency.
OFTEN = 4
#: Distinct shingles that are counted at once in a task.
COUNTED = 600_000
CHUNK = 256
#: Classes of a shingle, as counted, from which its list is dealt out by class.
HOT = 200_000
#: Prefix shingles that a group of lists holds.
BUCKET = 250_000
#: Rounds in which members of long lists meet those of their random cell, and classes in a cell.
ROUNDS = 1
CELL = 32
#: Classes of a long list in one block.
BLOCK = 2048
#: What pairs of members l and r of a list must reach, as in reachable().
REACHABLE = "7 * least(l.rest, r.rest) >= 3 * (l.n + r.n)"
MU = 0.01
#: Bytes of bitmaps that are compared at once.
COMPARED = 4 << 20


def class_name(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles).sum(dtype=U64) + U64(len(shingles))], U64)).view(np.int64)[0])


def parity(shingles: np.ndarray) -> bytes:
    size = max(64, 1 << max(0, 2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def most_shared(n: int, m: int, a: bytes, b: bytes) -> int:
    """No two sets of these sizes and bitmaps share more; a wider bitmap is folded onto the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def described(docs: DataFrame, width: int, id_col: str) -> DataFrame:
    """kind 0: x doc_id, n set size, y class, bits its bitmap. kind 1: x shingle, n classes that have it, where two or more of those counted together do."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []
        known: set[int] = set()

        def row(kind: int, x, n, y, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(y, pa.int64()), pa.array(bits, pa.binary())], ["kind", "x", "n", "y", "bits"])

        def counted() -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate(held), return_counts=True)
            return row(1, signed(shingle[n > 1]), n[n > 1], np.zeros((n > 1).sum(), np.int64), [None] * int((n > 1).sum()))

        for batch in batches(rows):
            ids, sizes, names, bits = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                name = class_name(shingles)
                sizes.append(len(shingles))
                names.append(name)
                if name not in known:
                    known.add(name)
                    held.append(shingles)
                    bits.append(parity(shingles))
                else:
                    bits.append(None)  # the first of its class in this task has it
            yield row(0, ids, sizes, names, bits)
            if sum(map(len, held)) > COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    return materialize(texts_of(docs, id_col).mapInArrow(run, "kind int, x long, n long, y long, bits binary"), "sets", "kind")


def reachable(a: np.ndarray, b: np.ndarray, size: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row pairs that can be linked if this is the first shingle they share.

    rest counts a set's shingles from this one on in the common order: no more can be shared.
    """
    fits = 7 * np.minimum(rest[a], rest[b]) >= 3 * (size[a] + size[b])
    return a[fits], b[fits]


def candidates(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, buckets: int, id_col: str) -> DataFrame:
    """kind 0: a, b candidate classes. kind 1: members b, of size n and with rest left, of a long list a; kind 2: of a hot one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        often, rank, hot = shared.value
        known: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _, _ in held])
            lengths = [len(x) for x, _, _ in held]
            cell = ((h >> U64(32)) % U64(buckets)).astype(np.int64)
            name = np.repeat(np.array([c for _, c, _ in held], np.int64), lengths)
            if len(hot):
                # Beyond the buckets: as many again for each of them, dealt by class.
                there = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                cell[there] += buckets * (1 + (name[there].view(U64) % U64(64)).astype(np.int64))
            order = np.argsort(cell, kind="stable")
            name = name[order]
            size = np.repeat(np.array([n for _, _, n in held], np.uint32), lengths)[order]
            rest = np.concatenate([np.arange(n, n - k, -1) for (_, _, n), k in zip(held, lengths)]).astype(np.uint32)[order]
            low = (h & U64(0xFFFFFFFF)).astype(np.uint32)[order]
            found, first = np.unique(cell[order], return_index=True)
            cuts = [*first.tolist(), len(order)]
            cols = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in (low, name, size, rest)]
            return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "low", "name", "size", "rest"])

        total = 0
        for batch in batches(rows):
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                n = len(shingles)
                name = class_name(shingles)
                if not n or name in known:
                    continue
                known.add(name)
                keep = n - -(-3 * n // 4) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
                    is_often = often[at] == shingles
                    rare = shingles[~is_often][:keep]
                    if len(rare) < keep:
                        late = np.flatnonzero(is_often)
                        late = late[np.argsort(rank[at[late]], kind="stable")][: keep - len(rare)]
                        rare = np.concatenate([rare, shingles[late]])
                else:
                    rare = shingles[:keep]
                held.append((rare, name, n))
                total += len(rare)
            if total > COUNTED // 2:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        release()
        low, name, size, rest = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("low", np.uint32), ("name", np.int64), ("size", np.uint32), ("rest", np.uint32)))
        order = np.lexsort((-rest.astype(np.int64), name, low))
        low, name, size, rest = low[order], name[order], size[order].astype(np.int64), rest[order].astype(np.int64)
        new = np.r_[True, (low[1:] != low[:-1]) | (name[1:] != name[:-1])]
        low, name, size, rest = low[new], name[new], size[new], rest[new]
        bucket = group.column("bucket")[0].as_py()
        if bucket >= buckets:
            return pa.table({"kind": np.full(len(low), 2, np.int32), "a": low.astype(np.int64) * buckets + bucket % buckets, "b": name, "n": size, "rest": rest})
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        count = np.diff(np.r_[first, len(low)])
        out_a, out_b, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for m in np.unique(count[count > 1]).tolist():
            starts = first[count == m]
            rows = starts[:, None] + np.arange(m)
            if m <= LIGHT:
                i, j = np.triu_indices(m, 1)
                a, b = rows[:, i].ravel(), rows[:, j].ravel()
            else:
                members.append(rows)
                a, b = np.repeat(starts, m - 1), rows[:, 1:].ravel()
            a, b = reachable(a, b, size, rest)
            out_a.append(name[a])
            out_b.append(name[b])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b = a[new], b[new]
        where = np.concatenate([r.ravel() for r in members]) if members else np.zeros(0, np.int64)
        kind = np.r_[np.zeros(len(a), np.int32), np.ones(len(where), np.int32)].astype(np.int32)
        return pa.table({"kind": kind, "a": np.r_[a, low[where].astype(np.int64) * buckets + bucket], "b": np.r_[b, name[where]], "n": np.r_[np.zeros(len(a), np.int64), size[where]], "rest": np.r_[np.zeros(len(a), np.int64), rest[where]]})

    dealt = texts_of(docs, id_col).mapInArrow(deal, "bucket long, low binary, name binary, size binary, rest binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, n long, rest long")
    return materialize(met, "candidates", "kind")


def divide_skip(query: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Which of these sorted sets are linked with the query."""
    n = len(query)
    need = [-(-3 * (n + len(o)) // 7) for o in others]
    able = [i for i, o in enumerate(others) if need[i] <= min(n, len(o))]
    if not able:
        return []
    owner = np.repeat(np.array(able), [len(others[i]) for i in able])
    flat = np.concatenate([others[i] for i in able])
    at = np.minimum(np.searchsorted(query, flat), n - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # owners stay ascending within each list
    cuts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else np.zeros(0, np.int64)
    lists = [x.tolist() for x in np.split(owner[order], cuts[1:])] if len(at) else []
    lists.sort(key=len)
    least = min(need[i] for i in able)
    longest = len(lists[-1]) if lists else 1
    n_long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)), len(lists))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    linked = []
    for i, run in groupby(heapq.merge(*short)):
        got = sum(1 for _ in run)
        left = len(long_)
        if got < least - left:
            continue
        for row in long_:
            if got >= need[i] or got + left < need[i]:
                break
            left -= 1
            k = bisect_left(row, i)
            got += k < len(row) and row[k] == i
        if got >= need[i]:
            linked.append(i)
    return linked


def plausible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs a, b whose bitmaps allow the overlap that they need."""
    left = bitmaps.withColumnsRenamed({"name": "a", "n": "na", "bits": "bits_a"})
    right = bitmaps.withColumnsRenamed({"name": "b", "n": "nb", "bits": "bits_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b")

    def bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = [7 * most_shared(n, m, x, y) >= 3 * (n + m) for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:2]], ["a", "b"])

    return materialize(both.mapInArrow(bound, "a long, b long"), "plausible")


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, id_col: str) -> DataFrame:
    """name, shingles (ascending hashes) of the classes in these pairs, from one document each."""
    wanted = pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name"))).distinct()
    ids = materialize(wanted.join(classes, "name").select("class_id"), "wanted")
    source = texts_of(docs, id_col)
    picked = source.join(checked(ids), source["doc_id"] == F.col("class_id"), "left_semi")

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            sets_ = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_name(s) for s in sets_], pa.int64()), pa.array([s.tobytes() for s in sets_], pa.binary())], ["name", "shingles"])

    return materialize(picked.mapInArrow(hashed, "name long, shingles binary"), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b of classes that are linked."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("k"))
    chunked = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("chunk"))
    other = chunked.join(sets.select(F.col("name").alias("b"), "shingles"), "b").select("a", "chunk", "b", "shingles")
    query = chunked.select("a", "chunk").distinct().join(sets.select(F.col("name").alias("a"), "shingles"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles")

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        current, query_, names, others = None, None, [], []

        def done() -> pa.RecordBatch:
            hits = divide_skip(query_, others) if query_ is not None and others else []
            return pa.RecordBatch.from_arrays([pa.array([current[0]] * len(hits), pa.int64()), pa.array([names[i] for i in hits], pa.int64())], ["a", "b"])

        for batch in rows:
            for a, chunk, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, chunk) != current:
                    if current is not None:
                        yield done()
                    current, query_, names, others = (a, chunk), None, [], []
                if b is None:
                    query_ = np.frombuffer(raw, U64)
                else:
                    names.append(b)
                    others.append(np.frombuffer(raw, U64))
        if current is not None:
            yield done()

    blocks = query.unionAll(other).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return blocks.mapInArrow(search, "a long, b long")


def folded(bits: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of each bitmap, and by number of words: where each row's bitmap stands and the bitmaps, those of twice the width folded."""
    width = np.array([len(x) // 8 for x in bits], np.int64)
    levels = {}
    for w in np.unique(width).tolist():
        place, rows = np.full(len(bits), -1, np.int64), []
        for factor in (1, 2):
            own = np.flatnonzero(width == factor * w)
            place[own] = np.arange(len(own)) + sum(map(len, rows))
            found = np.frombuffer(b"".join(bits[i] for i in own.tolist()), U64).reshape(len(own), factor * w)
            rows.append(found[:, :w] if factor == 1 else found[:, :w] ^ found[:, w:])
        levels[w] = place, np.concatenate(rows)
    return width, levels


def may_link(name: np.ndarray, n: np.ndarray, rest: np.ndarray, label: np.ndarray, bits: list[bytes], side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the pairs, of different labels, that sizes, positions and bitmaps allow: of rows of side 0 with rows of side 1, or of all rows where the side is 2."""
    width, levels = folded(bits)
    lefts, rights, diagonal = np.flatnonzero(side != 1), np.flatnonzero(side != 0), bool((side == 2).all())
    step = max(1, 1_000_000 // max(1, len(rights)))
    for at in range(0, len(lefts), step):
        i = lefts[at : at + step, None]
        fits = (label[i] != label[rights]) & (7 * np.minimum(rest[i], rest[rights]) >= 3 * (n[i] + n[rights]))
        if diagonal:
            fits &= name[i] < name[rights]
        a, b = np.nonzero(fits)
        a, b = lefts[at + a], rights[b]
        level = np.minimum(width[a], width[b])
        for w, (place, rows) in levels.items():
            own = np.flatnonzero(level == w)
            for x in range(0, len(own), max(1, COMPARED // (8 * w))):
                k = own[x : x + max(1, COMPARED // (8 * w))]
                p, q = a[k], b[k]
                both = n[p] + n[q]
                shared = (both - np.bitwise_count(rows[place[p]] ^ rows[place[q]]).sum(1, dtype=np.int64)) // 2
                good = 7 * shared >= 3 * both
                yield name[p[good]], name[q[good]]


def met(groups: DataFrame, *key: str) -> DataFrame:
    """a < b, distinct: the pairs that may be linked within the groups of name, n, rest, label, bits, side by this key."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, group in groups_of(rows, "run"):
            name, n, rest, label, side = (group.column(c).to_numpy() for c in ("name", "n", "rest", "label", "side"))
            for a, b in may_link(name, n, rest, label, group.column("bits").to_pylist(), side):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    run_ = F.xxhash64(*key).alias("run")  # two groups of one hash meet as one, which asks for more pairs and loses none
    dealt = groups.select(run_, "name", "n", "rest", "label", "bits", "side").repartition("run").sortWithinPartitions("run")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_cells(members: DataFrame, step: int) -> DataFrame:
    """Pairs of members of a list that fall into the same random cell of about CELL."""
    cells = members.groupBy("list").agg(F.ceil(F.count("*") / CELL).alias("k"))
    dealt = members.join(cells, "list").withColumn("cell", F.pmod(F.xxhash64("name", "list", F.lit(step)), F.col("k")))
    return met(dealt.withColumn("side", F.lit(2)), "list", "cell")


def in_blocks(members: DataFrame) -> DataFrame:
    """Pairs of members of a list that have different labels, all of them.

    A label with BLOCK members in a list has blocks of its own, which do not meet each other;
    the others share blocks.
    """
    sizes = members.groupBy("list", "label").agg(F.count("*").alias("c"))
    pure = (F.col("c") >= BLOCK).alias("pure")
    small = sizes.groupBy("list").agg(F.coalesce(F.sum(F.when(F.col("c") < BLOCK, F.col("c"))), F.lit(0)).alias("small"))
    number = F.when(F.col("c") >= BLOCK, F.pmod(F.xxhash64("name"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.ceil(F.col("small") / BLOCK))))
    own = F.when(F.col("c") >= BLOCK, F.col("label"))
    block = F.struct(pure, own.alias("own"), number.alias("number"))
    placed = materialize(members.join(sizes, ["list", "label"]).join(small, "list").select("list", "name", "n", "rest", "label", "bits", block.alias("block")), "blocks")
    blocks = placed.select("list", "block").distinct()
    pairs = blocks.select("list", F.col("block").alias("i")).join(blocks.select("list", F.col("block").alias("j")), "list")
    pairs = pairs.where("i <= j AND NOT (i.pure AND j.pure AND i.own = j.own)")
    left = placed.join(pairs.withColumn("block", F.col("i")), ["list", "block"]).withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise(0))
    right = placed.join(pairs.where("i < j").withColumn("block", F.col("j")), ["list", "block"]).withColumn("side", F.lit(1))
    return met(left.unionByName(right), "list", "i", "j")


def _routed(docs: DataFrame, width: int, id_col: str):
    """Rows, classes, pairs of short lists, members of long ones, and a search for the linked ones of pairs a, b."""
    spark = prepare(docs.sparkSession)
    base = described(docs, width, id_col)
    rows = base.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("y").alias("name"))
    classes = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("class_id"))
    counted = materialize(base.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "frequent")
    top = most_frequent(counted, "n", FREQUENT).toPandas().sort_values(["n", "x"], ascending=[False, True])
    shingle = top["x"].to_numpy(np.int64).view(U64)
    order = np.argsort(shingle)
    hot = np.sort(shingle[top["n"].to_numpy(np.int64) >= HOT])
    frequent = shingle[order], (len(top) - np.arange(len(top)))[order].astype(np.int32), hot

    shingles = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // 4 // BUCKET)
    known = docs.where(F.col(id_col).isNotNull())
    found = candidates(known, frequent, width, buckets, id_col)
    pairs = found.where("kind = 0").select("a", "b")
    members = found.where("kind > 0").select(F.col("a").alias("list"), F.col("b").alias("name"), "n", "rest")
    if len(hot):
        entry = F.struct("name", "n", "rest")
        own = found.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("name"), "n", "rest").groupBy("list", "name").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))
        stars = own.select("list", entry.alias("r")).join(own.groupBy("list").agg(F.min(entry).alias("l")), "list").where("l.name < r.name").where(REACHABLE)
        pairs = pairs.unionAll(stars.select(F.least("l.name", "r.name").alias("a"), F.greatest("l.name", "r.name").alias("b")))
        members = found.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("name"), "n", "rest").unionByName(own)
    pairs = pairs.distinct()

    bitmaps = base.where("kind = 0 AND bits IS NOT NULL").groupBy(F.col("y").alias("name")).agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    def search(likely: DataFrame) -> DataFrame:
        return materialize(verified(likely, sets_of(known, classes, likely, width, id_col)), "links")

    return rows, classes, plausible(pairs, bitmaps), members, bitmaps.drop("n"), search


def join(docs: DataFrame, width: int = 5, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id."""
    rows, classes, pairs, members, bitmaps, search = _routed(docs, width, id_col)
    labels = materialize(classes.withColumn("label", F.col("class_id")), "labels")

    def joined(linked: DataFrame) -> DataFrame:
        """The labels with those that these links join replaced by the smallest of them."""
        left, right = (labels.select(F.col("name").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        found = components(linked.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        new = labels.join(found, F.col("label") == F.col("node"), "left")
        return materialize(new.select("name", "class_id", F.coalesce("component", "label").alias("label")), "labels")

    labels = joined(search(pairs))
    for step in range(ROUNDS + 1):
        placed = materialize(members.join(labels.select("name", "label"), "name"), "long-lists")
        split = placed.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("list")
        members = materialize(placed.join(split, "list").join(bitmaps, "name"), "long-lists")
        if not members.limit(1).count():
            break
        more = in_cells(members, step) if step < ROUNDS else in_blocks(members)
        labels = joined(search(materialize(more.join(pairs, ["a", "b"], "left_anti"), "asked")))
        members = members.select("list", "name", "n", "rest")
    answer = rows.join(labels, "name", "left")
    return answer.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def links(docs: DataFrame, width: int = 5, id_col: str = "doc_id") -> DataFrame:
    """class_a, class_b (a < b): every two classes that are linked, by their class_id.

    Long lists are cut into blocks of about BLOCK classes, and each block meets each in a group
    of its own, so a pair is lost nowhere and no list is one task. The output grows with the
    links: n near copies of each other have n * (n - 1) / 2.
    """
    _, classes, pairs, members, bitmaps, search = _routed(docs, width, id_col)
    more = in_blocks(members.withColumn("label", F.col("name")).join(bitmaps, "name"))
    found = search(materialize(pairs.unionAll(more).distinct(), "asked"))
    ends = found.join(classes.withColumnsRenamed({"name": "a", "class_id": "ca"}), "a").join(classes.withColumnsRenamed({"name": "b", "class_id": "cb"}), "b")
    return ends.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"))


def representatives(docs: DataFrame, width: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the one with the smallest id.

    Rows with a null id stay; of rows with one id, one stays.
    """
    found = materialize(join(docs, width, id_col).select("doc_id", "component_id"), "components")
    several = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    out = without(docs, found.where("doc_id <> component_id").select("doc_id").distinct(), id_col)
    if several.limit(1).count():
        once = docs.join(several, docs[id_col] == several["doc_id"], "left_semi").dropDuplicates([id_col])
        kept = found.where("doc_id = component_id").select("doc_id").distinct()
        out = without(out, several, id_col).unionAll(once.join(kept, once[id_col] == kept["doc_id"], "left_semi"))
    return out
