"""Operator 6: substring deduplication with a suffix array sorted deep-shallow.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Any such string has an anchor: the 16-byte string in it with the least hash.
Equal strings have their anchor at the same place, so it is enough to sort the suffixes that
start at anchors, and the reversed prefixes that end there (a sparse suffix array; no more
than LENGTH bytes of either can matter):

1. Hashes of the anchors (about one in seventeen bytes) are dealt out in packed arrays; those
   in one document only go no further.
2. Each partition of documents sorts the suffixes at its shared anchors. Occurrences that
   agree in all bytes that a string over them can reach are settled there: only the one with
   the smallest id travels, to the task of its anchor.
3. There suffixes and reversed prefixes are sorted deep-shallow: multikey quicksort on
   eight-byte words to the shallow depth, which is the anchor itself, then blind tries for
   the groups that agree so far. A trie branches at the first place where its members
   differ, and looks at that byte alone; all groups' tries grow level by level at once.
   Common-prefix lengths of neighbours in both orders tell which occurrences agree on which
   string, and the smallest id of those that do.
4. An anchor in HOT documents or more is left to no task: its strings become rows, whose least
   ids Spark finds by a grouped minimum, pre-aggregated where they lie.
5. The starts found go back to their documents, where the covered bytes are taken out.

Hashes only choose what meets; that two strings are equal is decided on their bytes.

Cases: null text is empty; a null id is neither smaller than another nor larger, so such rows
stay whole and remove nothing; rows with equal ids do not remove from each other; an empty
table gives no rows; other columns, whatever their names, are not read; a long text is one row
of one task, which holds some thirty times its bytes; text may hold any bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.session import materialize

from .common import BASE, batches, mix, prepare, release, texts_of

U64 = np.uint64
LENGTH = 50
ANCHOR = 16
#: Bytes of text that one partition of documents holds.
PARTITION_BYTES = 6 << 20
#: Words of eight bytes that quicksort looks at: the anchor. Blind tries order what lies deeper.
SHALLOW_WORDS = ANCHOR // 8
#: Anchors that are gathered before they are dealt out.
HELD = 300_000
#: Occurrences that are sorted at once, but for a single anchor that has more.
SORTED = 60_000
#: Documents of an anchor from which its strings are compared by a grouped minimum.
HOT = 100_000


def _record(length: int) -> np.dtype:
    """An occurrence: its anchor's hash, place, and bytes: the suffix, the reversed prefix, and how far the text goes on either side."""
    width = 2 * length - ANCHOR + 2
    return np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("part", "<u4"), ("pos", "<u4"), ("bytes", "u1", (width,))])


def _flag(length: int) -> np.dtype:
    """Bit j of the mask: the string that starts j bytes before pos is a repeat."""
    return np.dtype([("row", "<i8"), ("pos", "<u4"), ("mask", "u1", (-(-(length - ANCHOR + 1) // 8),))])


def packed(records: np.ndarray) -> bytes:
    """Records column by column, compressed: half of what would be shuffled otherwise."""
    return zstandard.compress(b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names), 1)


def unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(data)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for c in dtype.names:
        size = out.dtype[c].itemsize * len(out)
        out[c] = np.frombuffer(raw[at : at + size], out.dtype[c].base).reshape(out[c].shape)
        at += size
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of this length, and their hashes."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = raw.astype(U64) + U64(1)
    step = 1
    while step < ANCHOR:
        h = h[:-step] * U64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h = mix(h) | U64(1)
    width = length - ANCHOR + 1
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, U64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at]


def _laid_out(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all places of these segments: the segment and the place; and where each segment's first one is."""
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    segment = np.repeat(np.arange(len(starts)), sizes)
    return segment, np.arange(len(segment)) - first[segment] + starts[segment], first


def quicksort_rounds(words: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the segments of order, in place, all at once; starts and sizes of those equal in the first limit words."""
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    keep = sizes > 1
    starts, sizes, depth = starts[keep], sizes[keep], np.zeros(keep.sum(), np.int64)
    while len(starts):
        segment, where, first = _laid_out(starts, sizes)
        rows = order[where]
        word = words[rows, depth[segment]]
        pivot = word[first + sizes // 2][segment]
        level = np.logical_and.reduceat(word == pivot, first)
        depth[level] += 1  # nothing to move
        done = level & (depth >= limit)
        deep.append((starts[done], sizes[done]))
        uneven = ~level[segment]
        key = segment[uneven] * 3 + (word[uneven] >= pivot[uneven]) + (word[uneven] > pivot[uneven])
        moved = np.argsort(key, kind="stable")
        order[where[uneven]] = rows[uneven][moved]
        key = key[moved]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        size = np.diff(np.r_[cut, len(key)])
        down = depth[key[cut] // 3] + (key[cut] % 3 == 1)
        there = where[uneven][cut]
        done_now = (down >= limit) & (size > 1)
        deep.append((there[done_now], size[done_now]))
        on, again = level & ~done, (size > 1) & ~done_now
        starts, sizes, depth = np.r_[starts[on], there[again]], np.r_[sizes[on], size[again]], np.r_[depth[on], down[again]]
    return np.concatenate([np.zeros(0, np.int64), *(s for s, _ in deep)]), np.concatenate([np.zeros(0, np.int64), *(s for _, s in deep)])


def blind_tries(words: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, common: np.ndarray, from_word: int, width: int) -> None:
    """Orders segments that agree in the words before from_word by a blind trie each, in place.

    A node's skip is the first byte in which its members differ; its children have one byte
    there each, and no byte between is looked at again. Neighbours share as many bytes as the
    node skips at which they part, which goes into common; equal strings share a leaf.
    """
    end = 8 * words.shape[1]
    while len(starts):
        node, where, first = _laid_out(starts, sizes)
        rows = order[where]
        skip = np.full(len(rows), end, np.int64)
        for k in range(words.shape[1] - 1, from_word - 1, -1):
            word = words[rows, k]
            word ^= word[first][node]
            differ = np.flatnonzero(word)
            word = word[differ]
            zeros = np.zeros(len(differ), np.int64)
            for bits in range(56, 0, -8):
                zeros += word < U64(1 << bits)
            skip[differ] = 8 * k + zeros
        at = np.minimum.reduceat(skip, first)
        leaf = at == end
        same = leaf[node]
        same[first] = False
        common[where[same]] = width
        inner = ~leaf[node]
        node, where, rows = node[inner], where[inner], rows[inner]
        if not len(rows):
            break
        place = at[node]
        byte = (words[rows, place >> 3] >> (U64(56) - U64(8) * (place & 7).astype(U64))) & U64(255)
        key = (node << 8) | byte.astype(np.int64)
        moved = np.argsort(key, kind="stable")
        order[where] = rows[moved]
        key = key[moved]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        child = cut[1:][key[cut[1:]] >> 8 == key[cut[1:] - 1] >> 8]
        common[where[child]] = at[key[child] >> 8]
        starts, sizes = where[cut][size > 1], size[size > 1]


def deep_shallow(group: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of data within ascending groups; common prefix with the row before (-1: another group)."""
    n, width = data.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = data
    words = padded.view(">u8").astype(U64)
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]][:n])
    common = np.full(n, -2, np.int64)
    common[starts] = -1
    limit = min(SHALLOW_WORDS, words.shape[1])
    deep, sizes = quicksort_rounds(words, order, starts, np.diff(np.r_[starts, n]), limit)
    blind_tries(words, order, deep, sizes, common, limit, width)
    for at in np.array_split(np.flatnonzero(common == -2), 1 + n // 100_000):  # those that quicksort has parted
        differ = padded[order[at], :width] != padded[order[at - 1], :width]
        common[at] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def reachable(records: np.ndarray, length: int) -> np.ndarray:
    """For each occurrence and j: whether its text has the string that starts j bytes before it."""
    j = np.arange(length - ANCHOR + 1)
    return (records["bytes"][:, -2:-1] >= j) & (records["bytes"][:, -1:] >= length - ANCHOR - j)


def settled(records: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the order of their suffixes, the prefix each shares with the one before, and whether a smaller id has all its bytes."""
    _, group = np.unique(records["anchor"], return_inverse=True)
    order, common = deep_shallow(group, records["bytes"])
    doc = records["doc"][order]
    first = np.flatnonzero(common < records["bytes"].shape[1])
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(doc)]))
    return order, common, doc > least


def repeated_starts(records: np.ndarray, length: int) -> np.ndarray:
    """For each occurrence and j: whether the string that starts j bytes before it also starts in a document with a smaller id."""
    reach = length - ANCHOR
    order, common, again = settled(records, length)
    repeated = np.zeros((len(records), reach + 1), bool)
    valid = reachable(records, length)
    repeated[order[again]] = valid[order[again]]
    first = common == -1
    number = np.cumsum(first) - 1
    several = np.bincount(number, ~again) > 1  # an anchor with but one occurrence left has nothing to meet
    stay = np.flatnonzero(~again & several[number])
    if not len(stay):
        return repeated
    # With rows left out, neighbours share the least of what lies between them.
    shared = np.minimum.reduceat(common[: stay[-1] + 1], np.r_[0, stay[:-1] + 1])
    right, group, right_common = order[stay], number[stay], np.minimum(shared, length)
    data = records["bytes"][right]
    left, left_common = deep_shallow(group, np.concatenate([data[:, ANCHOR - 1 :: -1], data[:, length : length + reach]], axis=1))
    doc, valid = records["doc"][right], valid[right]
    found = np.zeros(valid.shape, bool)
    class_l = np.empty(len(right), np.int64)
    for j in range(reach + 1):
        rows = np.flatnonzero(valid[:, j])
        if not len(rows):
            continue
        class_r = np.cumsum(right_common < length - j)
        class_l[left] = np.cumsum(left_common < ANCHOR + j)
        key = class_r[rows] * (len(right) + 1) + class_l[rows]
        by_key = np.argsort(key, kind="stable")
        key, rows = key[by_key], rows[by_key]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(doc[rows], head), np.diff(np.r_[head, len(key)]))
        found[rows, j] = doc[rows] > least
    repeated[right] |= found
    return repeated


def occurrences(doc: int, row: int, part: int, raw: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    reach = length - ANCHOR
    out = np.zeros(len(at), _record(length))
    padded = np.zeros(len(raw) + 2 * length, np.uint8)
    padded[length : length + len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view
    out["anchor"], out["doc"], out["row"], out["part"], out["pos"] = hashes, doc, row, part, at
    data = out["bytes"]
    data[:, :length] = view(padded, length)[at + length]
    data[:, length : length + reach] = view(padded, reach)[at + length - reach, ::-1]
    data[:, -2], data[:, -1] = np.minimum(at, reach), np.minimum(len(raw) - at - ANCHOR, reach)
    return out


def by_anchor(records: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The records in pieces of about this size, an anchor's in one piece."""
    records = records[np.argsort(records["anchor"], kind="stable")]
    heads = np.flatnonzero(np.r_[True, records["anchor"][1:] != records["anchor"][:-1]][: len(records)])
    ends = np.r_[heads[1:], len(records)]
    at = 0
    while at < len(records):
        to = int(ends[np.searchsorted(ends, min(at + size, len(records)))])
        yield records[at:to]
        at = to


def flags_of(records: np.ndarray, repeated: np.ndarray, length: int) -> np.ndarray:
    hit = repeated.any(1)
    flags = np.zeros(hit.sum(), _flag(length))
    flags["row"], flags["pos"] = records["row"][hit], records["pos"][hit]
    flags["mask"] = np.packbits(repeated[hit], axis=1, bitorder="little")
    return flags


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the strings at these starts cover."""
    change = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    change[starts] += 1
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def _runs(key: np.ndarray) -> tuple[list, list[int]]:
    """Distinct values of an ascending key, and where their runs begin and end."""
    found, first = np.unique(key, return_index=True)
    return found.tolist(), [*first.tolist(), len(key)]


class _Parts:
    """The hash of an anchor as bucket and low part, and as the key that both make."""

    def __init__(self, parts: int):
        self.parts = U64(parts)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(33)) % self.parts

    def low(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(1)) & U64(0xFFFFFFFF)

    def key(self, h: np.ndarray) -> np.ndarray:
        return self.low(h) * self.parts + self.bucket(h)


def _shared(placed: DataFrame, parts: int, length: int) -> DataFrame:
    """part, keys: the anchors of its documents that two documents have; hot: those of them that HOT documents have."""
    split = _Parts(parts)
    below = np.uint32((1 << 26) - 1)  # bits of an owner for the partition; six more for the number of its documents

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, int]] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            p = np.repeat(np.array([p for _, p in held], np.uint32), [len(x) for x, _ in held])
            order = np.lexsort((h, p))
            h, p = h[order], p[order]
            head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])])
            many = np.ceil(np.log2(np.diff(np.r_[head, len(h)]))).astype(np.uint32)
            owner, h = p[head] | (many << np.uint32(26)), h[head]
            cell = split.bucket(h)
            order = np.lexsort((owner, cell))
            low, owner = split.low(h).astype("<u4")[order], owner[order]
            found, cuts = _runs(cell[order])
            runs = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = a + np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
                runs.append(np.stack([owner[at], np.diff(np.r_[at, b]).astype("<u4")], 1).tobytes())
            lows = [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(lows, pa.binary()), pa.array(runs, pa.binary())], ["bucket", "low", "runs"])

        count = 0
        for batch in batches(rows):
            for doc, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                h = np.unique(anchors(np.frombuffer(text, np.uint8), length)[1]) if doc is not None else ()
                if len(h):
                    held.append((h, part))
                    count += len(h)
            if count > HELD:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        low, runs = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u4") for c in ("low", "runs"))
        owner = np.repeat(runs[::2], runs[1::2])
        order = np.argsort(low, kind="stable")
        low, owner = low[order], owner[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        size = np.diff(np.r_[first, len(low)])
        docs = np.add.reduceat(1 << (owner >> np.uint32(26)).astype(np.int64), first)
        keep, hot = np.repeat(docs > 1, size), np.repeat(docs >= HOT, size)
        key = low.astype(U64) * U64(parts) + U64(group.column("bucket")[0].as_py())
        key, owner, hot = key[keep], owner[keep] & below, hot[keep]
        order = np.argsort(owner, kind="stable")
        key, hot = key[order], hot[order]
        found, cuts = _runs(owner[order])
        pieces = [(key[a:b].tobytes(), key[a:b][hot[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"part": pa.array(found, pa.int32()), "keys": pa.array([k for k, _ in pieces], pa.binary()), "hot": pa.array([h or None for _, h in pieces], pa.binary())})

    dealt = placed.select("doc_id", "text", "row", "part").mapInArrow(deal, "bucket int, low binary, runs binary")
    return materialize(dealt.groupBy("bucket").applyInArrow(meet, "part int, keys binary, hot binary"), "shared-anchors")


def _found(left: pa.Table, keys: np.ndarray, split: _Parts, length: int) -> np.ndarray:
    """The occurrences of these anchors in a partition's documents."""
    found = [np.zeros(0, _record(length))]
    if len(keys):
        for doc, text, row, part in zip(*(left.column(c).to_pylist() for c in ("doc_id", "text", "row", "part"))):
            if doc is None:
                continue
            raw = np.frombuffer(text, np.uint8)
            at, h = anchors(raw, length)
            own = split.key(h)
            hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
            if hit.any():
                found.append(occurrences(doc, row, part, raw, at[hit], h[hit], length))
    return np.concatenate(found)


def _keys(table: pa.Table, column: str) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x), "<u8"))


def _hot_flags(by_part, shared: DataFrame, parts: int, length: int) -> DataFrame:
    """part, flags of the strings over hot anchors: the least id of each string by a grouped minimum."""
    reach, split = length - ANCHOR, _Parts(parts)
    schema = "string binary, doc long, part int, row long, start long"

    def expand(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        release()
        for records in by_anchor(_found(left, _keys(right, "hot"), split, length), SORTED):
            order, _, again = settled(records, length)
            kept = records[order[~again]]
            for at in range(0, len(kept), 2_000):
                piece = kept[at : at + 2_000]
                text = np.ascontiguousarray(np.concatenate([piece["bytes"][:, length : length + reach][:, ::-1], piece["bytes"][:, :length]], axis=1))
                k, j = np.nonzero(reachable(piece, length))
                strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length, axis=1)[k, reach - j])
                values = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1) * length).astype(np.int32)), pa.py_buffer(strings)])
                yield pa.RecordBatch.from_arrays([values, pa.array(piece["doc"][k]), pa.array(piece["part"][k].astype(np.int32)), pa.array(piece["row"][k]), pa.array(piece["pos"][k].astype(np.int64) - j)], ["string", "doc", "part", "row", "start"])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(expand(left, right))
        return pa.Table.from_batches(found) if found else pa.table({"string": pa.array([], pa.binary()), "doc": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "start": pa.array([], pa.int64())})

    def flags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            part, row, start = (batch.column(c).to_numpy() for c in range(3))
            order = np.argsort(part, kind="stable")
            own = np.zeros(len(order), _flag(length))
            own["row"], own["pos"], own["mask"][:, 0] = row[order], start[order], 1
            found, cuts = _runs(part[order])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["part", "flags"])

    rows = by_part.cogroup(shared.where("hot IS NOT NULL").groupBy("part")).applyInArrow(whole, schema)
    least = rows.groupBy("string").agg(F.min("doc").alias("least"))
    return rows.join(least, "string").where("doc > least").select("part", "row", "start").mapInArrow(flags, "part int, flags binary")


def _applied(docs: DataFrame, length: int, id_col: str, text_col: str, carry: list[str], finish: Callable, schema) -> DataFrame:
    """What finish(carried columns, doc ids, texts, kept bytes, n_removed, n_spans) gives, partition by partition."""
    spark = prepare(docs.sparkSession)
    carried = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    source = texts_of(docs, id_col, text_col, *carried)
    total = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    row = F.xxhash64("doc_id", "text").alias("row")
    placed = source.select("doc_id", "text", row, F.pmod(row, F.lit(parts)).cast("int").alias("part"), *(["carried"] if carry else []))
    split = _Parts(parts)
    shared = _shared(placed, parts, length)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        records = _found(left, _keys(right, "keys"), split, length)
        hot = _keys(right, "hot")
        kept, flags = [], []
        for piece in by_anchor(records, SORTED):
            order, _, again = settled(piece, length)
            gone, stay = piece[order[again]], piece[order[~again]]
            flags.append(flags_of(gone, reachable(gone, length), length).tobytes())
            kept.append(stay[~np.isin(split.key(stay["anchor"]), hot)] if len(hot) else stay)
        tasks, parts_, blobs, passed = [], [], [], []
        if kept:
            own = left.column("part")[0].as_py()
            kept = np.concatenate(kept)
            cell = (kept["anchor"] >> U64(7)) % U64(parts)
            order = np.argsort(cell, kind="stable")
            found, cuts = _runs(cell[order])
            blobs = [packed(kept[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
            tasks, parts_, passed = [*found, own], [own] * (len(found) + 1), [b""] * len(found) + [b"".join(flags)]
            blobs.append(b"")
        return pa.table({"task": pa.array(tasks, pa.int32()), "part": pa.array(parts_, pa.int32()), "records": pa.array(blobs, pa.binary()), "flags": pa.array(passed, pa.binary())})

    def compare(group: pa.Table) -> pa.Table:
        release()
        passed = [(p, f) for p, f in zip(group.column("part").to_pylist(), group.column("flags").to_pylist()) if f]
        found = [unpacked(x, _record(length)) for x in group.column("records").to_pylist() if x]
        for records in by_anchor(np.concatenate(found), SORTED) if found else ():
            repeated = repeated_starts(records, length)
            order = np.argsort(records["part"], kind="stable")
            found, cuts = _runs(records["part"][order])
            for p, a, b in zip(found, cuts[:-1], cuts[1:]):
                flags = flags_of(records[order[a:b]], repeated[order[a:b]], length)
                if len(flags):
                    passed.append((p, flags.tobytes()))
        return pa.table({"part": pa.array([p for p, _ in passed], pa.int32()), "flags": pa.array([f for _, f in passed], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        flags = np.frombuffer(b"".join(right.column("flags").to_pylist()), _flag(length))
        flags = flags[np.argsort(flags["row"], kind="stable")]
        ids, texts, kept, spans = left.column("doc_id"), left.column("text").to_pylist(), [], []
        for doc, text, row in zip(ids.to_pylist(), texts, left.column("row").to_pylist()):
            a, b = np.searchsorted(flags["row"], row), np.searchsorted(flags["row"], row, "right")
            if a == b or doc is None:
                kept.append(text)
                spans.append(0)
                continue
            own = flags[a:b]
            k, j = np.nonzero(np.unpackbits(own["mask"], axis=1, bitorder="little"))
            gone = covered(len(text), own["pos"][k].astype(np.int64) - j, length)
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
        return finish(left.column("carried").combine_chunks() if carry else None, ids, texts, kept, [len(t) - len(k) for t, k in zip(texts, kept)], spans)

    by_part = placed.groupBy("part")
    looked = by_part.cogroup(shared.groupBy("part")).applyInArrow(look, "task int, part int, records binary, flags binary")
    flagged = looked.groupBy("task").applyInArrow(compare, "part int, flags binary")
    if shared.where("hot IS NOT NULL").limit(1).count():
        flagged = flagged.unionAll(_hot_flags(by_part, shared, parts, length))
    return by_part.cogroup(flagged.groupBy("part")).applyInArrow(remove, schema)


def dedupe(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans for each row."""

    def finish(_, ids, texts, kept, removed, spans) -> pa.Table:
        return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})

    return _applied(docs, length, id_col, text_col, [], finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def cut(docs: DataFrame, length: int = LENGTH, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs with their columns, repeated bytes cut out of the text and chars_col, if there, following it.

    A character of which only some bytes are left goes; null texts stay null.
    """
    names = docs.columns

    def finish(carried, _, __, kept, removed, ___) -> pa.Table:
        columns = dict(zip(names, carried.flatten()))
        texts = [old if not n else raw.decode("utf-8", "ignore") for old, raw, n in zip(columns[text_col].to_pylist(), kept, removed)]
        columns[text_col] = pa.array(texts, pa.string())
        if chars_col in columns:
            sizes = [old if not n else len(t) for old, t, n in zip(columns[chars_col].to_pylist(), texts, removed)]
            columns[chars_col] = pa.array(sizes, columns[chars_col].type)
        return pa.table(columns)

    return _applied(docs, length, "doc_id", text_col, names, finish, docs.schema)
