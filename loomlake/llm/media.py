"""Operator 5: media columns of progressive JPEG.

Bytes are stored as quantised coefficients, the unit that this format keeps without loss:
each byte is one coefficient of magnitude 128 to 255 in zigzag order, with quantiser 1, in
blocks of a 4:2:0 picture. A file has scans of DC and of two spectral bands of AC with the
lowest bit held back, and refinements that bring this bit. As every coefficient has the same
magnitude class, AC scans use one-symbol Huffman tables and so have fixed places, which both
directions use to work on all blocks at once.

Reading accumulates the spectral-selection and successive-approximation scans of a file into
coefficient arrays (fixed places where the table has one symbol, symbol by symbol
otherwise), inverse-transforms them in numpy, upsamples the chroma and gives the
full-resolution RGB tensor.

Cases: null text has no bytes and is stored as padding alone; equal texts give equal files
and features; a null id stays null; rows with equal ids stay apart; an empty table gives no
rows; other columns, whatever their names, are not read; a long text is one row of one task,
which holds some sixty times its bytes in arrays; a file that is no progressive
three-component JPEG without restart intervals raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, prepare, texts_of

UNIT = 576
PAD = b"\xff"


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag index of an 8 by 8 block."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Zigzag coefficients to the 64 samples of a block, as one matrix."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _basis()
_BYTE = np.arange(256)
_COEFFICIENT = np.where(_BYTE < 128, _BYTE - 255, _BYTE).astype(np.int16)
_MAGNITUDE, _NEGATIVE = np.abs(_COEFFICIENT).astype(np.int64), _COEFFICIENT < 0


def _bits(value: np.ndarray, width: int) -> np.ndarray:
    return ((value[..., None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


#: For each byte: code 0 and the seven bits of its coefficient without the lowest; that bit.
_FIRST = np.where(_NEGATIVE, 127 - (_MAGNITUDE >> 1), _MAGNITUDE >> 1).astype(np.uint8)
_LAST = (_MAGNITUDE & 1).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=64)
def _scan_head(components: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def _scan(components: tuple[int, ...], ss: int, se: int, ah: int, al: int, raw: np.ndarray) -> bytes:
    return _scan_head(components, ss, se, ah, al) + raw.tobytes().replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))


def _table(place: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table that gives each symbol a code of this length."""
    return _segment(0xC4, bytes([place, *[len(symbols) if i == length else 0 for i in range(1, 17)], *symbols]))


_DC_CLASSES = list(range(12))
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_FIRST_TABLES = _table(0x00, _DC_CLASSES, 4) + _table(0x10, [7], 1)
_REFINE_TABLE = _table(0x10, [0], 1)


@lru_cache(maxsize=4096)
def _mcu_order(high: int, wide: int) -> np.ndarray:
    """Row-major luma blocks in the order of their units of two by two."""
    return np.arange(4 * high * wide).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(high * wide, 4)


def write_jpeg(payload: bytes, note: bytes) -> bytes:
    """A progressive JPEG whose coefficients are these bytes (a multiple of 64 of them)."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = max(1, -(-len(blocks) // 6))
    wide = max(int(units**0.5), -(-units // 4000))
    high = -(-units // wide)
    full = np.full((6 * high * wide, 64), 255, np.uint8)
    full[: len(blocks)] = blocks
    n = high * wide
    out = [_HEAD, _segment(0xFE, note), _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _FIRST_TABLES]
    order = np.concatenate([_mcu_order(high, wide), 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]], 1)
    dc = _COEFFICIENT[full[:, 0]].astype(np.int64)
    held = dc >> 1
    diff = np.empty((n, 6), np.int64)
    luma = held[order[:, :4]].ravel()
    diff[:, :4] = np.diff(luma, prepend=0).reshape(n, 4)
    diff[:, 4], diff[:, 5] = np.diff(held[order[:, 4]], prepend=0), np.diff(held[order[:, 5]], prepend=0)
    diff = diff.ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    wide_bits = _bits(size << 12 | value << (12 - size), 16)  # four bits of class, then the class's own bits
    out.append(_scan((1, 2, 3), 0, 0, 0, 1, _packed(wide_bits[np.arange(16) < (4 + size)[:, None]])))
    first = _FIRST[full]
    cuts = ((1, 0, 4 * n), (2, 4 * n, 5 * n), (3, 5 * n, 6 * n))
    for lo, hi in ((1, 5), (6, 63)):
        for c, a, b in cuts:
            out.append(_scan((c,), lo, hi, 0, 1, first[a:b, lo : hi + 1]))
    out.append(_REFINE_TABLE)
    out.append(_scan((1, 2, 3), 0, 0, 1, 0, _packed((dc[order.ravel()] & 1).astype(np.uint8))))
    last = _LAST[full]
    last[:, 0] = 0  # the code of a run of one block without new coefficients
    last = np.packbits(last, axis=1)
    for c, a, b in cuts:
        out.append(_scan((c,), 1, 63, 1, 0, last[a:b]))
    return b"".join([*out, b"\xff\xd9"])


class _Reader:
    """Bit by bit, for scans whose symbols have codes of several lengths."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist() + [1] * 64, 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


@lru_cache(maxsize=256)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _dc_first(raw: np.ndarray, tables: list[dict], order: list[np.ndarray], coefficients: list[np.ndarray], al: int) -> None:
    per_unit = [(c, k) for c, o in enumerate(order) for k in range(o.shape[1])]
    n, bits = len(order[0]), np.unpackbits(raw)
    if all(t == tables[0] for t in tables) and {length for length, _ in tables[0]} == {4}:
        padded = np.concatenate([bits, np.ones(32, np.uint8)]).astype(np.int64)
        classes = np.full(16, 0)
        for (_, code), symbol in tables[0].items():
            classes[code] = symbol
        window = np.lib.stride_tricks.sliding_window_view(padded, 4)[: len(bits) + 1] @ np.array([8, 4, 2, 1])
        size = classes[window]
        follow = (np.arange(len(size)) + 4 + size).tolist()
        places, at = [], 0
        for _ in range(n * len(per_unit)):
            places.append(at)
            at = follow[at]
        places = np.array(places, np.int64)
        size = size[places]
        value = (np.lib.stride_tricks.sliding_window_view(padded, 12)[places + 4] @ (1 << np.arange(11, -1, -1))) >> (12 - size)
        diff = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
    else:
        reader = _Reader(bits)
        diff = np.array([reader.signed(reader.symbol(tables[c])) for _ in range(n) for c, _ in per_unit])
    diff, start = diff.reshape(n, -1), 0
    for c, o in enumerate(order):
        coefficients[c][o.ravel(), 0] = np.cumsum(diff[:, start : start + o.shape[1]].ravel()) << al
        start += o.shape[1]


def _ac_first(raw: np.ndarray, table: dict, own: np.ndarray, ss: int, se: int, al: int) -> None:
    n, band = len(own), se - ss + 1
    if len(table) == 1:
        (length, _), symbol = next(iter(table.items()))
        size = symbol & 15
        if symbol < 16 and 0 < size <= 8:
            if length + size == 8:
                value = raw[: n * band] & np.uint8((1 << size) - 1)
            else:
                fixed = np.unpackbits(raw)[: n * band * (length + size)].reshape(n * band, length + size)[:, length:]
                value = np.packbits(fixed, axis=1)[:, 0] >> np.uint8(8 - size)
            number = np.arange(1 << size, dtype=np.int16)
            number = np.where(number >> (size - 1), number, number - (1 << size) + 1) << al
            own[:, ss : se + 1] = number[value].reshape(n, band)
            return
    reader, skip = _Reader(np.unpackbits(raw)), 0
    for block in own:
        if skip:
            skip -= 1
            continue
        k = ss
        while k <= se:
            run, size = divmod(reader.symbol(table), 16)
            if not size and run < 15:
                skip = (1 << run) + reader.take(run) - 1
                break
            k += run
            if size:
                block[k] = reader.signed(size) << al
            k += 1


def _ac_refine(raw: np.ndarray, table: dict, own: np.ndarray, ss: int, se: int, al: int) -> None:
    n, band = len(own), se - ss + 1
    if len(table) == 1 and next(iter(table.values())) == 0 and own[:, ss : se + 1].all():
        length = next(iter(table))[0]
        fixed = np.unpackbits(raw)[: n * (length + band)].reshape(n, length + band)[:, length:].astype(np.int16)
        view = own[:, ss : se + 1]
        view += (np.sign(view) * fixed) << al
        return
    reader, skip = _Reader(np.unpackbits(raw)), 0

    def correct(block: np.ndarray, k: int) -> None:
        if reader.take(1):
            block[k] += (1 << al) if block[k] > 0 else -(1 << al)

    for block in own:
        k = ss
        if not skip:
            while k <= se:
                run, size = divmod(reader.symbol(table), 16)
                if not size and run < 15:
                    skip = (1 << run) + reader.take(run)
                    break
                value = ((1 << al) if reader.take(1) else -(1 << al)) if size else 0
                while k <= se:
                    if block[k]:
                        correct(block, k)
                    elif run == 0:
                        break
                    else:
                        run -= 1
                    k += 1
                if value:
                    block[k] = value
                k += 1
        if skip:
            while k <= se:
                if block[k]:
                    correct(block, k)
                k += 1
            skip -= 1


class Picture:
    """A read file: coefficients of each component (blocks by 64, zigzag), and its note."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at, tables, self.note, self.coefficients = 2, {}, b"", []
        quantisers: dict[int, np.ndarray] = {}
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.note = body
            elif marker == 0xDB:
                quantisers[body[0]] = np.frombuffer(body[1:65], np.uint8).astype(np.int16)
            elif marker == 0xC4:
                while body:
                    count = sum(body[1:17])
                    tables[body[0]] = _codes(body[1:17], body[17 : 17 + count])
                    body = body[17 + count :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if n != 3 or [body[7 + 3 * i] for i in range(3)] != [0x22, 0x11, 0x11] or self.height % 16 or self.width % 16:
                    raise ValueError("not a 4:2:0 picture of whole units")
                self.names = [body[6 + 3 * i] for i in range(3)]
                self.quantisers = [quantisers[body[8 + 3 * i]] for i in range(3)]
                high, wide = self.height // 16, self.width // 16
                units = np.arange(high * wide)[:, None]
                self.order = [_mcu_order(high, wide), units, units]
                self.coefficients = [np.zeros((k * high * wide, 64), np.int16) for k in (4, 1, 1)]
            elif marker == 0xDA:
                end = data.index(b"\xff", at)
                while data[end + 1] == 0:
                    end = data.index(b"\xff", end + 2)
                raw = np.frombuffer(data[at:end].replace(b"\xff\x00", b"\xff"), np.uint8)
                at = end
                chosen = [(self.names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                ss, se, high_low = body[-3:]
                ah, al = divmod(high_low, 16)
                own = [self.coefficients[c] for c, _ in chosen]
                if ss == 0:
                    order = [self.order[c] for c, _ in chosen] if len(chosen) > 1 else [np.arange(len(own[0]))[:, None]]
                    if ah == 0:
                        _dc_first(raw, [tables[t >> 4] for _, t in chosen], order, own, al)
                    else:
                        each = np.unpackbits(raw)[: sum(o.size for o in order)].reshape(len(order[0]), -1).astype(np.int16)
                        start = 0
                        for o, coefficients in zip(order, own):
                            coefficients[o.ravel(), 0] |= each[:, start : start + o.shape[1]].ravel() << al
                            start += o.shape[1]
                else:
                    (_ac_refine if ah else _ac_first)(raw, tables[0x10 | chosen[0][1] & 15], own[0], ss, se, al)
            elif marker in (0xDD, 0xC0, 0xC1):
                raise ValueError("not a progressive file without restart intervals")

    def payload(self) -> bytes:
        """The bytes that write_jpeg() was given, by the coefficients, with the filling blocks after them."""
        flat = np.concatenate(self.coefficients)
        return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()

    def rgb(self) -> np.ndarray:
        """The full-resolution picture, height by width by 3."""
        planes = []
        for coefficients, quantiser, scale in zip(self.coefficients, self.quantisers, (1, 2, 2)):
            high, wide = self.height // 8 // scale, self.width // 8 // scale
            samples = (coefficients * quantiser).astype(np.float32) @ INVERSE
            plane = samples.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)
            planes.append(plane.repeat(scale, 0).repeat(scale, 1) if scale > 1 else plane)
        y, cb, cr = planes[0] + np.float32(128), planes[1], planes[2]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
            out[:, :, k] = plane
        return out


def features(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3)
    total = flat.sum(0, dtype=np.int64)
    square = np.array([np.dot(c, c) for c in flat.T.astype(np.float32)], np.float64)
    mean = total / len(flat)
    deviation = np.sqrt(np.maximum(square / len(flat) - mean**2, 0))
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(f"{m:.3f}" for m in mean) + ";" + ",".join(f"{d:.1f}" for d in deviation) + f";{zlib.crc32(rgb):08x}"


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT if text else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text as a progressive JPEG, with the sizes of text and payload in its note."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            media = []
            for text in batch.column(1).to_pylist():
                payload = padded(text)
                media.append(write_jpeg(payload, b"%d %d" % (len(text), len(payload))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return texts_of(docs).mapInArrow(run, "doc_id long, media binary")


def write(docs: DataFrame, path: str) -> DataFrame:
    """The files of store() written as a table at path, and read back from there."""
    store(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("doc_id long, media binary").parquet(path)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tensor binary"


def read(media: DataFrame, tensors: bool = True) -> DataFrame:
    """What a stored file holds, and its RGB tensor (height by width by 3 unsigned bytes; null without tensors)."""
    prepare(media.sparkSession)
    names = [c.split()[0] for c in READ.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in READ.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            out: list[list] = [[] for _ in names]
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                picture = Picture(data)
                n_bytes, n_payload = map(int, picture.note.split())
                payload, rgb = picture.payload()[:n_payload], picture.rgb()
                values = [doc, n_bytes, n_payload, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(rgb), *rgb.shape[:2], rgb.tobytes() if tensors else None]
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return media.mapInArrow(run, READ)


def write_tensors(media: DataFrame, path: str) -> DataFrame:
    """doc_id, height, width, tensor of stored files written as a table at path, and read back from there."""
    read(media).select("doc_id", "height", "width", "tensor").write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema("doc_id long, height int, width int, tensor binary").parquet(path)
