import hashlib
import random
import zlib

import numpy as np
import pytest

from loomlake.llm import media

from .conftest import ODD


def payloads():
    rng = random.Random(6)
    return [media.padded(rng.randbytes(n)) for n in (0, 1, 575, 576, 577, 5000, 40_000)] + [media.padded(bytes(range(256)) * 9), media.padded("héllo wörld ".encode() * 300)]


@pytest.mark.parametrize("payload", payloads(), ids=len)
def test_round_trip(payload):
    data = media.write_jpeg(payload, b"note")
    picture = media.Picture(data)
    assert picture.note == b"note" and picture.payload()[: len(payload)] == payload
    assert data == media.write_jpeg(payload, b"note")


def test_symbol_by_symbol_reading_agrees(monkeypatch):
    data = media.write_jpeg(media.padded(random.Random(7).randbytes(3000)), b"")
    fast = media.Picture(data)
    plain = media._codes

    def with_unused_code(counts, symbols):
        table = dict(plain(counts, symbols))
        return table | ({(2, 3): 0xF0} if len(table) == 1 else {(5, 24): 11})

    monkeypatch.setattr(media, "_codes", with_unused_code)
    slow = media.Picture(data)
    for a, b in zip(fast.coefficients, slow.coefficients):
        assert (a == b).all()


def test_inverse_transform_against_definition():
    rng = np.random.default_rng(0)
    zig = rng.integers(-200, 200, 64).astype(np.float32)
    block = np.zeros((8, 8))
    for k, place in enumerate(media.ZIGZAG):
        block[place // 8, place % 8] = zig[k]
    scale = lambda k: np.sqrt(0.125) if k == 0 else 0.5
    want = [[sum(scale(u) * scale(v) * block[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert np.allclose((zig @ media.INVERSE).reshape(8, 8), want, atol=1e-2)
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_colours():
    picture = media.Picture(media.write_jpeg(media.padded(b""), b""))
    for c in picture.coefficients:
        c[:] = 0
    assert (picture.rgb() == 128).all()
    picture.coefficients[2][:, 0] = 400  # red difference of 50
    assert picture.rgb()[0, 0].tolist() == [198, 92, 128]


def test_table(odd_docs, no_docs):
    stored = media.store(odd_docs)
    rows = media.read(stored).collect()
    assert len(rows) == len(ODD)
    texts = {str(i): (t or "").encode() for i, t in ODD}
    for r in rows:
        own = texts[str(r.doc_id)]
        payload = own + b"\xff" * (-len(own) % 576 if own else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(r.tensor) == r.height * r.width * 3
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in rows if r.doc_id in (5, 6)}
    assert len(same) == 1
    assert media.read(media.store(no_docs), tensors=False).count() == 0
    with pytest.raises(ValueError):
        media.Picture(b"no picture")


def test_written_tables(spark, make_docs, tmp_path):
    rows = [(1, "kept as a picture"), (None, None), (1, "ü" * 700)]
    stored = media.write(make_docs(rows, extra=("media", "tensor")), str(tmp_path / "media"))
    found = media.write_tensors(stored, str(tmp_path / "tensors")).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "None"]
    wanted = {(media.Picture(media.write_jpeg(media.padded((t or "").encode()), b"")).rgb()).tobytes() for _, t in rows}
    assert {bytes(r.tensor) for r in found} == wanted and all(len(r.tensor) == 3 * r.height * r.width for r in found)
