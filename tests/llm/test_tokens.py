import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers

from loomlake.llm import bpe, sharding, tokenstore

from .conftest import ODD

VOCABULARY = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
DEFINITION = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library(peer):
    codec, rng = bpe.Codec(VOCABULARY, P.PATTERN), random.Random(3)
    texts = ["".join(rng.choice("abcdeéß  \n'sti12日本!?😀\t") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["a" * 4000, "ab" * 500, "!" * 333, "thethe" * 40, " " * 100]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_encode_table(odd_docs, no_docs, peer):
    got = bpe.decode(bpe.encode(odd_docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()
    expected = sorted((str(i), tuple(peer.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.text)) for r in got) == expected
    assert bpe.encode(no_docs, VOCABULARY, P.PATTERN).count() == 0


def test_segment_tree_leftmost_minimum():
    rng = random.Random(0)
    values = [rng.randint(0, 5) for _ in range(37)]
    tree = bpe.SegmentTree(values)
    for _ in range(200):
        i, v = rng.randrange(37), rng.randint(0, 9)
        values[i] = v
        tree.put(i, v)
        assert tree.least() == (min(values), values.index(min(values)))


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, 7, back=True).tolist() == list(range(n))


def test_sharding(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, shards=4).collect()
    assert len(rows) == len(ODD)
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(str(r.doc_id), r.size, r.text_crc32) for r in rows} == {(str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD}
    assert [r.row_number for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))] == list(range(len(ODD)))
    assert sharding.shard(no_docs).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)).view(np.uint64)
    index = tokenstore.PerfectHash.from_bytes(tokenstore.PerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_token_store(spark, make_docs, no_docs):
    rows = [*ODD, (12, "again twelve")]
    path = tokenstore.new_store(spark)
    tokenstore.write(make_docs(rows, extra=("part", "keys")), path, DEFINITION)
    own = tokenizers.Tokenizer.from_str(DEFINITION)
    expected = {(str(i), zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows}
    got = sorted(tokenstore.read_all(spark, path).collect(), key=lambda r: r.start)
    assert {(str(r.doc_id), r.ids_crc32) for r in got} == expected
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    keys = spark.createDataFrame([(10,), (12,), (None,), (999,), (-4,), (10,)], "doc_id long")
    found = tokenstore.lookup(spark, path, keys).collect()
    assert sorted(str(r.doc_id) for r in found) == ["10", "12", "12", "None"]
    plain = {str(i): own.encode(t or "", add_special_tokens=False).ids for i, t in ODD}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*plain[str(r.doc_id)], 0] for r in found if r.doc_id != 12)
    empty = tokenstore.new_store(spark)
    tokenstore.write(no_docs, empty, DEFINITION)
    assert tokenstore.read_all(spark, empty).count() == 0


def test_token_store_has_added_tokens_as_the_library(spark, make_docs):
    end = "<|endoftext|>"
    rows = [(1, f"in{end}side a word"), (2, f"hello {end} there"), (3, f"{end}at both ends{end}"), (4, end), (5, f"a {end}{end} b"), (6, "side a word hello"), (7, f" {end} hello"), (8, f"side a {end[:-1]}")]
    path = tokenstore.new_store(spark)
    tokenstore.write(make_docs(rows), path, DEFINITION)
    own = tokenizers.Tokenizer.from_str(DEFINITION)
    ids = {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert ids[2] == [31373, 220, 50256, 612, 0]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read_all(spark, path).collect())
    starts = np.cumsum([0, *map(len, ids.values())])[:-1].tolist()
    assert got == [(i, s, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for s, (i, v) in zip(starts, ids.items())]


def test_query_has_added_tokens_as_the_library(spark, make_docs, tmp_path):
    from loomlake.llm import queries

    make_docs([(1, "hello <|endoftext|> there")]).write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.op10_token_store(spark, str(tmp_path)).collect()[0]
    assert (row.n_tokens, row.ids_crc32) == (5, zlib.crc32(np.array([31373, 220, 50256, 612, 0], "<u4").tobytes()))


def test_full_shards_and_one_hot_id(spark, make_docs, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_BYTES", 300)
    monkeypatch.setattr(tokenstore, "ASKED", 3)
    ids = [7] * 60 + [None] * 40 + [-(1 << 62), 1 << 62] + list(range(100, 140))
    rows = [(i, f"text number {k} " + "word " * (k % 9)) for k, i in enumerate(ids)]
    path = tokenstore.new_store(spark)
    tokenstore.write(make_docs(rows), path, DEFINITION)
    assert spark.read.parquet(path).where("first_id = 7 AND last_id = 7").count() > 1
    assert spark.read.parquet(path).count() > 6
    got = sorted(tokenstore.read_all(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    asked = spark.createDataFrame([(i,) for i in [7, None, 1 << 62, -(1 << 62), 99, 140, *range(100, 140)]], "doc_id long")
    found = [r.doc_id for r in tokenstore.lookup(spark, path, asked).collect()]
    assert sorted(map(str, found)) == sorted(map(str, ids))


def test_round_trip_in_one_pass(odd_docs):
    both = [sorted((str(r.doc_id), bytes(r.ids), bytes(r.text)) for r in found.collect()) for found in (bpe.decode(bpe.encode(odd_docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN), bpe.round_trip(odd_docs, VOCABULARY, P.PATTERN))]
    assert both[0] == both[1] and len(both[0]) == len(ODD)
