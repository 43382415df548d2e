"""Every registered query without SQL, as registered, against the contract that it answers to."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from loomlake.llm import media, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    """Some rows of the given table, and odd ones with null, repeated and tied columns."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return rows + [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, rows[0][1], None), (10**6 + 3, "12 !? <|endoftext|>", "en")]


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    folder = tmp_path_factory.mktemp("contracts")
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def answers(spark, tables, name, *kinds):
    frame = queries.queries()[name](spark, tables)
    assert [(c, k) for c, k in frame.dtypes][: len(kinds)] == list(kinds)
    rows = {r.doc_id: r for r in frame.collect()}
    return rows


def crc5(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op1(spark, tables, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())}
    import tiktoken

    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = answers(spark, tables, "op1_bpe", ("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
    for i, t, _ in texts:
        ids = peer.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert len(got) == len(texts)


def test_op2(spark, tables, texts):
    got = answers(spark, tables, "op2_lm", ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"))
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t, _ in texts}
    counts = Counter(w for i, _, _ in texts if crc5(i) != 1 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc5(i) == 1, len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4(spark, tables, texts):
    got = answers(spark, tables, "op4_toxicity", ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int"))
    assert len(got) == len(texts)
    for i, _, _ in texts:
        assert got[i].held_out == (crc5(i) == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    assert got[10**6 + 2].score == got[texts[0][0]].score
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    right = [got[i].predicted == y for i, y in toxic.items() if y is not None and i in got]
    assert sum(right) >= 0.9 * len(right)


def test_op5(spark, tables, texts):
    got = answers(spark, tables, "op5_media", ("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"))
    for i, t, _ in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        file = media.write_jpeg(payload, b"%d %d" % (len(raw), len(payload)))
        assert tuple(got[i])[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
        assert got[i].feature == media.features(media.Picture(file).rgb())


def test_op7(spark, tables, texts):
    got = answers(spark, tables, "op7_langid", ("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"))
    learned = {lang for i, _, lang in texts if lang is not None and crc5(i) != 0}
    for i, t, _ in texts:
        r = got[i]
        assert r.held_out == (crc5(i) == 0) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in t or "") else r.lang_pred == "und"
    held = [(got[i].lang_pred, lang) for i, t, lang in texts if crc5(i) == 0 and lang is not None and any(c.isalpha() for c in t or "")]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0


def test_op9(spark, tables, texts):
    got = answers(spark, tables, "op9_sharding", ("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int"))
    assert len(got) == len(texts) and {r.law for r in got.values()} == {"rows"} and {r.grown_shard for r in got.values()} == {None}
    for i, t, _ in texts:
        assert (got[i].size, got[i].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    held = [sorted(r.slot for r in got.values() if r.shard == s) for s in range(16)]
    assert all(own == list(range(len(own))) for own in held)
    assert sum(map(len, held)) == len(texts) and max(map(len, held)) - min(map(len, held)) <= 1


def test_op10(spark, tables, texts):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = answers(spark, tables, "op10_token_store", ("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"))
    start = 0
    for i, t, _ in sorted(texts, key=lambda r: r[0]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
