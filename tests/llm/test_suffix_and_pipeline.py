import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomlake.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity

from .conftest import ODD
from .test_joins import brute_components


def brute_removal(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            key = raw[p : p + length]
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "ε", "zeta", "eta", "theta"]
    passages = [" ".join(rng.choices(words, k=rng.choice([8, 12, 40]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.choice([0, 5, 80]))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < 0.3:
            parts.insert(0, rng.choice(passages)[rng.randrange(20) :])
        rows.append((i, rng.choice(["", " ", "\0"]).join(parts)))
    return [*rows, (n, "ab" * 300), (n + 1, "ab" * 40), (n + 2, "x" * 49), (n + 3, "x" * 50), (n + 4, "x" * 51), *((n + 5 + k, passages[0]) for k in range(30))]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_against_brute_force(make_docs, seed):
    rows = repetitive(seed, 150) + [(i + 9000, t) for i, t in ODD if i is not None]
    got = suffix_dedup.dedupe(make_docs(rows, extra=("part", "row", "kept"))).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute_removal(rows)


def test_dedupe_nulls_and_repeats(make_docs, no_docs):
    text = "the same long passage of well over fifty bytes stands here again and again"
    rows = [(None, text), (3, text), (3, text), (4, text), (5, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedupe(make_docs(rows)).collect())
    assert got == sorted([("None", 0), ("3", 0), ("3", 0), ("4", len(text)), ("5", 0)])
    assert suffix_dedup.dedupe(no_docs).count() == 0


def test_cut_keeps_columns(make_docs):
    shared = "é" * 30
    rows = [(1, shared + "one"), (2, "two" + shared), (3, None), (4, "� stays")]
    frame = make_docs(rows, extra=("carried", "n_removed"))
    got = suffix_dedup.cut(frame)
    assert got.schema == frame.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (rows[0][1], 33), 2: ("two", 3), 3: (None, None), 4: ("� stays", 7)}


@pytest.mark.parametrize("width, shared", [(50, 45), (200, 150)])
def test_deep_shallow_order_and_prefixes(width, shared):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, (400, width)).astype(np.uint8)
    data[100:200] = data[:100]
    data[200:260, :shared] = data[0, :shared]
    group = rng.integers(0, 5, 400)
    order, common = suffix_dedup.deep_shallow(group, data)
    keys = [(int(group[i]), data[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 400):
        a, b = data[order[k]], data[order[k - 1]]
        assert common[k] == (-1 if group[order[k]] != group[order[k - 1]] else int(np.argmax(a != b)) if (a != b).any() else width)


def test_tries_order_what_differs_late(monkeypatch):
    """All strings agree for 120 bytes, so no part of the order comes from quicksort."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, (300, 160)).astype(np.uint8)
    data[:, :120] = data[0, :120]
    data[50:80, :150] = data[50, :150]
    seen = []
    tries = suffix_dedup.blind_tries
    monkeypatch.setattr(suffix_dedup, "blind_tries", lambda words, order, starts, sizes, *a: (seen.append(sizes.tolist()), tries(words, order, starts, sizes, *a)))
    order, common = suffix_dedup.deep_shallow(np.zeros(300, np.int64), data)
    assert seen == [[300]]
    strings = [d.tobytes() for d in data]
    assert [strings[i] for i in order] == sorted(strings)
    assert all(common[1:] >= 120)


def test_longer_strings_against_brute_force(make_docs):
    rows = repetitive(5, 60)
    rows += [(500 + k, "start %d " % k + "the middle of this passage is long enough to matter here " * 3 + "end %d" % (k % 3)) for k in range(12)]
    got = suffix_dedup.dedupe(make_docs(rows), length=130).withColumn("sha", F.sha2("kept", 256)).collect()
    expected = brute_removal(rows, 130)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == expected
    assert sum(n for _, n, _, _ in expected.values()) > 1000


def test_hot_anchors_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    calls = []
    grouped = suffix_dedup._hot_flags
    monkeypatch.setattr(suffix_dedup, "_hot_flags", lambda *a: (calls.append(1), grouped(*a))[1])
    rows = repetitive(6, 120)
    got = suffix_dedup.dedupe(make_docs(rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute_removal(rows) and calls


def test_small_pieces_against_brute_force(make_docs, monkeypatch):
    for name in ("SORTED", "HELD", "PARTITION_BYTES"):
        monkeypatch.setattr(suffix_dedup, name, 40)
    rows = repetitive(7, 80)
    got = suffix_dedup.dedupe(make_docs(rows, extra=("part", "bytes"))).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute_removal(rows)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(900)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([12, 40, 120])))) for i in range(160)]
    marks = []
    for i, t in docs[:]:
        if i % 4 == 0:
            docs[i] = (i, t + " nitwit you dimwit")
        marks.append((i, int(i % 4 == 0)))
    item = " ".join(words[100:120])
    docs += [(200, docs[1][1]), (201, docs[2][1] + " more"), (202, "lead " + item + " tail"), (203, docs[3][1][:90] + " and then something else " + " ".join(words[:30])), (204, None), (205, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = toxicity.train(frame, toxicity.training_labels(spark.read.parquet(str(tmp_path / "labels.parquet"))))
    toxic = {r.doc_id for r in toxicity.score(frame, model).collect() if r.predicted}
    assert toxic >= {i for i in range(0, 160, 4)} and len(toxic) < 60
    left = [(i, t) for i, t in docs if i not in toxic]
    groups = brute_components(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    gone = brute_removal(left)
    texts = {r.doc_id: r.text for r in suffix_dedup.cut(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in left], schema)).collect()}
    assert all(hashlib.sha256((texts[i] or "").encode()).hexdigest() == gone[i][3] for i in texts)
    own = decontaminate.word_shingles(item.encode())
    left = {i: t or "" for i, t in texts.items() if len(own & decontaminate.word_shingles((t or "").encode())) < 0.75 * len(own)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and 202 not in got and 200 not in got and {204, 205} & set(got)
    assert all(r.decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest() for i, r in got.items())
    assert ngram_join.representatives(frame).columns == frame.columns and bpe.SHORT == 32


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, ties, clashing column names, and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, part int, text_ string"
    line = "the same words stand in every one of these rows and so they are near copies of each other, all of them"
    texts = [(1, line), (1, line), (2, line + " too"), (None, line), (None, None), (3, None), (4, ""), (5, "long " * 30_000), (6, "   "), (7, "short")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in texts], schema)
    for name, rows in (("full", frame), ("none", frame.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").limit(2 if name == "full" else 0).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "a test item that no document holds")], "item_id long, text string").limit(1 if name == "full" else 0).write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            docs.write.parquet(f"{folder}/{step}")
            docs = spark.read.parquet(f"{folder}/{step}")
            assert docs.columns == frame.columns
        got = corpus_pipeline.encode(spark, docs, folder).collect()
        if name == "none":
            assert not got
            continue
        # One of the near copies stays, rows with a null id stay as they are, and so do all others.
        assert sorted(str(r.doc_id) for r in got) == sorted(["1", "None", "None", "3", "4", "5", "6", "7"])
        decoded = {str(r.doc_id): r.decoded_sha256 for r in got if r.doc_id is not None}
        assert decoded["5"] == hashlib.sha256(b"long " * 30_000).hexdigest() and decoded["1"] == hashlib.sha256(line.encode()).hexdigest()
