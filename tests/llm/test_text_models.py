import random

import numpy as np
import pytest

from loomlake.llm import decontaminate, langid, toxicity

from .conftest import ODD


def brute_contained(docs, items, threshold=0.75):
    shingles = {i: decontaminate.word_shingles((t or "").encode()) for i, t in items}
    out = []
    for d, t in docs:
        own = decontaminate.word_shingles((t or "").encode())
        out += [(str(d), str(i), len(s), len(s & own)) for i, s in shingles.items() if s and len(s & own) >= threshold * len(s)]
    return sorted(out)


def test_containment_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 14, 40, 120])))) for i in range(60)] + [(60, ""), (61, None), (62, "x y"), (None, "alpha beta gamma delta epsilon zeta")]
    docs = list(ODD)
    for n in range(120):
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if item:
                item[rng.randrange(len(item))] = "Edit"
        docs.append((100 + n, " ".join([*rng.choices(words, k=rng.choice([0, 3, 500])), *item, *rng.choices(words, k=rng.choice([0, 7]))])))
    docs.append((900, "X y"))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained(make_docs(docs, extra=("item_id", "n_shared")), frame).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shingles, r.n_shared) for r in got) == brute_contained(docs, items)


def test_containment_in_blocks(spark, make_docs, no_docs, monkeypatch):
    items = [(i, f"one two three four five six {i}") for i in range(40)]
    docs = make_docs([(1, "zero one two three four five six 7 and more"), (2, "nothing here")])
    frame = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contained(docs, frame).count()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert decontaminate.contained(docs, frame).count() == whole > 0
    assert decontaminate.contained(no_docs, frame).count() == 0
    assert decontaminate.contained(docs, frame.limit(0)).count() == 0


def test_language_mixture(spark, make_docs, no_docs):
    rng = random.Random(1)
    vocabulary = {"aa": ["kana", "mana", "tana", "lana"], "bb": ["ost", "wurst", "first", "durst"]}
    rows = [(i, " ".join(rng.choices(vocabulary[g], k=40)), g) for i in range(60) for g in ("aa", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model[0] == ["aa", "bb"]
    mixed = " ".join(rng.choices(vocabulary["aa"], k=60) + rng.choices(vocabulary["bb"], k=30))
    asked = make_docs([(1, "mana KANA lana"), (2, "wurst ost"), (3, mixed), (4, None), (5, "12 ,. 34"), (6, ""), (None, "ost")], extra=("langs", "lang_pred"))
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[None].lang_pred) == ("aa", "bb", "bb")
    assert got[3].lang_pred == "aa" and got[3].langs == ["aa", "bb"] and abs(got[3].score - 2 / 3) < 0.1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (4, 5, 6))
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(asked, nothing).collect()} == {"und"}


def brute_kernel(s, t):
    from itertools import combinations

    def weights(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            u = tuple(toxicity._ALPHABET[[x[i], x[j], x[k]]])
            out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_against_enumeration():
    strings = [b"idiot", b"i.d.i.o.t", b"idiiot", b"banana", b"aaaa", b"the"]
    found = toxicity.Subsequences.of(strings)
    got = found.of_others(strings)
    assert np.allclose(got, found.kernel(), atol=1e-5)
    assert np.allclose(toxicity.weigh(strings, found.columns[found.place, 1]), got[:, 1], atol=1e-5)
    for i, s in enumerate(strings):
        for j, t in enumerate(strings):
            assert got[i, j] == pytest.approx(brute_kernel(s, t), abs=1e-5)


def test_toxicity_learns_gapped_insults(spark, make_docs, no_docs):
    rng = random.Random(2)
    clean = ["garden", "window", "river", "bread", "table", "music", "paper", "stone", "light", "water"]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(clean, k=30)
        toxic = i % 4 == 0
        if toxic:
            words[3:5] = rng.sample(["blockhead", "nitwit", "dimwit"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(make_docs(rows), marks)
    asked = make_docs([(1, "river bread nitwit stone dimwit"), (2, "river bread stone"), (3, "water n.i.t.w.i.t and b l o c k h e a d here"), (4, None), (5, ""), (6, "block*head nit*wit")], extra=("score", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5, 6)] == [1, 0, 1, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train(make_docs(rows), marks.limit(0)) is None
    assert {r.score for r in toxicity.score(asked, None).collect()} == {0.0}
    # The decision function is a combination of kernels to the landmarks, found again here from its values there.
    kernels = np.array([[brute_kernel(a, b) for b in model.landmarks] for a in model.landmarks])
    share = np.linalg.lstsq(kernels, toxicity.weigh(model.landmarks, model.weights).astype(float), rcond=None)[0]
    for string in (b"nitwit", b"n.i.t.w.i.t", b"garden", b"blockhead", b"whatever", b"x" * 20):
        brute = sum(c * brute_kernel(string, m) for c, m in zip(share, model.landmarks))
        assert toxicity.weigh([string], model.weights)[0] == pytest.approx(brute, abs=0.02)


def test_toxicity_from_sentences_with_repeats(spark, make_docs, monkeypatch):
    """Only one sentence of a toxic document is toxic, a third of the rows have one id, and few documents are sampled."""
    rng = random.Random(4)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 250)
    clean = ["garden", "window", "river", "bread", "table", "music", "paper", "stone", "light", "water", "morning", "letter"]
    rows, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choices(clean, k=8)) for _ in range(6)]
        if i % 3 == 0:
            parts[rng.randrange(6)] = f"you {rng.choice(['numbskull', 'halfwit', 'numb-skull'])} again"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1, rows[1][1])] * 200
    model = toxicity.train(make_docs(rows, extra=("weight", "sentences")), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(make_docs(rows), model).collect()
    assert len(got) == len(rows) and sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) >= 0.98 * len(rows)
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_long_token_is_read_whole():
    token = b"x" * 40 + b"nitwit" + b"y" * 40
    assert any(b"nitwit" in p for p in toxicity.pieces(token))
    assert np.isfinite(toxicity.weigh(toxicity.pieces(token), np.ones(1 << 18, np.float32))).all()
