import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import lm

from .conftest import ODD


def small_vocabulary():
    counts = np.array([40, *range(90, 0, -1)])
    words = [b"", *(b"w%d" % i for i in range(90))]
    return lm.Vocabulary(words, counts, int(counts.sum()) + 17, len(words) + 9)


def loss(network, x, y, keep, h):
    states, _, _ = network.run(x, keep, h)
    live = np.flatnonzero(y.ravel() >= 0)
    return -network.targets(states.reshape(-1, lm.STATE + 1)[live], y.ravel()[live], False)[0].mean()


def test_gradient_against_differences(monkeypatch):
    monkeypatch.setattr(lm, "FLOAT", np.float64)
    monkeypatch.setattr(lm, "HEAD", 70)
    v, rng = small_vocabulary(), np.random.default_rng(0)
    network = lm.Network(v)
    network.flat += rng.normal(0, 0.2, len(network.flat))
    x, y = rng.integers(0, v.head + 2, (5, 4)), rng.integers(0, v.head + 1, (5, 4))
    y[3:, 2] = -1
    keep, h = np.ones((5, 4)), rng.normal(0, 0.3, (lm.STATE, 4))
    keep[2, 1] = 0
    grad, last = network.gradient(x, y, keep, h)
    assert last.shape == h.shape
    for at in rng.integers(0, len(network.flat), 60).tolist() + np.argsort(-np.abs(grad))[:40].tolist():
        old = network.flat[at]
        network.flat[at] = old + 1e-5
        up = loss(network, x, y, keep, h)
        network.flat[at] = old - 1e-5
        down = loss(network, x, y, keep, h)
        network.flat[at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_distribution_sums_to_one(monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 70)
    v, rng = small_vocabulary(), np.random.default_rng(1)
    network = lm.Network(v)
    network.flat += rng.normal(0, 0.1, len(network.flat)).astype(np.float32)
    h = np.repeat(np.r_[rng.normal(0, 0.5, lm.STATE), 1][None], v.head + 1, 0).astype(np.float32)
    out, _ = network.targets(h, np.arange(v.head + 1), False)
    assert np.exp(out).sum() == pytest.approx(1, abs=1e-3)
    known = (v.counts[v.head :] + 0.5).sum() + (v.total - v.counts.sum()) + 0.5 * (v.distinct - len(v.words)) + 0.5
    assert known == pytest.approx(v.rest_mass)


def test_score_does_not_depend_on_lanes(monkeypatch):
    v, rng = small_vocabulary(), np.random.default_rng(2)
    network = lm.Network(v)
    network.flat += rng.normal(0, 0.2, len(network.flat)).astype(np.float32)
    texts = [rng.integers(0, v.head + 1, n) for n in (1, 2, 70, 33, 5, 16, 17, 200)]
    together = lm.scored(texts, network)
    monkeypatch.setattr(lm, "LANES", 3)
    assert np.allclose(lm.scored(texts, network), together, rtol=1e-4)
    assert np.allclose([lm.scored([t], network)[0] for t in texts], together, rtol=1e-4)


@pytest.mark.parametrize("large", [60.0, 0.0])
def test_score_against_one_token_at_a_time(monkeypatch, large):
    """The model written out for one text, with loops and no windows, lanes or shared sums."""
    monkeypatch.setattr(lm, "HEAD", 70)
    monkeypatch.setattr(lm, "LARGE", large)
    v, rng = small_vocabulary(), np.random.default_rng(7)
    network = lm.Network(v)
    network.flat += rng.normal(0, 0.3, len(network.flat)).astype(np.float32)
    w_in, w_rec, w_class, w_word = (p.astype(np.float64) for p in network.parts)
    n, squash = lm.STATE, lambda z: z / (1 + np.abs(z))
    texts = [rng.integers(0, v.head + 1, k) for k in (1, 3, 40, 150)]
    for text, got in zip(texts, lm.scored(texts, network)):
        h, before, total = np.zeros(n), v.begin, 0.0
        for token in text.tolist():
            g, r = w_in[before], h @ w_rec
            reset, update = (0.5 + 0.5 * squash(g[k : k + n] + r[k : k + n]) for k in (0, n))
            h = h + update * (squash(g[2 * n :] + reset * r[2 * n :]) - h)
            by_class = h @ w_class[:-1] + w_class[-1]
            k = v.n_classes - 1 if token == v.rest else token // v.size
            total += by_class[k] - math.log(np.exp(by_class).sum())
            if token != v.rest:
                by_word = h @ w_word[k][:-1] + w_word[k][-1]
                total += by_word[token - k * v.size] - math.log(np.exp(by_word).sum())
            before = token
        assert got == pytest.approx(total, rel=1e-4)


def test_fit_does_not_depend_on_the_layout(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "COPY", 4000)
    rows = corpus()
    docs = make_docs(rows)
    fitted = [lm.fit(d)[2] for d in (docs, docs.repartition(7, "text").sortWithinPartitions("text"))]
    assert np.array_equal(*fitted) and np.abs(fitted[0]).max() > 0


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(240):
        side = "ab"[i % 2]
        rows.append((i, " ".join(f"{side}{min(int(rng.expovariate(0.25)), 60)}" for _ in range(60))))
    return rows


def test_base_score_and_gain(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 40)  # most words meet their counts in the join
    rows = corpus() + [(i + 1000 if i is not None else None, t) for i, t in ODD]
    docs = make_docs(rows, extra=("n", "score", "row"))
    got = lm.score(docs, *lm.fit(lm.training_rows(docs))).collect()
    counts, total = Counter(), 0
    tokens = {str(i): [*(t or "").encode().lower().split(), b""] for i, t in rows}
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[str(i)])
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[str(r.doc_id)]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 2 * len(held)


def test_nothing_to_learn_from(make_docs, no_docs):
    docs = make_docs([(1, "some words"), (2, None)])
    got = {r.doc_id: r for r in lm.score(docs, *lm.fit(no_docs)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (3, 0, 0) and abs(got[1].base_score) < 1e-9
    assert got[2].n_tokens == 1 and math.isfinite(got[1].score)
    assert lm.score(no_docs, *lm.fit(docs)).count() == 0


def test_head_follows_the_vocabulary():
    assert lm.STATE >= 12
    for n in (2000, 20000):
        counts = np.array([5, *(1_000_000 // (k + 100) for k in range(n))])
        v = lm.Vocabulary([b"", *(b"w%d" % k for k in range(n))], counts, int(counts.sum()), n + 1)
        assert v.head >= lm.HEAD + 1 and counts[: v.head].sum() >= lm.COVERED * v.total
        assert v.head == lm.HEAD + 1 or counts[: v.head - 1].sum() < lm.COVERED * v.total
    assert v.head > 1500  # 1,024 words are not COVERED of these 20,000
    network = lm.Network(v)
    network.flat += np.random.default_rng(3).normal(0, 0.3, len(network.flat)).astype(np.float32)
    by_context = [lm.scored([np.array([k, 1500])], network)[0] - lm.scored([np.array([k])], network)[0] for k in (3, 40)]
    assert abs(by_context[0] - by_context[1]) > 1e-3  # a word past rank 1,023 is told apart by what precedes it


def test_long_texts_take_few_windows():
    """A text far longer than the others is scored in long windows, not LONGER of its steps at a time."""
    v, rng = small_vocabulary(), np.random.default_rng(4)
    texts = [rng.integers(0, v.head + 1, n) for n in [20_000, *[40] * 600]]
    cut = list(lm.windows(texts, v, lm.LONGER, lm.LONGEST))
    assert len(cut) < 20_000 / lm.LONGER / 4 and all(x.size <= lm.LANES * lm.LONGER for x, *_ in cut)
    for steps, longest in ((lm.WINDOW, 0), (lm.LONGER, lm.LONGEST)):
        met = [np.full(len(t), -1) for t in texts]
        at = [0] * len(texts)
        for _, y, _, owner in lm.windows(texts, v, steps, longest):
            for lane in range(y.shape[1]):
                for token, k in zip(y[:, lane].tolist(), owner[:, lane].tolist()):
                    if token >= 0:
                        met[k][at[k]] = token
                        at[k] += 1
        assert all(np.array_equal(a, b) for a, b in zip(met, texts))


def test_sums_of_rows_by_id():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 70, 3000), np.zeros(50, np.int64), rng.integers(0, 1 << 17, 400), np.array([3])):
        rows = rng.normal(size=(len(ids), 5))
        found, sums = lm.summed(ids, rows)
        assert sorted(found.tolist()) == np.unique(ids).tolist()
        assert all(np.allclose(total, rows[ids == k].sum(0)) for k, total in zip(found, sums))
