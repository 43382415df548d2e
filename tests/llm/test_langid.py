"""Language identification against the method written out word by word."""

import math
import random

import numpy as np
import pytest

from loomlake.llm import langid


def cells_of(word):
    padded = b" " + word + b" "
    return [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 16 for i in range(len(word))]


def brute_table(rows):
    names = sorted({lang for _, lang in rows})
    counts = {n: {} for n in names}
    for text, lang in rows:
        for word in text.encode().lower().split():
            for c in cells_of(word):
                counts[lang][c] = counts[lang].get(c, 0) + 1
    sums = {n: sum(counts[n].values()) + langid.SMOOTHING * langid.CELLS for n in names}
    return names, lambda c: [math.log((counts[n].get(c, 0) + langid.SMOOTHING) / sums[n]) for n in names]


def brute_shares(text, names, log):
    k = len(names)
    words = [[sum(v) for v in zip(*(log(c) for c in cells_of(w)))] for w in text.encode().lower().split()]
    lik = [[math.exp(x - max(w)) for x in w] for w in words]

    def fitted(share, steps):
        for _ in range(steps):
            parts = [[p * s for p, s in zip(w, share)] for w in lik]
            share = [sum(p[j] / sum(p) for p in parts) / len(words) for j in range(k)]
        return share, sum(math.log(sum(p * s for p, s in zip(w, share))) for w in lik)

    single = [sum(max(w[j] - max(w), -40) for w in words) for j in range(k)]
    best = max(range(k), key=lambda j: (single[j], -j))
    share, score = [float(j == best) for j in range(k)], single[best]
    full, _ = fitted([1 / k] * k, langid.STEPS)
    order = sorted(range(k), key=lambda j: -full[j])
    for size in range(2, k + 1):
        if full[order[size - 1]] <= 1e-3:
            break
        own = [full[j] if j in order[:size] else 0.0 for j in range(k)]
        got, total = fitted([x / sum(own) for x in own], 3)
        if total <= score + langid.PENALTY * math.log(len(words) + 1):
            break
        share, score = got, total
    return share


def test_identify_against_brute_force(spark, make_docs):
    rng = random.Random(11)
    vocabulary = {g: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(40)] for g, letters in (("aa", "abcdeé"), ("bb", "defgh"), ("cc", "ghijklß"))}
    rows = [(" ".join(rng.choices(vocabulary[g], k=30)), g) for _ in range(40) for g in vocabulary]
    model = langid.train(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string"))
    names, log = brute_table(rows)
    assert model[0] == names
    asked = [" ".join(rng.choices(vocabulary[a], k=rng.randint(1, 40)) + rng.choices(vocabulary[b], k=rng.randint(0, 40))) for a in vocabulary for b in vocabulary for _ in range(6)]
    asked.append(" ".join(rng.choices(vocabulary["bb"], k=20_000)))  # a very long text
    got = {r.doc_id: r for r in langid.identify(make_docs(list(enumerate(asked)), extra=("shares",)), model).collect()}
    several = 0
    for i, text in enumerate(asked):
        share = brute_shares(text, names, log)
        order = sorted(range(len(names)), key=lambda j: -share[j])
        assert got[i].lang_pred == names[order[0]]
        assert got[i].score == pytest.approx(min(1, share[order[0]]), abs=2e-3)
        assert dict(zip(got[i].langs, got[i].shares)) == pytest.approx({names[j]: share[j] for j in order if share[j] > 0}, abs=2e-3)
        several += len(got[i].langs) > 1
    assert several > 10 and np.isfinite([r.score for r in got.values()]).all()
