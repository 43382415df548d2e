import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomlake.llm import common, components, ngram_join

from .conftest import ODD


def brute_components(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = frozenset(b" ".join(words[j : j + k]) for j in range(len(words) - k + 1)) if k else frozenset()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    common_line = " ".join(words[:40])
    base = [rng.choices(words, k=rng.choice([1, 4, 8, 30, 90])) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        doc = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            doc[rng.randrange(len(doc))] = rng.choice(words)
        text = " ".join(doc)
        if rng.random() < 0.3:
            text = common_line + "\n" + text
        rows.append((i + 1000, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("light, block, hot, often", [(32, 2048, 200_000, 4), (3, 5, 200_000, 4), (3, 5, 6, 2)])
def test_join_against_brute_force(make_docs, light, block, hot, often, monkeypatch):
    for constant, value in (("LIGHT", light), ("BLOCK", block), ("HOT", hot), ("OFTEN", often)):
        monkeypatch.setattr(ngram_join, constant, value)
    rows = [r for r in ODD if r[0] is not None] + corpus(light, 400)
    rows += [(5000 + i, " ".join(f"n{j}" if j != i % 80 else f"x{i}" for j in range(80))) for i in range(90)]
    # too far from each other to be linked, though they share their shingles' list
    rows += [(6000 + i, " ".join(f"m{j}" if j % 27 != i % 27 else f"y{i}" for j in range(80))) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(make_docs(rows, extra=("name", "n_shingles", "a"))).collect()}
    assert got == brute_components(rows)


def test_join_nulls_and_empty(make_docs, no_docs):
    rows = [(None, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (3, "again three is here twice over")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (2, 2, 2), (3, 0, 3), (4, 0, 4), (3, 2, 3)], key=str)
    assert ngram_join.join(no_docs).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(0)
    for _ in range(60):
        query = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        others = []
        for _ in range(12):
            keep = query[rng.random(len(query)) < rng.choice([0.5, 0.8, 0.95])]
            others.append(np.unique(np.r_[keep, rng.integers(0, 400, rng.integers(0, 12)).astype(np.uint64)]))
        exact = [i for i, o in enumerate(others) if 100 * len(np.intersect1d(query, o)) >= 75 * len(np.union1d(query, o))]
        assert sorted(ngram_join.divide_skip(query, others)) == exact


def test_bitmap_bound():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)])
        if len(b):
            assert ngram_join.most_shared(len(a), len(b), ngram_join.parity(a), ngram_join.parity(b)) >= len(np.intersect1d(a, b))


def test_pairs_that_may_be_linked():
    rng = np.random.default_rng(2)
    sets = []
    for k in range(60):
        base = np.unique(np.random.default_rng(k % 6).integers(0, 2**63, 10 + 40 * (k % 6)).astype(np.uint64))
        sets.append(np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, k % 4).astype(np.uint64)]))
    name, n = np.arange(60) * 7, np.array([len(s) for s in sets])
    label, bits = np.arange(60) % 10, [ngram_join.parity(s) for s in sets]
    linked = {(7 * i, 7 * j) for i in range(60) for j in range(i) if label[i] != label[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    for side in (np.full(60, 2), np.arange(60) // 6 % 2):
        found = {(max(x, y), min(x, y)) for a, b in ngram_join.may_link(name, n, n, label, bits, side) for x, y in zip(a.tolist(), b.tolist())}
        wanted = linked if side[0] == 2 else {(a, b) for a, b in linked if a // 42 % 2 != b // 42 % 2}
        assert wanted and wanted <= found and len(found) < 3 * len(wanted) + 20


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}


def test_word_hashes_agree_with_words():
    a = common.word_hashes(b"The cat\x0bsat  on\tthe CAT")
    assert len(a) == 6 and a[0] == a[4] and a[1] == a[5] and len(set(a.tolist())) == 4
    assert len(common.word_hashes(b"")) == len(common.word_hashes(b" \n")) == 0


@pytest.mark.parametrize("light, block", [(32, 256), (3, 7)])
def test_links_against_brute_force(make_docs, light, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    # 60 near copies with common words before and after: more than LIGHT share their shingles
    rows = corpus(light, 160) + [(5000 + i, " ".join(f"n{j}" if j != 5 * (i % 15) else f"x{i}" for j in range(80))) for i in range(60)]
    sets, first = {}, {}
    for i, t in sorted(rows):
        words = t.lower().split()
        k = min(5, len(words))
        own = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1))
        sets[first.setdefault(own, i)] = own
    expected = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 100 * len(a & b) >= 75 * len(a | b)]
    got = sorted((r.class_a, r.class_b) for r in ngram_join.links(make_docs(rows)).collect())
    assert got == sorted(expected) and sum(i >= 5000 for i, _ in got) > 1000
