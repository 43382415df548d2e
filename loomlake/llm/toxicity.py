"""Operator 4: toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel of two strings sums over all three-letter subsequences they share, each occurrence
weighted by DECAY to the length it spans, so gapped and inserted-character spellings keep
most of their kernel value; it is normalised to 1 for equal strings. Landmarks are a spread
of strings from toxic documents and of their closest clean ones; the Nystrom map of the
kernel to these landmarks feeds a squared-hinge SVM over the strings of the labelled texts
(tokens, and runs of single letters set apart, joined up), positive ones also in spellings
with characters put between. As the kernel is a sum over subsequences, the trained decision
function is one weight a subsequence, which scores a string in one pass without the landmarks.

A document's score is a logistic function of its highest string margins and of the number
of positive ones, fitted on the same labelled documents. Every token of the whole text counts.

The labelled sample is bounded by about SAMPLE_DOCS (those with the lowest hashes of the id) and
its strings by SAMPLE_STRINGS; scoring covers all rows. A string's label for the SVM is by the
documents that have it: toxic where hardly any but toxic ones do, clean where most are clean.

Cases: null text is empty and scored as a text without any toxic string; where no label (or
only one class) is there to learn from, every score is 0; repeated texts, and ties of any kind,
get equal scores; rows with a null or repeated id are scored each by itself, and of the
labelled rows with one id the greatest text is learned from; an empty table gives no rows;
other columns, whatever their names, are not read; of a long text the distinct strings are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, held_out, kept, prepare, share_of, texts_of

SAMPLE_DOCS = 20_000
SAMPLE_STRINGS = 40_000
#: Positive strings, and clean ones close to them, that landmarks are chosen from.
POSITIVE = 400
LANDMARKS = 128
#: Weight of the squared norm against the losses of the strings, of which either class weighs 1,000 and 3,000.
RIDGE = 1.0
FEATURES = 7
DECAY = 0.7
LONGEST = 16
CACHE = 250_000
EDGES = b" .,;:!?\"'()[]{}<>-*_`~#/\\|$%&@^+="
_SET_APART = re.compile(rb"(?<![^\x20\x09-\x0d])(?:[^\x20\x09-\x0d][\x20\x09-\x0d]){2,}[^\x20\x09-\x0d](?![^\x20\x09-\x0d])")

#: 64 letters: a-z, 0-9, and the other bytes dealt over the rest.
_ALPHABET = np.array([b - 97 if 97 <= b <= 122 else b - 22 if 48 <= b <= 57 else 36 + b % 28 for b in range(256)], np.int32)
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def strings_of(text: bytes) -> set[bytes]:
    """The distinct tokens of a text, and its runs of letters set apart, each joined up."""
    low = text.lower()
    return set(low.split()) | {b"".join(m.split()) for m in _SET_APART.findall(low)}


def pieces(token: bytes) -> list[bytes]:
    """A token without its edges, in overlapping windows where it is long."""
    token = token.strip(EDGES)
    if len(token) <= LONGEST:
        return [token]
    step = LONGEST // 2
    return [token[i : i + LONGEST] for i in [*range(0, len(token) - LONGEST, step), len(token) - LONGEST]]


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all three-letter subsequences of a string of n letters, and their weights."""
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _TRIPLES[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


def self_kernel(letters: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by dynamic programming over prefixes."""
    rows, n = letters.shape
    step = np.arange(n)[:, None] - np.arange(n)
    decay = np.where(step > 0, DECAY ** np.maximum(step, 0), 0).astype(np.float32)
    equal = (letters[:, :, None] == letters[:, None, :]).astype(np.float32)
    inner = equal
    for _ in range(2):
        inner = (inner.reshape(-1, n) @ decay.T).reshape(rows, n, n)
        inner = equal * (inner.transpose(0, 2, 1).reshape(-1, n) @ decay.T).reshape(rows, n, n).transpose(0, 2, 1)
    return DECAY**2 * inner.sum((1, 2))


def by_length(strings: list[bytes], block: int = 4000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and letters of the strings of three letters or more, in blocks of one length."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(lengths[lengths >= 3]).tolist():
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), max(1, block * 8 // n)):
            part = rows[at : at + max(1, block * 8 // n)]
            raw = np.frombuffer(b"".join([strings[i] for i in part.tolist()]), np.uint8).reshape(-1, n)
            yield part, _ALPHABET[raw]


def _codes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    return letters[:, at[:, 0]] << 12 | letters[:, at[:, 1]] << 6 | letters[:, at[:, 2]]


@dataclass
class Subsequences:
    """Normalised subsequence weights of some strings: a column each, rows for the codes that occur; row 0 is zero."""

    place: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Subsequences:
        found = [(rows, _codes(letters, triples(letters.shape[1])[0]), letters) for rows, letters in by_length(strings)]
        codes = np.unique(np.concatenate([c.ravel() for _, c, _ in found])) if found else np.zeros(0, np.int64)
        place = np.zeros(1 << 18, np.int32)
        place[codes] = np.arange(1, len(codes) + 1)
        columns = np.zeros((len(codes) + 1, len(strings)), np.float32)
        for rows, code, letters in found:
            decay, norm = triples(letters.shape[1])[1], np.sqrt(self_kernel(letters))
            for i, row in enumerate(rows.tolist()):
                np.add.at(columns[:, row], place[code[i]], decay / norm[i])
        return cls(place, columns)

    def kernel(self) -> np.ndarray:
        return self.columns.T @ self.columns

    def of_others(self, strings: list[bytes]) -> np.ndarray:
        """The kernel of these strings with each column's string."""
        out = np.zeros((len(strings), self.columns.shape[1]), np.float32)
        for rows, letters in by_length(strings):
            at, decay = triples(letters.shape[1])
            code, norm = self.place[_codes(letters, at)], np.sqrt(self_kernel(letters))
            for i, row in enumerate(rows.tolist()):
                hit = code[i] > 0
                out[row] = decay[hit] @ self.columns[code[i][hit]] / norm[i]
        return out


def weigh(strings: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Normalised sum over the subsequences of each string of these 2**18 weights."""
    out = np.zeros(len(strings), np.float32)
    for rows, letters in by_length(strings):
        at, decay = triples(letters.shape[1])
        out[rows] = weights[_codes(letters, at)] @ decay / np.sqrt(self_kernel(letters))
    return out


def spread(kernel: np.ndarray, k: int) -> list[int]:
    """Greedy k-centre choice: each next string is the one least like those chosen."""
    chosen, nearest = [0], kernel[0].copy()
    while len(chosen) < min(k, len(kernel)):
        following = int(nearest.argmin())
        if nearest[following] > 0.999:
            break
        chosen.append(following)
        nearest = np.maximum(nearest, kernel[following])
    return chosen


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, hinge: bool) -> np.ndarray:
    """Weights (last: the bias) of a squared-hinge SVM or of a logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(30):
        margin = x @ w
        if hinge:
            active = y * margin < 1
            slope, bend = np.where(active, (margin - y), 0) * weight, active * weight
        else:
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            slope, bend = (p - (y > 0)) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        step = np.linalg.solve(x.T @ (x * bend[:, None]) + keep, x.T @ slope + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    """One weight a subsequence and a bias; the logistic function of the document features."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray
    landmarks: list[bytes]


def spellings(string: bytes) -> list[bytes]:
    """The string with characters put between its letters, and with doubled ones."""
    return [bytes([c]).join(bytes([b]) for b in string)[:LONGEST] for c in b"*.-"] + [bytes(x for b in string for x in (b, b))[:LONGEST]] + [string[:i] + c + string[i:] for i, c in ((1, b"."), (2, b"*"), (len(string) // 2, b"_"))]


def fit_strings(table: list[tuple[bytes, int, int]], n_toxic: int) -> tuple[np.ndarray, float, list[bytes]] | None:
    """The decision function from (string, toxic documents, clean documents)."""
    least = max(3, 0.002 * n_toxic)
    merged: dict[bytes, list[int]] = {}
    for string, t, c in table:
        for piece in pieces(string):
            if len(piece) >= 3:
                counts = merged.setdefault(piece, [0, 0])
                counts[0] += t
                counts[1] += c
    rows = [(s, t, c) for s, (t, c) in sorted(merged.items())]
    positive = [(s, t) for s, t, c in rows if t >= least and t >= 0.8 * (t + c)]
    negative = [(s, t + c) for s, t, c in rows if t < 0.5 * (t + c)]
    if not positive or not negative:
        return None
    positive.sort(key=lambda x: (-x[1], x[0]))
    strings = [s for s, _ in positive][:POSITIVE]
    marks = [strings[i] for i in spread(Subsequences.of(strings).kernel(), LANDMARKS * 5 // 8)]
    others = [s for s, _ in negative]
    near = Subsequences.of(marks).of_others(others).max(1)
    close = [others[i] for i in np.argsort(-near, kind="stable")[:POSITIVE].tolist()]
    marks += [close[i] for i in spread(Subsequences.of(close).kernel(), LANDMARKS - len(marks))]
    basis = Subsequences.of(marks)
    values, vectors = np.linalg.eigh(basis.kernel().astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    varied = [(v, t / 8) for s, t in positive if t >= 2 * least for v in spellings(s)]
    rows_x = [*strings, *(v for v, _ in varied), *others]
    y = np.r_[np.ones(len(strings) + len(varied)), -np.ones(len(others))]
    weight = np.r_[[float(t) for _, t in positive[:POSITIVE]], [t for _, t in varied], np.sqrt([float(n) for _, n in negative])]
    for sign in (1, -1):
        weight[y == sign] *= 1000 * (1 if sign > 0 else 3) / weight[y == sign].sum()
    w = newton(basis.of_others(rows_x) @ root, y, weight, RIDGE, True)
    weights = basis.columns @ (root @ w[:-1])
    return weights[basis.place].astype(np.float32), float(w[-1]), marks


class Scorer:
    """Margins of strings, remembered in a Python worker, and features of documents."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def learn(self, tokens: list[bytes]) -> None:
        parts = [(i, p) for i, t in enumerate(tokens) for p in pieces(t)]
        raw = weigh([p for _, p in parts], self.weights) + self.bias
        best = np.full(len(tokens), -9, np.float32)
        np.maximum.at(best, np.array([i for i, _ in parts], np.int64), raw)
        self.cache.update(zip(tokens, best.tolist()))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The three highest margins and the fifth; logs of the number of strings above three margins."""
        found = [strings_of(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        new = list(set().union(*found) - self.cache.keys())
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        out = np.zeros((len(texts), FEATURES))
        for row, strings in zip(out, found):
            values = np.fromiter(map(self.cache.__getitem__, strings), np.float32, len(strings))
            row[:4] = np.sort(np.r_[values if len(values) < 6 else np.partition(values, -5)[-5:], np.full(5, -1.0)])[::-1][[0, 1, 2, 4]]
            row[4:] = [np.log1p((values > least).sum()) for least in (0.0, 0.4, 0.8)]
        return np.clip(out, -1.5, 6)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on about SAMPLE_DOCS labelled documents at most; None where one class is missing."""
    spark = prepare(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = share_of(marked, SAMPLE_DOCS, "doc_id")
    # About SAMPLE_DOCS rows of two numbers; of rows with one id, one text.
    taken = texts_of(docs.where(F.col("text").isNotNull())).join(F.broadcast(sample), "doc_id")
    known = taken.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found: dict[bytes, list[int]] = {}
            totals = [0, 0]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[toxic > 0] += 1
                for s in strings_of(text):
                    found.setdefault(s.strip(EDGES), [0, 0])[toxic > 0] += 1
            found[b" "] = totals
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([c[1] for c in found.values()], pa.int64()), pa.array([c[0] for c in found.values()], pa.int64())], ["string", "toxic", "clean"])

    counted = known.mapInArrow(count, "string binary, toxic long, clean long").groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = counted.where(F.col("toxic") + F.col("clean") >= 3).orderBy(F.desc(F.col("string") == F.lit(b" ")), F.desc("toxic"), F.desc("clean"), "string").limit(SAMPLE_STRINGS).collect()
    table = [(bytes(r["string"]), r["toxic"], r["clean"]) for r in rows]
    n_toxic = next((t for s, t, _ in table if s == b" "), 0)
    fitted = fit_strings([r for r in table if r[0] != b" "], n_toxic)
    if fitted is None:
        return None
    weights, bias, marks = fitted
    shared = spark.sparkContext.broadcast((weights, bias))

    def features(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches(rows_):
            x = scorer.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES)), batch.column(1)], [*(f"f{i}" for i in range(FEATURES)), "toxic"])

    seen = known.mapInArrow(features, ", ".join(f"f{i} double" for i in range(FEATURES)) + ", toxic int").toPandas()
    y = np.where(seen["toxic"] > 0, 1.0, -1.0)
    logistic = newton(seen[[f"f{i}" for i in range(FEATURES)]].to_numpy(), y, np.ones(len(y)), 1.0, False)
    return Model(weights, bias, logistic, marks)


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    scorer = kept("toxicity", hash(model.weights.tobytes()), lambda: Scorer(model.weights, model.bias))
    x = scorer.features(texts)
    return 1 / (1 + np.exp(-np.clip(x @ model.logistic[:-1] + model.logistic[-1], -30, 30)))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    if model is None:
        return docs
    spark = prepare(docs.sparkSession)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2 << 20):
            p = probabilities(shared.value, [(t or "").encode() for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on)."""
    source = texts_of(docs, id_col)
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2 << 20):
            p = probabilities(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels whose crc32 of the id, modulo 5, is not 0."""
    return labels.where(~F.coalesce(held_out("doc_id", 0), F.lit(False)))
