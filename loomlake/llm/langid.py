"""Operator 7: language identification by multilingual mixture inference.

Each language has a table of byte-trigram counts (hashed to 2**16 cells) over all its
training texts. A document is a mixture: each of its words is drawn from one of the
languages, with the likelihood of its trigrams under that language's table.
Expectation-maximisation estimates the document's language proportions; sets of languages of
growing size, taken in the order of these proportions, are fitted anew, and the set with the
best penalised likelihood is kept. The prediction is the largest proportion in that set.

Cases: null text, or one without a letter, is und with score 0; so is every text where no
training text has a language; equal proportions go to the language first by name; texts
repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, batches, held_out, prepare, texts_of

CELLS = 1 << 16
SMOOTHING = 0.5
STEPS = 8
#: Each more language must raise the log-likelihood by this much for each log(words).
PENALTY = 2.0


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of the trigram around each word byte, start of each word, words of each text."""
    joined = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    inside = ~_SPACE[joined]
    joined = np.where(inside, joined, 32).astype(np.uint32)
    code = (joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]) * np.uint32(0x9E3779B1)
    middle = inside[1:-1]
    first = (middle & ~inside[:-2])[middle]
    word_at = np.flatnonzero(middle & ~inside[:-2])
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(word_at, np.r_[0, ends]))
    return (code[middle] >> np.uint32(16)).astype(np.int64), np.flatnonzero(first), words


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probability table, cells by languages. The table's size is fixed by the cells."""
    prepare(rows.sparkSession)

    def run(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches(rows_):
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counts.setdefault(lang, np.zeros(CELLS, np.int64))
                counts[lang] += np.bincount(trigrams(texts)[0], minlength=CELLS)
        for lang, n in counts.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], ["lang", "cell", "n"])

    source = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary"), F.col(lang_col))
    found = source.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    table = np.full((CELLS, len(names)), SMOOTHING)
    for k, name in enumerate(names):
        own = found[found["lang"] == name]
        table[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32)


def _fit(lik: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some EM steps from share, and each document's sum of log mixtures."""
    n = np.diff(np.r_[starts, len(lik)])[:, None].astype(np.float32)
    for _ in range(steps):
        part = lik * share[owner]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, starts, axis=0) / n
    mixed = np.log(np.maximum((lik * share[owner]).sum(1), 1e-30))
    return share, np.add.reduceat(mixed, starts)


def infer(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Language proportions of each text, zero outside its language set; a row of zeros where it has no words."""
    langs = table.shape[1]
    out = np.zeros((len(texts), langs), np.float32)
    cells, first, words = trigrams(texts)
    docs = np.flatnonzero(words)
    if not len(docs) or not langs:
        return out
    loglik = np.add.reduceat(table[cells], first, axis=0)
    peak = loglik.max(1, keepdims=True)
    lik = np.exp(loglik - peak)
    starts = np.r_[0, np.cumsum(words[docs])[:-1]]
    owner = np.repeat(np.arange(len(docs)), words[docs])
    single = np.add.reduceat(np.maximum(loglik - peak, np.float32(-40)), starts, axis=0)
    best = single.argmax(1)
    share = np.zeros((len(docs), langs), np.float32)
    share[np.arange(len(docs)), best] = 1
    if langs > 1:
        full, _ = _fit(lik, starts, owner, np.full((len(docs), langs), 1 / langs, np.float32), STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        score = single[np.arange(len(docs)), best]
        going = np.arange(len(docs))
        for size in range(2, langs + 1):
            going = going[np.take_along_axis(full[going], order[going, size - 1 : size], 1)[:, 0] > 1e-3]
            if not len(going):
                break
            mine = np.isin(owner, going) if len(going) < len(docs) else slice(None)
            sub_words = words[docs][going]
            start = np.zeros((len(going), langs), np.float32)
            np.put_along_axis(start, order[going, :size], np.take_along_axis(full[going], order[going, :size], 1), 1)
            start /= start.sum(1, keepdims=True)
            fitted, total = _fit(lik[mine], np.r_[0, np.cumsum(sub_words)[:-1]], np.repeat(np.arange(len(going)), sub_words), start, 3)
            better = total > score[going] + PENALTY * np.log(sub_words + 1)
            going = going[better]
            share[going], score[going] = fitted[better], total[better]
    out[docs] = share
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, langs (the selected set), shares (their proportions)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches(rows, 1 << 20):
            texts = batch.column(1).to_pylist()
            shares = infer(texts, table)
            preds, scores, sets, parts = [], [], [], []
            for text, share in zip(texts, shares):
                if not any(map(str.isalpha, text.decode("utf-8", "replace"))) or not share.any():
                    preds.append("und"), scores.append(0.0), sets.append([]), parts.append([])
                    continue
                order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                preds.append(names[order[0]])
                scores.append(min(1.0, float(share[order[0]])))
                sets.append([names[k] for k in order])
                parts.append([float(share[k]) for k in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "langs", "shares"])

    return texts_of(docs, id_col).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents whose crc32 of the id, modulo 5, is not 0."""
    return docs.where(~F.coalesce(held_out("doc_id", 0), F.lit(False)))
