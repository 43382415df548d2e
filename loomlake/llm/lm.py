"""Operator 2: scoring by a gated recurrent language model with a class-factored softmax.

Word counts of all training texts give the vocabulary. The most frequent words, as many as
make up the share COVERED of the training texts and HEAD at least, and the end of text form
classes of equal size by rank, about as many as a class has words; all other words form one
more class, within which a word has its share of the training counts (half a count more each,
and half for any unknown word), so that the model is a proper distribution over known words
and one unknown. A gated recurrent unit reads the text; one softmax gives the class of the
next word, another the word within its class. The bounded function of unit and gates is
x / (1 + |x|), which numpy computes many times faster than tanh.

Training is by truncated backpropagation in numpy. A start is fitted on about START_DOCS
texts (those with the lowest hashes of the id). From there copies, one for each COPY tokens
of the training texts, are trained on all of them, each on the texts that a hash deals to
it, and averaged in two rounds of grouped sums, weighted by tokens; so the result does not
depend on how the input is stored. Texts run in lanes: a lane takes text after text, the state
is carried across windows and set to zero where a text begins, so a text of any length is
scored whole. To score, a window of few lanes takes more of their steps, LONGEST at most, so
that it holds about as many tokens as one of all lanes.

Counts of the KNOWN most frequent words are broadcast; the other words of a text meet their
counts in a join.

Cases: null text is empty and has its end alone; with no training text every word is
unknown and the base score is 0; repeated rows are scored alike; a null id is trained on and
scored like any other; an empty table gives no rows; other columns, whatever their names, are
not read; a long text is one lane, which runs to its end alone.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.session import materialize

from .common import batches, held_out, most_frequent, prepare, share_of, texts_of

#: Head words at least; more, until they are this share of the running words.
HEAD = 1023
COVERED = 0.6
KNOWN = 250_000
START_DOCS = 1_500
STATE = 24
LANES = 512
WINDOW = 16
#: Steps of a window where texts are only scored, and of one of few lanes at most.
LONGER = 32
LONGEST = 512
RATE = 0.01
#: Training tokens of one copy, and tokens that are packed into lanes at once.
COPY = 3_000_000
PACKED = 4_000_000
#: Logits beyond which their largest is taken off before they are exponentiated.
LARGE = 60.0
SLICE = 8192
#: Parameters that are updated at once, so that they stay in the processor's cache.
BLOCK = 1 << 14
#: Rows of the softmax that are computed at once, for the same reason.
ROWS = 1024
#: Rows of a word whose gradients are summed along with those of all words.
FEW = 8
END = b""
FLOAT = np.float32


@dataclass
class Vocabulary:
    """Words by rank with their training counts; what the counts of all words sum to."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    head: int | None = None

    def __post_init__(self):
        if self.head is None:
            covering = int(np.searchsorted(np.cumsum(self.counts), COVERED * self.total)) + 1
            self.head = min(max(HEAD + 1, covering), len(self.words))
        self.rest = self.head  # the id of any word outside the head
        self.begin = self.head + 1
        self.size = max(8, -(-int(np.sqrt(self.head)) // 4) * 4)  # words of a class
        self.n_classes = -(-self.head // self.size) + 1
        self.class_of = np.minimum(np.arange(self.head + 1) // self.size, self.n_classes - 1).astype(np.uint16)
        self.class_of[self.rest] = self.n_classes - 1
        mass = np.zeros(self.n_classes * self.size)
        mass[: self.head] = self.counts[: self.head] + 0.5
        inside = mass.reshape(-1, self.size)
        self.rest_mass = float(self.total - self.counts[: self.head].sum() + 0.5 * (self.distinct - (self.counts[: self.head] > 0).sum() + 1))
        sums = inside.sum(1)
        sums[-1] = self.rest_mass
        self.class_bias = np.log(sums / sums.sum())
        with np.errstate(divide="ignore"):
            self.word_bias = np.maximum(np.log(inside[:-1] / np.maximum(sums[:-1, None], 1e-30)), -60)


def shapes(v: Vocabulary) -> list[tuple[int, ...]]:
    return [(v.head + 2, 3 * STATE), (STATE, 3 * STATE), (STATE + 1, v.n_classes), (v.n_classes - 1, STATE + 1, v.size)]


def exponentiated(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """exp of the logits, in place, and their sums; what is taken off a row is taken off its target too."""
    if logits.size and logits.max() > LARGE:
        most = logits.max(1)
        logits -= most[:, None]
        target -= most
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], FLOAT)


def squash(x: np.ndarray, room: np.ndarray) -> None:
    """x over one more than its size, in place: the unit's bounded function, of slope (1 - size of the value) squared."""
    np.abs(x, out=room)
    room += FLOAT(1)
    x /= room


class Network:
    """Parameters as one vector with views: input, recurrent, class and word weights; the last row of these two is their bias."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        self.v = v
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes(v)), FLOAT) if flat is None else flat.copy()
        self.parts = self.views(self.flat)
        self.grad: np.ndarray | None = None  # what gradient() fills, and its views
        if flat is None:
            rng = np.random.default_rng(1)
            for part in self.parts[:2]:
                part[:] = rng.normal(0, 0.2, part.shape)
            self.parts[0][:, STATE : 2 * STATE] -= 1  # keep most of the state at first
            self.parts[2][-1] = v.class_bias
            self.parts[3][:, -1] = v.word_bias

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        found, at = [], 0
        for shape in shapes(self.v):
            size = int(np.prod(shape))
            found.append(flat[at : at + size].reshape(shape))
            at += size
        return found

    def run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """States of a window (steps by lanes, and a one for the bias), what the way back needs, and the last state.

        Inside, a row is a unit and a column a lane, so that gates are whole blocks of memory.
        """
        w_in, w_rec = self.parts[0], self.parts[1].T
        steps, lanes = x.shape
        gates, some = np.empty((steps, 3 * STATE, lanes), FLOAT), max(1, LANES // lanes)
        for t in range(0, steps, some):
            gates[t : t + some] = w_in.take(x[t : t + some], axis=0).transpose(0, 2, 1)
        states, trace = np.ones((steps, lanes, STATE + 1), FLOAT), []
        whole = keep.all(1)
        size = np.empty((2 * STATE, lanes), FLOAT)
        for t in range(steps):
            if not whole[t]:
                h = h * keep[t]
            rec = w_rec @ h
            both = gates[t, : 2 * STATE]
            both += rec[: 2 * STATE]
            squash(both, size)
            both *= FLOAT(0.5)
            both += FLOAT(0.5)
            new, rec = gates[t, 2 * STATE :], rec[2 * STATE :]
            new += both[:STATE] * rec
            squash(new, size[:STATE])
            trace.append((h, both, new, rec))
            step = new - h
            step *= both[STATE:]
            step += h
            h = step
            states[t, :, :STATE] = h.T
        return states, trace, h

    def targets(self, h: np.ndarray, y: np.ndarray, back: bool):
        """Log-probability of each target class and word; with back, the gradient of their mean's negative by h, and in grad by the weights.

        Inside, rows are in the order of their class.
        """
        _, _, w_class, w_word = self.parts
        own = self.v.class_of[y]
        order = np.argsort(own, kind="stable")
        h, y, own = h.take(order, axis=0), y[order], own[order]
        cuts = np.searchsorted(own, np.arange(self.v.n_classes)).tolist()
        word, logp, dh = y - own * np.int32(self.v.size), np.empty(len(y), FLOAT), np.empty((len(y), STATE), FLOAT)
        each = FLOAT(1 / max(1, len(y)))
        if back:
            _, _, g_class, g_word = self.grad_parts
            g_class.fill(0)
            g_word.fill(0)
        # In pieces that stay in the processor's cache: first classes, then words of a few whole classes.
        p = np.empty((min(ROWS, len(y)), self.v.n_classes), FLOAT)
        for a in range(0, len(y), ROWS):
            part = slice(a, a + ROWS)
            rows = np.arange(len(own[part]))
            logits = np.matmul(h[part], w_class, out=p[: len(rows)])
            target = logits[rows, own[part]]
            total = exponentiated(logits, target)
            logp[part] = target - np.log(total)
            if back:
                logits *= (each / total)[:, None]
                logits[rows, own[part]] -= each
                np.matmul(logits, w_class[:-1].T, out=dh[part])
                g_class += h[part].T @ logits
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        while spans:
            first, taken = spans[0][1], 1
            while taken < len(spans) and spans[taken][2] - first <= ROWS:
                taken += 1
            some, spans = spans[:taken], spans[taken:]
            part = slice(first, some[-1][2])
            rows = np.arange(part.stop - first)
            logits = np.empty((len(rows), self.v.size), FLOAT)
            for k, a, b in some:
                np.matmul(h[a:b], w_word[k], out=logits[a - first : b - first])
            target = logits[rows, word[part]]
            total = exponentiated(logits, target)
            logp[part] += target - np.log(total)
            if back:
                logits *= (each / total)[:, None]
                logits[rows, word[part]] -= each
                for k, a, b in some:
                    np.matmul(h[a:b].T, logits[a - first : b - first], out=g_word[k])
                    dh[a:b] += logits[a - first : b - first] @ w_word[k, :-1].T
        out = np.empty_like(logp)
        out[order] = logp
        if not back:
            return out, None
        d_out = np.empty_like(dh)
        d_out[order] = dh
        return out, d_out

    def gradient(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """Gradient vector of a window's mean loss, which the next call overwrites, and the state to carry on."""
        if self.grad is None:
            self.grad = np.zeros_like(self.flat)
            self.grad_parts = self.views(self.grad)
        g_in, g_rec, _, _ = self.grad_parts
        states, trace, last = self.run(x, keep, h)
        steps, lanes = x.shape
        states, y = states.reshape(-1, STATE + 1), y.ravel()
        live = np.flatnonzero(y >= 0)
        if len(live) == len(y):
            _, d_out = self.targets(states, y, True)
        else:
            d_out = np.zeros((steps * lanes, STATE), FLOAT)
            d_out[live] = self.targets(states[live], y[live], True)[1]
        d_out = d_out.reshape(steps, lanes, STATE)
        w_rec = self.parts[1]
        d_rows, d_gates = np.empty((steps, lanes, 3 * STATE), FLOAT), np.empty((3 * STATE, lanes), FLOAT)
        d_both, d_new = d_gates[: 2 * STATE], d_gates[2 * STATE :]
        d_reset, d_update = d_both[:STATE], d_both[STATE:]
        g_rec.fill(0)
        dh, d_rec, room, slope = np.zeros((STATE, lanes), FLOAT), np.empty((3 * STATE, lanes), FLOAT), np.empty((STATE, lanes), FLOAT), np.empty((2 * STATE, lanes), FLOAT)
        whole = keep.all(1)
        for t in range(steps - 1, -1, -1):
            before, both, new, rec = trace[t]
            reset, update = both[:STATE], both[STATE:]
            dh += d_out[t].T
            # Gates are half of one plus the squashed sum: their slope is twice the square of the nearer end.
            np.subtract(FLOAT(1), both, out=slope)
            np.minimum(slope, both, out=slope)
            slope *= slope
            slope *= FLOAT(2)
            np.subtract(new, before, out=d_update)
            d_update *= dh
            carried = dh * update
            np.abs(new, out=room)
            np.subtract(FLOAT(1), room, out=room)
            np.multiply(carried, room, out=d_new)
            d_new *= room
            np.multiply(d_new, reset, out=d_rec[2 * STATE :])
            np.multiply(d_new, rec, out=d_reset)
            d_both *= slope
            d_rows[t] = d_gates.T
            d_rec[: 2 * STATE] = d_both
            g_rec += before @ d_rec.T
            dh -= carried
            dh += w_rec @ d_rec
            if not whole[t]:
                dh *= keep[t]
        g_in.fill(0)
        words, sums = summed(x.ravel(), d_rows.reshape(-1, 3 * STATE))
        g_in[words] = sums
        return self.grad, last


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the sum of the rows of each: FEW rows of all ids one after the other, the rest id by id."""
    ids = ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids  # shorter to sort
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    counts = np.diff(np.r_[first, len(ids)])
    most = np.argsort(-counts, kind="stable")
    first, counts = first[most], counts[most]
    sums = rows.take(order[first], axis=0)
    for k in range(1, FEW):
        n = int(np.searchsorted(-counts, -k))
        if not n:
            break
        sums[:n] += rows.take(order[first[:n] + k], axis=0)
    ones = np.ones(len(ids), rows.dtype)
    for j in range(int(np.searchsorted(-counts, -FEW))):
        more = order[first[j] + FEW : first[j] + counts[j]]
        sums[j] += ones[: len(more)] @ rows.take(more, axis=0)
    return ids[first], sums


class Trainer:
    """Adam steps on a network, each in proportion to the lanes that still run."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps, self.tokens = network, rate, 0, 0
        self.mean, self.square = np.zeros_like(network.flat), np.zeros_like(network.flat)
        self.room = np.empty(BLOCK, network.flat.dtype)

    def step(self, grad: np.ndarray, share: float) -> None:
        """One step; share: of a step on all lanes. The gradient is changed."""
        self.steps += 1
        norm = float(np.sqrt(np.dot(grad, grad)))
        # The moments are kept as plain sums, 10 and 200 times the means.
        small = FLOAT(1e-7 * np.sqrt(200))
        scale = FLOAT(share * self.rate / (1 - 0.9**self.steps) * np.sqrt(1 - 0.995**self.steps) * np.sqrt(200) / 10)
        for at in range(0, len(grad), BLOCK):
            own, mean, square, flat = (a[at : at + BLOCK] for a in (grad, self.mean, self.square, self.network.flat))
            room = self.room[: len(own)]
            if norm > 1:
                own /= FLOAT(norm)
            mean *= FLOAT(0.9)
            mean += own
            own *= own
            square *= FLOAT(0.995)
            square += own
            np.sqrt(square, out=room)
            room += small
            np.divide(mean, room, out=room)
            room *= scale
            flat -= room

    def learn(self, texts: list[np.ndarray]) -> None:
        h = None
        for x, y, keep, _ in windows(texts, self.network.v, WINDOW):
            if h is None:
                h, full = np.zeros((STATE, x.shape[1]), FLOAT), x.shape[1]
            grad, h = self.network.gradient(x, y, keep, h[:, : x.shape[1]])
            self.step(grad, x.shape[1] / full)
        self.tokens += sum(map(len, texts))


def windows(texts: list[np.ndarray], v: Vocabulary, steps: int, longest: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, targets (-1: none), whether the state is kept, and the text, by step and lane.

    Texts are dealt to lanes, longest first to the lane with least; lanes stand in the order
    of what they hold, so that those still running are the first. The fewer these are, the
    more steps a window has, up to longest; with 0 it always has as many.
    """
    lanes = min(LANES, len(texts))
    load = [(0, lane) for lane in range(lanes)]
    own: list[list[int]] = [[] for _ in range(lanes)]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        held, lane = heapq.heappop(load)
        own[lane].append(k)
        heapq.heappush(load, (held + len(texts[k]), lane))
    load.sort(reverse=True)
    order = [k for _, lane in load for k in own[lane]]
    length = np.array([n for n, _ in load])
    starts = np.r_[0, np.cumsum([len(texts[k]) for k in order])[:-1]]
    y = np.concatenate([*(texts[k] for k in order), np.zeros(steps, np.int64)]).astype(np.int32)
    x = np.r_[v.begin, y[:-1]].astype(np.int32)
    x[starts] = v.begin
    keep = np.ones(len(y), FLOAT)
    keep[starts] = 0
    owner = np.repeat(np.array([*order, -1]), [*(len(texts[k]) for k in order), steps])
    first = np.r_[0, np.cumsum(length)[:-1]]
    at, most = 0, int(length[0])
    while at < most:
        running = int((length > at).sum())
        ahead = min(max(steps, longest), steps * (lanes // running), -(-(most - at) // steps) * steps)
        t = at + np.arange(ahead)[:, None]
        place = first[:running] + t
        inside = t < length[:running]
        place[~inside] = len(y) - 1
        yield x[place], np.where(inside, y[place], -1), keep[place], owner[place]
        at += ahead


def scored(texts: list[np.ndarray], network: Network) -> np.ndarray:
    """Natural log-probability of each text of head ids; words outside the head count as their class."""
    h, out = None, np.zeros(len(texts))
    for x, y, keep, owner in windows(texts, network.v, LONGER, LONGEST):
        h = np.zeros((STATE, x.shape[1]), FLOAT) if h is None else h[:, : x.shape[1]]
        states, _, h = network.run(x, keep, h)
        live = np.flatnonzero(y.ravel() >= 0)
        found, _ = network.targets(states.reshape(-1, STATE + 1)[live], y.ravel()[live], False)
        out += np.bincount(owner.ravel()[live], found, len(texts))
    return out


def count_words(training: DataFrame) -> DataFrame:
    """word, c over all training texts; the end of a text is the empty word."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches(rows):
            for text in batch.column(1).to_pylist():
                counts.update(text.lower().split())
                counts[END] += 1
            if len(counts) > 300_000:
                yield row(counts)
                counts = Counter()
        if counts:
            yield row(counts)

    return materialize(texts_of(training).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words that occur most, KNOWN at most."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    end = counts.where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    top = most_frequent(counts.where(F.octet_length("word") > 0), "c", KNOWN).toPandas().sort_values(["c", "word"], ascending=[False, True])
    names, numbers = map(bytes, top["word"]), top["c"]
    return Vocabulary([END, *names], np.array([end, *numbers], np.int64), sums["n"] or 0, sums["v"])


def _ids(text: bytes, get, rest: int) -> np.ndarray:
    words = text.lower().split()
    words.append(END)
    return np.fromiter(map(get, words, repeat(rest)), np.int64, len(words))


def trained(training: DataFrame, v: Vocabulary, start: np.ndarray, rate: float, copies: int, rounds: int = 1) -> np.ndarray:
    """Parameters averaged over copies, each trained on the texts that a hash deals to it."""
    spark = training.sparkSession
    small = Vocabulary(v.words[: v.head], v.counts[: v.head], v.total, v.distinct, v.head)
    shared = spark.sparkContext.broadcast((small, start))
    copy = F.pmod(F.xxhash64("doc_id", "text"), F.lit(copies)).cast("int")
    dealt = texts_of(training).withColumn("copy", copy)

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        get = {w: i for i, w in enumerate(own.words[: own.head])}.get
        for batch in batches(rows):
            ids = [_ids(text, get, own.rest).astype(np.uint32).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(ids, pa.binary())], ["copy", "doc_id", "ids"])

    def learn(group: pa.Table) -> pa.Table:
        own, flat = shared.value
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("ids").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        texts = [np.frombuffer(ids, np.uint32).astype(np.int64) for _, ids in rows]
        trainer = Trainer(Network(own, flat), rate)
        for _ in range(rounds):
            trainer.learn(texts)
        flat = trainer.network.flat
        values = [flat[a : a + SLICE].tobytes() for a in range(0, len(flat), SLICE)]
        n = len(values)
        return pa.table({"slice": pa.array(range(n), pa.int32()), "copy": pa.array([group.column("copy")[0].as_py()] * n, pa.int32()), "weight": pa.array([float(trainer.tokens)] * n), "value": pa.array(values, pa.binary())})

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("copy")
        weight = group.column("weight").to_numpy()
        rows = np.stack([np.frombuffer(v_, FLOAT) for v_ in group.column("value").to_pylist()])
        value = (weight @ rows.astype(np.float64) / weight.sum()).astype(FLOAT)
        return pa.table({"slice": group.column("slice")[:1], "copy": group.column("copy")[:1], "weight": [float(weight.sum())], "value": pa.array([value.tobytes()], pa.binary())})

    schema = "slice int, copy int, weight double, value binary"
    learned = dealt.mapInArrow(encode, "copy int, doc_id long, ids binary").groupBy("copy").applyInArrow(learn, schema)
    some = learned.groupBy("slice", F.pmod("copy", F.lit(256)).alias("_some")).applyInArrow(mean, schema)
    found = some.groupBy("slice").applyInArrow(mean, schema).orderBy("slice").collect()
    return np.concatenate([np.frombuffer(bytes(r["value"]), FLOAT) for r in found]) if found else start


def fit(training: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts, vocabulary and network parameters of the training texts."""
    prepare(training.sparkSession)
    counts = count_words(training)
    v = vocabulary(counts)
    flat = trained(share_of(training, START_DOCS, "doc_id").select("doc_id", "text"), v, Network(v).flat, RATE, 1, 2)
    return counts, v, trained(training, v, flat, RATE / 4, max(1, round(v.total / COPY)))


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((v, flat))
    scale = v.total + 0.5 * (v.distinct + 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, params = shared.value
        network = Network(own, params)
        get = {w: i for i, w in enumerate(own.words)}.get
        logs = np.log10(np.r_[own.counts + 0.5, 1.0])  # the last for words to be joined
        seen = np.r_[own.counts > 0, False]
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0

        def table(kind: int, size: int, columns: dict) -> pa.RecordBatch:
            kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "model": pa.float64(), "word": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), *(pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items())], ["kind", *kinds])

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [np.where((t < own.head) & (t >= 0), t, own.rest) for _, _, t, _ in held]
            logp = scored(texts, network) / np.log(10)
            out: dict[str, list] = {c: [] for c in ("row", "doc_id", "n", "known", "base", "model")}
            extra: dict[str, list] = {c: [] for c in ("row", "word", "n")}
            for (row, doc, ids, words), lp in zip(held, logp.tolist()):
                other = ids[(ids < 0) | (ids >= own.head)]
                values = row, doc, len(ids), int(seen[ids].sum()), float(logs[ids].sum() - len(ids) * np.log10(scale)), lp + float(logs[other].sum() - len(other) * np.log10(own.rest_mass))
                for column, value in zip(out.values(), values):
                    column.append(value)
                if words:
                    found = Counter(words)
                    extra["row"].extend([row] * len(found))
                    extra["word"].extend(found)
                    extra["n"].extend(found.values())
            yield table(0, len(held), out)
            yield table(1, len(extra["row"]), extra)

        for batch in batches(rows, 2 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.lower().split()
                words.append(END)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                held.append((number, doc, ids, [words[k] for k in np.flatnonzero(ids < 0).tolist()]))
                number += 1
                size += len(ids)
            if size > PACKED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    schema = "kind int, row long, doc_id long, n long, known long, base double, model double, word binary"
    found = materialize(texts_of(docs).mapInArrow(run, schema), "lm-scores", "kind")
    words = found.where("kind = 1").select("row", "word", "n").join(counts, "word", "left")
    more = words.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    rows = found.where("kind = 0").select("row", "doc_id", "n", "known", "base", "model").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents whose crc32 of the id, modulo 5, is not 1."""
    return docs.where(~F.coalesce(held_out("doc_id", 1), F.lit(False)))
