"""Toxicity by class-conditional Kneser-Ney models over bytes.

One interpolated Kneser-Ney model of order ``ORDER`` is counted on toxic and one
on ordinary texts.  Orders up to ``SHARED`` pool the counts of both classes, and
at every order ``STRENGTH`` occurrences are added that follow the order below; so
an expression that neither class knows well keeps the probability that both
share and says nothing, whatever the sizes of the classes.  The models are joined
into one back-off table: for every known n-gram the log-ratio of its two
probabilities, and for every known context the log-ratio of the two back-off
weights.  From order ``PLAIN`` on the table holds contexts that toxic texts have.
A byte of a text then costs one lookup per order, done for a whole batch at once.

A text is compared by length-normalised log-likelihood ratios: over the whole
text, over its most toxic run of ``RUN`` words and over its most toxic word (a
short insult in a long text would vanish in the first alone).  A logistic curve
over the three gives the score; it is fitted on every HOLD-th text, with models
that have not counted those, and the models are then counted on all texts.

Counts come from at most ``PER_CLASS`` labelled texts and ``SAMPLE_BYTES`` of text
of each class (documented bounds); scoring takes whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import give_back, labelled_texts, slices, small_batches
from bulwark.llm.textkernel import Words, lower_ascii, text_buffer

ORDER, SHARED, PLAIN = 8, 3, 6
STRENGTH = 40.0
RUN = 8
PER_CLASS = 3072
SAMPLE_BYTES = 6 << 20
HOLD = 4

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ORDER - 1 spaces before each text, and where each text then begins and ends."""
    buf, offsets = text_buffer(column)
    n, pad = len(offsets) - 1, ORDER - 1
    out = np.full(len(buf) + n * pad, 32, dtype=np.uint8)
    out[np.arange(len(buf)) + pad * (1 + np.repeat(np.arange(n), np.diff(offsets)))] = _PLAIN[lower_ascii(buf)]
    begin = offsets[:-1] + pad * np.arange(1, n + 1)
    return out, np.stack([begin, begin + np.diff(offsets)])


def grams(buf: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes up to each position as one integer (positions before the first full one are padded)."""
    out = buf.astype(np.uint64)
    wide = np.concatenate([np.full(order, 32, np.uint8), buf])
    for k in range(1, order):
        out |= wide[order - k : order - k + len(buf)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; ``keys`` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
    return keys[first], np.diff(np.append(first, np.int32(len(keys))))


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * order)) - 1)


class _Counts:
    """Kneser-Ney counts of one order: n-grams, totals and distinct followers of their contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(float)
        self.context, first, self.distinct = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.counts, first) if len(keys) else np.zeros(0)
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
        self.discount = once / (once + 2 * twice) if once else 0.5

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(sorted_keys) == 0:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return at, sorted_keys[at] == wanted

    def probability(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.keys, keys)
        c = np.where(hit, self.counts[at], 0.0) if len(self.keys) else np.zeros(len(keys))
        at, hit = self._find(self.context, keys >> np.uint64(8))
        if not len(self.context):
            return lower
        weight = self.discount * self.distinct[at] + STRENGTH
        return np.where(hit, (np.maximum(c - self.discount, 0) + weight * lower) / (self.total[at] + STRENGTH), lower)

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.context, contexts)
        return np.where(hit, (self.discount * self.distinct[at] + STRENGTH) / (self.total[at] + STRENGTH), 1.0) if len(self.context) else np.ones(len(contexts))


def _tables(buf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, Kneser-Ney counts) of orders 1 to ORDER: occurrences of the longest, distinct bytes before each shorter one."""
    out = [_distinct(grams(buf, ORDER))]
    for k in range(ORDER - 1, 0, -1):
        out.append(_distinct(_low(out[-1][0], k)))
    return out[::-1]


class Lookup:
    """Keys to rows, without probing chains: a key that loses its slot moves to the next, smaller level."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        rows = np.arange(len(keys), dtype=np.int32)
        seed = 0x9E3779B97F4A7C15
        while len(rows):
            bits = max(8, int(np.ceil(np.log2(len(rows) + 1))) + 2)
            factor = np.uint64(seed)
            slot = ((keys[rows] * factor) >> np.uint64(64 - bits)).astype(np.int64)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = rows
            self.levels.append((factor, bits, table))
            rows = rows[table[slot] != rows]
            seed = (seed * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        self.keys = keys

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, dtype=np.int32)
        open_at = None
        for factor, bits, table in self.levels:
            keys = wanted if open_at is None else wanted[open_at]
            row = table[((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)]
            good = (row >= 0) & (self.keys[row] == keys)
            at = np.flatnonzero(good)
            out[at if open_at is None else open_at[at]] = row[at]
            left = np.flatnonzero(~good & (row >= 0))
            open_at = left if open_at is None else open_at[left]
            if not len(open_at):
                break
        return out


@dataclass
class Model:
    """keys[k], ratio[k], weight[k]: n-grams of order k + 1, their log-ratios, and those of their back-off weights."""

    keys: list[np.ndarray]
    ratio: list[np.ndarray]
    weight: list[np.ndarray]
    curve: np.ndarray

    def __post_init__(self):
        self.lookup = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"} | {"lookup": None}

    def byte_ratios(self, buf: np.ndarray) -> np.ndarray:
        """Log-ratio of toxic and ordinary probability of each byte, given the ORDER - 1 before it."""
        if self.lookup is None:
            self.lookup = [Lookup(k) for k in self.keys]
        value, weight_before = np.zeros(len(buf), np.float32), None
        for k in range(ORDER):
            row = self.lookup[k].rows(grams(buf, k + 1))
            known = row >= 0
            if weight_before is None:
                value = np.where(known, self.ratio[k][row], 0) if len(self.ratio[k]) else value
            else:
                value = value + weight_before
                if len(self.ratio[k]):
                    value = np.where(known, self.ratio[k][row], value)
            weight_before = np.zeros(len(buf), np.float32)
            if len(self.weight[k]):
                weight_before[1:] = np.where(known, self.weight[k][row], 0)[:-1]
        return value

    def inputs(self, column: pa.Array) -> np.ndarray:
        """Per text: mean ratio per word, best mean of RUN words, best word; zeros for a text without words."""
        buf, (begin, end) = padded(column)
        out = np.zeros((len(begin), 3))
        if not len(buf):
            return out
        run = np.concatenate([[0.0], np.cumsum(self.byte_ratios(buf).astype(float))])
        words = Words(buf, np.concatenate([[0], end]) if len(end) else np.zeros(1, np.int64))
        # a word ends with the space after it, where there is one
        each = run[np.minimum(words.ends + 1, len(buf))] - run[words.starts]
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b > a:
                x = each[a:b]
                sums = np.concatenate([[0.0], np.cumsum(x)])
                out[i] = sums[-1] / len(x), ((sums[RUN:] - sums[:-RUN]).max() if len(x) >= RUN else sums[-1]) / RUN, x.max()
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.inputs(column)
        return 1 / (1 + np.exp(-np.clip(self._wide(x) @ self.curve, -30, 30)))

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip(x[:, 0] * 10, -10, 10), np.clip(x[:, 1] * 2, -10, 10), np.clip(x[:, 2], -10, 20), np.ones(len(x))])


def count(texts: list[str], y: np.ndarray) -> Model:
    """The back-off table of texts with labels 0 and 1; its curve is not set."""
    side = {c: _tables(padded(pa.array([t for t, v in zip(texts, y, strict=True) if v == c], pa.large_string()))[0]) for c in (0, 1)}
    keys, ratio, weight = [], [], []
    lower = {0: None, 1: None}
    for k in range(ORDER):
        if k < SHARED:
            joint = np.concatenate([side[0][k][0], side[1][k][0]])
            known, inverse = np.unique(joint, return_inverse=True)
            pooled = np.bincount(inverse, weights=np.concatenate([side[0][k][1], side[1][k][1]]))
            counts = {c: _Counts(known, pooled) for c in (0, 1)}
        else:
            if k >= PLAIN - 1:
                here = np.unique(side[1][k][0] >> np.uint64(8))
                mine = {c: (side[c][k][0] >> np.uint64(8), _low(side[c][k][0], k)) for c in (0, 1)}
                keep = {c: np.isin(mine[c][0], here, kind="sort") & np.isin(mine[c][1], keys[k - 1], kind="sort") for c in (0, 1)}
                counts = {c: _Counts(side[c][k][0][keep[c]], side[c][k][1][keep[c]]) for c in (0, 1)}
            else:
                counts = {c: _Counts(*side[c][k]) for c in (0, 1)}
            known = np.union1d(counts[0].keys, counts[1].keys)
        p = {}
        for c in (0, 1):
            below = np.full(len(known), 1 / 256) if k == 0 else lower[c][np.searchsorted(keys[k - 1], _low(known, k))]
            p[c] = counts[c].probability(known, below)
        if k:  # weights of the order below, now that its followers are known
            weight.append(np.log(counts[1].backoff(keys[k - 1]) / counts[0].backoff(keys[k - 1])).astype(np.float32))
        keys.append(known)
        ratio.append(np.log(p[1] / p[0]).astype(np.float32))
        lower = p
        side[0][k] = side[1][k] = None
    weight.append(np.zeros(len(keys[-1]), np.float32))
    return Model(keys, ratio, weight, np.zeros(4))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Texts in a fixed order, labels 0 or 1.  Without a class, scores are the share of toxic texts."""
    y = np.asarray(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        none = [np.zeros(0, np.uint64)] * ORDER, [np.zeros(0, np.float32)] * ORDER, [np.zeros(0, np.float32)] * ORDER
        return Model(*none, np.array([0, 0, 0, np.log(share / (1 - share))]))
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        hold[np.flatnonzero(y == c)[HOLD - 1 :: HOLD]] = True
    use = ~hold if len(set(y[hold])) == 2 else np.ones(len(y), bool)
    judged = hold if len(set(y[hold])) == 2 else use
    first = count([t for t, u in zip(texts, use, strict=True) if u], y[use])
    give_back()
    x = Model._wide(np.concatenate([first.inputs(pa.array([texts[i]], pa.large_string())) for i in np.flatnonzero(judged)]))
    curve = _rising_logistic(x, y[judged])
    del first
    give_back()
    model = count(texts, y)
    model.curve = curve
    return model


def _rising_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve that falls with none of the ratios: one whose weight comes out negative is left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, use], y)
        low = [j for j, v in zip(use[:-1], w[:-1], strict=True) if v < 0]
        if not low:
            break
        use.remove(min(low, key=lambda j: w[use.index(j)]))
    out = np.zeros(x.shape[1])
    out[use] = w
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text") -> Model:
    """Fit on the sample that ``labelled_texts`` takes: at most PER_CLASS texts and SAMPLE_BYTES of text of each class."""
    sample = labelled_texts(docs, labels, label, PER_CLASS, SAMPLE_BYTES, text)
    found = sample.select(F.col("doc_id").cast("string").alias("name"), "label", "rank", "text").toArrow()
    order = sorted(range(found.num_rows), key=list(zip(found["rank"].to_pylist(), found["name"].to_pylist(), strict=True)).__getitem__)
    texts, y = found["text"].to_pylist(), found["label"].to_pylist()
    del found
    model = fit([texts[k] for k in order], [y[k] for k in order])
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into`` (0 to 1, higher: likelier toxic) to every row; a column of that name is replaced.

    Null texts are empty ones, and a text of any length is scored whole.  Equal
    texts get equal scores, repeated rows one score each; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    source = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"`{into}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.score(batch.column(text)), pa.float64())], names=[*batch.schema.names, into])

    return source.mapInArrow(run, schema)
