"""Quality classifier: linear support vectors over naive-Bayes-scaled n-grams.

Features are indicators (present or not) of word n-grams and of n-grams of word
shapes: first and last byte class, length class, all capitals or not, same as
the word before or not.  All are hashed into ``BUCKETS`` positions.  An indicator
is scaled by the class log-count ratio of its bucket, texts are scaled to unit
length, and a hinge loss is minimised by dual coordinate descent.  A logistic
curve fitted on texts that the descent did not see turns margins into scores.

The fit takes at most ``PER_CLASS`` labelled texts and ``SAMPLE_BYTES`` of text of
each class (documented bounds, so the sample that reaches the driver does not
grow); scoring takes every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import give_back, labelled_texts, slices, small_batches
from bulwark.llm.textkernel import Words, lower_ascii, mix, text_buffer

BUCKETS = 1 << 17
PER_CLASS, SAMPLE_BYTES = 4096, 16 << 20
COST, EPOCHS, SEED = 1.0, 12, 7
#: Every so many-th text of the sample is left to the logistic curve.
HOLD = 4

_KIND = np.zeros(256, dtype=np.uint64)  # 0: other punctuation
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
for _b in b".,;:":
    _KIND[_b] = 5
for _b in b"!?":
    _KIND[_b] = 6


def features(column: pa.Array) -> list[np.ndarray]:
    """Distinct bucket numbers (sorted) of each text."""
    buf, offsets = text_buffer(column)
    low = lower_ascii(buf)
    words = Words(buf, offsets)
    if len(words.starts) == 0:
        return [np.zeros(0, np.int64) for _ in range(len(offsets) - 1)]
    h = words.hashes(low)
    length = words.ends - words.starts
    capitals = np.add.reduceat(np.concatenate([(buf >= 65) & (buf <= 90), [False]]).astype(np.int64), np.stack([words.starts, words.ends], 1).ravel())[::2]
    first = np.zeros(len(h), dtype=bool)
    first[words.first[:-1][words.first[:-1] < len(h)]] = True
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    shape = _KIND[buf[words.starts]] + 7 * _KIND[buf[words.ends - 1]]
    shape = shape * 8 + np.minimum(np.log2(length) * 2, 7).astype(np.uint64)
    shape = (shape * 2 + (2 * capitals > length)) * 2 + same
    shape = mix(shape.astype(np.uint64) + np.uint64(1))

    def pair(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
        return mix(x * np.uint64(3) + y * np.uint64(5) + np.uint64(salt))

    # the n-gram that ends at word i; those that would reach into the text before fall back to shorter ones
    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[0], out[1:] = 0, x[:-1]
        out[first] = 0
        return out

    shape2 = pair(before(shape), shape, 11)
    grams = np.stack([mix(h + np.uint64(1)), pair(before(h), h, 2), mix(shape + np.uint64(3)), shape2, pair(before(before(shape)), shape2, 13)], 1)
    at = (grams >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        mine = at[a:b].ravel()
        if len(mine) < 4000:
            out.append(np.unique(mine))
        else:
            flags = np.zeros(BUCKETS, dtype=bool)
            flags[mine] = True
            out.append(np.flatnonzero(flags))
    return out


@dataclass(frozen=True)
class Model:
    """weights: one per bucket, the log-count ratio already in; scale: squared ratios, for unit length."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, buckets: np.ndarray) -> float:
        r = self.ratios[buckets]
        norm = float(np.sqrt(r @ r))
        return float(self.weights[buckets].sum()) / norm + self.bias if norm > 0 else self.bias

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.shift, -30, 30))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss machine; rows are (positions, values), y is +1 or -1."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method on slightly smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margins).sum() + 1e-3 * a, g.sum()])
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-8:
            break
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: sorted bucket numbers; labels: 0 or 1.  One class only (or none) gives the share of that class."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = 0.5 if len(y) == 0 else (len(y) * (y[0] > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    hold = np.arange(len(y)) % HOLD == HOLD - 1 if min((y > 0).sum(), (y < 0).sum()) >= 2 * HOLD else np.zeros(len(y), bool)
    use = np.flatnonzero(~hold)
    counts = {c: np.ones(BUCKETS) for c in (1.0, -1.0)}
    for i in use:
        counts[y[i]][rows[i]] += 1
    ratios = np.log((counts[1.0] / counts[1.0].sum()) / (counts[-1.0] / counts[-1.0].sum()))

    # one block of values for all texts; the rows below are views of it
    ends = np.cumsum([len(rows[i]) for i in use])
    values = np.empty(ends[-1] if len(ends) else 0, dtype=np.float32)
    parts = []
    for i, end in zip(use, ends, strict=True):
        v = values[end - len(rows[i]) : end]
        v[:] = ratios[rows[i]]
        n = np.sqrt(v @ v)
        if n > 0:
            v /= n
        parts.append((rows[i], v))

    n_pos, n_neg = (y[use] > 0).sum(), (y[use] < 0).sum()
    cost = np.where(y[use] > 0, COST * len(use) / (2 * n_pos), COST * len(use) / (2 * n_neg))
    w, bias = dual_coordinate_descent(parts, y[use], cost)
    plain = Model(w * ratios, ratios, bias, 1.0, 0.0)
    at = np.flatnonzero(hold) if hold.any() else use
    slope, shift = logistic(np.array([plain.margin(rows[i]) for i in at]), y[at])
    return Model(plain.weights, ratios, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text") -> Model:
    """Fit on the sample that ``labelled_texts`` takes: at most PER_CLASS texts and SAMPLE_BYTES of text of each class.

    Executors turn whole texts into bucket numbers; the driver gets those, at
    most two for each byte of the sample.  Without labels, every text gets the
    same score; a label without a text counts nowhere.
    """
    small_batches(docs.sparkSession)
    texts = labelled_texts(docs, labels, label, PER_CLASS, SAMPLE_BYTES, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = pa.array([x.astype(np.int32) for x in features(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("label"), batch.column("rank"), lists], names=["name", "label", "rank", "buckets"])

    named = texts.select(F.col("doc_id").cast("string").alias("name"), "label", "rank", "text")
    found = named.mapInArrow(run, "name string, label int, rank long, buckets array<int>").toArrow()
    # the lists stay in one Arrow buffer; rows are views of it, in the order of the ranks
    lists = found["buckets"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    y = found["label"].to_numpy()
    order = sorted(range(len(y)), key=list(zip(found["rank"].to_pylist(), found["name"].to_pylist(), strict=True)).__getitem__)
    model = fit([flat[at[k] : at[k + 1]] for k in order], y[order] if order else np.zeros(0))
    del found, lists, flat, at
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into`` (0 to 1) to every row; a column of that name is replaced.

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
            scores = pa.array([fitted.score(x) for x in features(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, into])

    return source.mapInArrow(run, schema)
