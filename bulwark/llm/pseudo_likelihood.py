"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every word is a token of its own, known by its full 64-bit hash; an aggregate
over the cluster counts them all.  The ``SINGLE`` most frequent words are classes
of their own; all others fall into classes by their ending (the last two bytes
before punctuation), which says much about language and part of speech: frequent
endings have a class each, all rarer ones share the last.

    P(word | both sides) = P(class | both sides) * P(word | class).

The first factor is a small network: embeddings of the three words on either
side, one tanh layer, a softmax; the most frequent words have inputs of their
own, others that of their ending.  The second comes from counts over all
documents, each document without itself: a masked word must not be predicted
from its own occurrence, so a word that no other document has counts as unseen.
Counts of rare words stay on the cluster and are joined back to the texts that
have them.  A document's score is the sum of the conditional log-probabilities of
all its words, each with the word itself masked and everything else given.

Training goes over every word of every distinct text.  Texts are dealt to shards
of about ``SHARD_WORDS`` words by their hash; every shard starts from the same
seeded weights and takes one pass of adaptive gradient steps over its texts in
the order of their hashes, and the weights are averaged, each shard weighing as
its number of words (parameter mixing), in fixed-point numbers.  So the result
depends neither on the partitioning nor on the order of the rows.  What reaches
the driver is one number per weight, the ``FREQUENT`` most frequent words and the
counts of endings (at most 257 x 257).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import materialise, slices, small_batches
from bulwark.llm.kneser_ney import Lookup
from bulwark.llm.textkernel import Words, lower_ascii, text_buffer

#: Words whose counts go to every task; the counts of all others are joined.
FREQUENT = 1 << 16
#: Classes of words, and how many of them are one word each.
CLASSES, SINGLE = 128, 40
#: Inputs of the network (0: no word), and how many of them are one word each.
INPUTS, OWN = 512, 300
WIDTH, HIDDEN = 8, 16
BATCH, RATE, SEED = 2048, 0.08, 5
#: Words of one shard, and of one shuffled chunk of a shard.
SHARD_WORDS, CHUNK_WORDS = 2_000_000, 200_000
#: Added to every count of a word within its class.
ADDED = 0.1
FIXED = 1 << 24
_OFFSETS = (-3, -2, -1, 1, 2, 3)
SIDES = len(_OFFSETS)
ENDINGS = 257 * 257
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63, 93, 95]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, their endings, first): words first[i]:first[i + 1] are row i's."""
    buf, offsets = text_buffer(column)
    low = lower_ascii(buf)
    words = Words(low, offsets)
    end = words.ends.copy()
    for _ in range(3):
        end -= (end - words.starts > 1) & _PUNCTUATION[low[end - 1]]
    last = low[end - 1].astype(np.int64) + 1 if len(end) else np.zeros(0, np.int64)
    before = np.where(end - words.starts > 1, low[np.maximum(end - 2, 0)].astype(np.int64) + 1, 0) if len(end) else last
    return words.hashes(low), last * 257 + before, words.first


def _ranked(counts: np.ndarray, most: int) -> np.ndarray:
    """Place of each ending among the ``most`` frequent ones; -1 for others and for those that do not occur."""
    order = np.argsort(-counts, kind="stable")[:most]
    out = np.full(ENDINGS, -1, np.int64)
    out[order] = np.where(counts[order] > 0, np.arange(len(order)), -1)
    return out


class Vocabulary:
    """The most frequent words in falling order of their counts (all others have rank -1), and what becomes of endings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, endings: np.ndarray, ending_counts: np.ndarray, ending_types: np.ndarray):
        """counts, endings: of the words in ``keys``; ending_counts, ending_types: occurrences and distinct words of each ending, over all words."""
        self.lookup, self.word_counts = Lookup(keys), counts.astype(float)
        single, own = slice(0, SINGLE), slice(0, OWN)
        rest = ending_counts - np.bincount(endings[single], weights=counts[single], minlength=ENDINGS)
        types = ending_types - np.bincount(endings[single], minlength=ENDINGS)
        place = _ranked(rest, CLASSES - SINGLE - 1)
        self.ending_class = np.where(place >= 0, SINGLE + place, CLASSES - 1)
        place = _ranked(ending_counts - np.bincount(endings[own], weights=counts[own], minlength=ENDINGS), INPUTS - OWN - 2)
        self.ending_input = np.where(place >= 0, 1 + OWN + place, INPUTS - 1)
        self.totals = np.bincount(self.ending_class, weights=rest, minlength=CLASSES)
        self.totals[: len(counts[single])] += counts[single]
        #: Distinct words of each class, and one for all that were never seen.
        self.types = np.bincount(self.ending_class, weights=types, minlength=CLASSES) + 1
        self.types[: len(counts[single])] += 1

    def ranks(self, token: np.ndarray) -> np.ndarray:
        return self.lookup.rows(token)

    def classes(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < SINGLE), rank, self.ending_class[ending])

    def inputs(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < OWN), 1 + rank, self.ending_input[ending])


def around(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Input ids of the words around each word; 0 stands for no word (beyond the text)."""
    n = len(ids)
    out = np.zeros((n, SIDES), dtype=np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, d in enumerate(_OFFSETS):
        if abs(d) < n:
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            out[a, k] = np.where(row[a] == row[b], ids[b], 0)
    return out


class Network:
    """Weights in one flat vector, so that they average as one."""

    SHAPES = {"embed": (INPUTS, WIDTH), "w1": (SIDES * WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(SEED)
            flat = (rng.standard_normal(self.SIZE) * 0.1).astype(np.float32)
        self.flat = np.array(flat, dtype=np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def forward(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.embed[ctx].reshape(len(ctx), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return x, h, z

    def log_probability(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, z = self.forward(ctx)
        return z[np.arange(len(z)), target] - np.log(np.exp(z).sum(axis=1))

    def step(self, ctx: np.ndarray, target: np.ndarray, memory: np.ndarray) -> None:
        x, h, z = self.forward(ctx)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(z)), target] -= 1
        z /= len(z)
        gh = (z @ self.w2.T) * (1 - h * h)
        gx = (gh @ self.w1.T).reshape(-1, WIDTH)
        ids = ctx.ravel()
        embed = np.stack([np.bincount(ids, weights=gx[:, k], minlength=INPUTS) for k in range(WIDTH)], 1)
        grad = np.concatenate([embed.ravel(), (x.T @ gh).ravel(), gh.sum(0), (h.T @ z).ravel(), z.sum(0)]).astype(np.float32)
        memory += grad * grad
        self.flat -= RATE * grad / (np.sqrt(memory) + 1e-6)


class _Shard:
    """One pass over the texts of a shard, chunk by chunk."""

    def __init__(self, number: int):
        self.number = number
        self.net, self.memory = Network(), np.full(Network.SIZE, 1e-8, np.float32)
        self.seen = self.chunks = self.held = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, classes: np.ndarray) -> None:
        self.parts.append((ids, classes))
        self.held += len(ids)
        if self.held >= CHUNK_WORDS:
            self.learn()

    def learn(self) -> None:
        if self.held:
            ids, target = (np.concatenate([p[k] for p in self.parts]).astype(np.int64) for k in (0, 1))
            ctx = around(ids, np.concatenate([[0], np.cumsum([len(p[0]) for p in self.parts])]))
            # neighbours in a text say nearly the same: a step takes words from all over the chunk
            order = np.random.default_rng([SEED, self.number, self.chunks]).permutation(len(ids))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                self.net.step(ctx[pick], target[pick], self.memory)
            self.seen += len(ids)
            self.chunks += 1
        self.parts, self.held = [], 0

    def weighed(self) -> np.ndarray:
        """Weights times words, and the words, as whole numbers."""
        self.learn()
        return np.append(np.round(self.net.flat.astype(float) * FIXED).astype(np.int64) * self.seen, self.seen)


@dataclass(frozen=True)
class Model:
    """flat: network weights; counts: how often each class occurs in the corpus; words (h, e, n): ending and count of each word."""

    flat: np.ndarray
    vocabulary: Vocabulary
    words: DataFrame

    @property
    def counts(self) -> np.ndarray:
        return self.vocabulary.totals


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, e, n): hash, ending and count of every distinct word of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            token, ending, _ = tokens(batch.column("text"))
            h, at, n = np.unique(token, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ending[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "e", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, e int, n long").groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text") -> Model:
    """One count over all rows and one pass over all distinct texts; an empty table gives the seeded weights and no counts."""
    small_batches(docs.sparkSession)
    words = materialise(count_words(docs, text))
    by_ending = words.groupBy("e").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toArrow()
    counts, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    counts[by_ending["e"].to_numpy()], types[by_ending["e"].to_numpy()] = by_ending["n"].to_numpy(), by_ending["types"].to_numpy()
    top = words.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    vocabulary = Vocabulary(top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64), top["e"].to_numpy().astype(np.int64), counts, types)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    shards = max(1, -(-int(counts.sum()) // SHARD_WORDS))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Inputs (two bytes a word), then classes (one byte): half of the text, and all that the network sees."""
        known = shared.value
        for batch in slices(batches, "text"):
            token, ending, first = tokens(batch.column("text"))
            rank = known.ranks(token)
            ids, classes = known.inputs(rank, ending).astype("<u2"), known.classes(rank, ending).astype(np.uint8)
            codes = [ids[a:b].tobytes() + classes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(codes, pa.binary())], names=["h", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard = np.zeros(Network.SIZE + 1, np.int64), None
        for batch in batches:
            for number, code in zip(batch.column("shard").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        total += shard.weighed()
                    shard = _Shard(number)
                if n := len(code) // 3:
                    shard.add(np.frombuffer(code, "<u2", n), np.frombuffer(code, np.uint8, n, 2 * n))
        if shard is not None:
            total += shard.weighed()
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).where(F.length("text") > 0)
    codes = texts.mapInArrow(coded, "h long, code binary").groupBy("h").agg(F.first("code").alias("code"))
    dealt = codes.select("code", "h", F.pmod("h", F.lit(shards)).alias("shard")).repartition("shard").sortWithinPartitions("shard", "h")
    sums = dealt.select("code", "shard").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # one row per weight
    found = {r["i"]: int(r["v"]) for r in sums}
    flat = np.array([found[i] / found[Network.SIZE] / FIXED for i in range(Network.SIZE)]) if found else Network().flat
    return Model(flat.astype(np.float32), vocabulary, words)


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums by row, each in the order of its values (zeros, not integers, where there is nothing to sum)."""
    return np.bincount(row, weights=values, minlength=rows).astype(float)


def _by_row(row: np.ndarray, what: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, what, how often) of the distinct pairs."""
    pair, n = np.unique(row * many + what, return_counts=True)
    return pair // many, pair % many, n


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds n_words, log_likelihood (natural; 0 for a text without words) and n_unseen (words that no other document has) to every row.

    Such columns are replaced; ``keep`` names the columns to return (all by
    default).  Rows are taken as part of the counted corpus: their own words are
    left out of the counts.  Repeated rows are documents of their own, null texts
    empty ones; a text of any length is scored whole.
    """
    added = ("n_words", "log_likelihood", "n_unseen")
    small_batches(docs.sparkSession)
    source = docs.drop(*added)
    names = list(source.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.flat, model.vocabulary))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*names).schema] + ["n_words long", "__sum double", "__unseen long", "__rare array<struct<h:long,own:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known = shared.value
        net = Network(flat)
        for batch in slices(batches, text):
            token, ending, first = tokens(batch.column(text))
            rows = len(first) - 1
            row = np.repeat(np.arange(rows), np.diff(first))
            rank = known.ranks(token)
            ctx, target = around(known.inputs(rank, ending), first), known.classes(rank, ending)
            each = np.zeros(len(token))
            for k in range(0, len(token), 4 * BATCH):
                s = slice(k, k + 4 * BATCH)
                each[s] = net.log_probability(ctx[s], target[s])
            total = _sums(row, each, rows)
            at, cls, own = _by_row(row, target, CLASSES)
            total -= _sums(at, own * np.log(np.maximum(known.totals[cls] - own, 0) + ADDED * known.types[cls]), rows)
            often = rank >= 0
            at, word, own = _by_row(row[often], rank[often].astype(np.int64), FREQUENT)
            left = np.maximum(known.word_counts[word] - own, 0)
            total += _sums(at, own * np.log(left + ADDED), rows)
            unseen = _sums(at, own * (left == 0), rows)
            # words with counts elsewhere: row by row, each once
            order = np.lexsort((token[~often], row[~often]))
            at, word = row[~often][order], token[~often][order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (word[1:] != word[:-1])
            begin = np.flatnonzero(new)
            own = np.diff(np.append(begin, len(at))).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at[begin], minlength=rows))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(word[begin].view(np.int64)), pa.array(own)], names=["h", "own"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(first)), pa.array(total), pa.array(unseen.astype(np.int64)), rare], names=[*names, "n_words", "__sum", "__unseen", "__rare"])

    # kept on disk, as the numbers of rows must not change between the two sides of the join
    rows = materialise(source.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    left = F.greatest(F.coalesce("n", F.lit(0)) - F.col("own"), F.lit(0))
    rare = rows.select("__row", F.inline("__rare")).join(model.words.select("h", "n"), "h", "left")
    found = rare.groupBy("__row").agg(F.sum(F.col("own") * F.log(left + ADDED)).alias("__found"), F.sum(F.when(left == 0, F.col("own")).otherwise(0)).alias("__new"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(found, "__row", "left").select(*names, "n_words", (F.col("__sum") + zero("__found")).alias("log_likelihood"), (F.col("__unseen") + zero("__new")).alias("n_unseen"))
