"""Near-duplicate documents: MinHash, odd sketches, exact confirmation.

A document is the set of hashes of its distinct word 5-grams.  Documents with
equal sets form a class, whose smallest id stands for it.  ``BANDS`` x ``ROWS``
MinHash values per class give band keys; classes that share a band key are
candidates (at a similarity of 0.85 a pair shares none of the keys with a
probability below 3e-7).  The MinHash samples are also folded into an odd sketch,
a parity bitmap: the population count of the XOR of two bitmaps estimates the
similarity, most precisely where it is high, and candidates far below the
threshold go.  A second parity bitmap folds the whole set: its XOR never counts
more than the symmetric difference, so it rules pairs out with certainty.  What
is left is confirmed on the full sets.

Groups are not expanded into all pairs.  Every member of a band bucket is held
against the bucket's smallest and largest id, and components are formed.  Then
members outside a bucket's largest component are held against its members of
other components, so that no link between components stays unseen.

Documents that share a long passage without being alike meet in large buckets,
all in components of their own.  Members of buckets above ``HOT`` that hold several
components are therefore dealt anew by prefix filtering, which is exact: under one order of all shingles,
rarest first, two linked sets share one of their first n - ceil(0.85 n) + 1
shingles.  Shared passages are frequent and come last, so they bring nobody
together.  The order follows counts in ``CELLS`` cells (it decides about cost
only).  Buckets of prefix shingles stay large where many unlike documents share
their rarest shingles; those are worked off in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.llm.common import materialise, slices, small_batches
from bulwark.llm.components import connected_components
from bulwark.llm.textkernel import Words, lower_ascii, mix, powers, shingle_hashes, text_buffer, whole_hash

WIDTH, PERCENT = 5, 85
BANDS, ROWS = 32, 6
SKETCH_WORDS = 16  # of 64 bits
PARITY_WORDS = 32
#: Members of the largest band bucket that is kept as it is, and cells of the shingle counts.
HOT, CELLS = 64, 1 << 18
#: Candidates whose estimate lies this far below the threshold go: more than five standard errors.
MARGIN = 0.15

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def sets_of(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted shingle set of each text; fewer words than ``width`` give one whole shingle, none give none."""
    buf, offsets = text_buffer(column)
    low = lower_ascii(buf)
    words = Words(low, offsets)
    hashes = words.hashes(low)
    shingles = shingle_hashes(hashes, width)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        else:
            out.append(whole_hash(hashes[a:b]) if b > a else shingles[:0])
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS minima per (non-empty) set."""
    flat, start = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])[:-1]
    out = np.empty((len(sets), len(_SEEDS)), dtype=np.uint64)
    for k in range(len(_SEEDS)):
        out[:, k] = np.minimum.reduceat((flat ^ _SEEDS[k]) * _FACTORS[k], start)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    folded = (mix(minima) * powers(ROWS)[np.arange(BANDS * ROWS) % ROWS]).reshape(len(minima), BANDS, ROWS)
    return mix(np.add.reduce(folded, axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64))


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmap of SKETCH_WORDS * 64 bits; each sample flips one bit."""
    bit = mix(minima ^ _SEEDS) % np.uint64(SKETCH_WORDS * 64)
    out = np.zeros((len(minima), SKETCH_WORDS), dtype=np.uint64)
    rows = np.repeat(np.arange(len(minima)), minima.shape[1])
    flips = np.uint64(1) << (bit.ravel() & np.uint64(63))
    np.bitwise_xor.at(out, (rows, (bit.ravel() >> np.uint64(6)).astype(np.int64)), flips)
    return out


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmap of PARITY_WORDS * 64 bits of each whole set; every member flips one bit."""
    bit = mix(np.concatenate(sets) ^ _SEEDS[0]) % np.uint64(PARITY_WORDS * 64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), PARITY_WORDS), dtype=np.uint64)
    np.bitwise_xor.at(out, (rows, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _longs(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel().view(np.int64)))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k0, k1, bands, odd, parity); k0, k1: 128 bits of the set; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = sets_of(batch.column("text"))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = [s for s in sets if len(s)]
            at = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), mask=n == 0)
            if full:
                minima = minhash(full)
                start = np.cumsum([0] + [len(s) for s in full])[:-1]
                flat = np.concatenate(full)
                keys = [np.add.reduceat(mix(flat ^ s), start).view(np.int64) for s in _SEEDS[:2]]
                found = [pa.array(keys[0]), pa.array(keys[1]), _longs(band_keys(minima)), _longs(odd_sketch(minima)), _longs(parity(full))]
                found = [x.take(at) for x in found]
            else:
                found = [pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *found], names=["doc_id", "n_shingles", "k0", "k1", "bands", "odd", "parity"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, k0 long, k1 long, bands array<long>, odd array<long>, parity array<long>")


def _flipped(left: str, right: str, words: int) -> Column:
    return sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(words)), F.lit(0))


def _estimate() -> Column:
    """Similarity by the odd sketches: the samples that differ, from the bits that differ."""
    bits = SKETCH_WORDS * 64
    share = F.least(2.0 * _flipped("odd_a", "odd_b", SKETCH_WORDS) / bits, F.lit(0.999))
    return 1 + bits / 2.0 * F.log(1 - share) / (2.0 * BANDS * ROWS)


def _plausible(percent: int) -> Column:
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # a link differs in at most (100 - percent) / (100 + percent) of both sizes
    near = (100 + percent) * _flipped("parity_a", "parity_b", PARITY_WORDS) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return size & near & (_estimate() >= percent / 100 - MARGIN)


_SKETCH = ("n_shingles", "odd", "parity")
_SHORT = {"n_shingles": "n", "odd": "odd", "parity": "parity"}


def _side(frame: DataFrame, s: str, *more: str) -> DataFrame:
    return frame.select(*more, F.col("id").alias(s), *[F.col(c).alias(f"{_SHORT[c]}_{s}") for c in _SKETCH])


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members (key, id, ...) of buckets with several components, with their part and the bucket's largest one, main."""
    at = members.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    tally = at.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = tally.groupBy("key").agg(F.max(F.struct("size", "part")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("m.part").alias("main"))
    return at.join(materialise(largest), "key")


def _between(mixed: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """(a, b): plausible pairs of one bucket but different components; a is outside the bucket's largest."""
    known = materialise(mixed.select("key", "id", "part", "main").join(slim, "id"))
    minor = _side(known.where("part <> main"), "a", "key", F.col("part").alias("part_a"))
    every = _side(known, "b", "key", "main", F.col("part").alias("part_b"))
    # two minor members meet once
    wanted = (minor["key"] == every["key"]) & (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main")) | (F.col("a") < F.col("b"))) & _plausible(percent)
    return minor.join(every, wanted).select("a", "b")


def _with_ends(members: DataFrame) -> DataFrame:
    """(id, key, low, high, n) of the members (id, key) of all buckets with two members or more, written."""
    ends = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(members.join(materialise(ends), "key").select("id", "key", "low", "high", "n"))


def rare_prefixes(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, key): the rarest shingles of each text of (doc_id, text), as many as a linked text must share one of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text"):
            for s in sets_of(batch.column("text")):
                np.add.at(cells, (s % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    often = np.zeros(CELLS, np.int64)
    often[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text"):
            ids, keys = [], []
            for i, s in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text")), strict=True):
                if len(s):
                    most = len(s) - -(-percent * len(s) // 100) + 1
                    keys.append(s[np.lexsort((s, known[(s % np.uint64(CELLS)).astype(np.int64)]))[:most]])
                    ids.append(np.full(len(keys[-1]), i, np.int64))
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(flat(ids, np.int64)), pa.array(flat(keys, np.uint64).view(np.int64))], names=["id", "key"])

    return texts.select("doc_id", "text").mapInArrow(first, "id long, key long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union; texts: (doc_id, text)."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            keep = []
            for i, (x, y) in enumerate(zip(sets_of(batch.column("text_a")), sets_of(batch.column("text_b")), strict=True)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links, itself included;
    kept marks it.  Null and empty texts, and rows without an id, link with
    nothing and stay.  Rows that repeat a doc_id are one document; all of them
    get its component.  Texts of any length are taken whole.  Other columns are
    ignored whatever their names; an empty table gives no rows.  doc_id has to
    be an integer column.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}; components are told by integer ids")
    small_batches(docs.sparkSession)
    marked = materialise(sketches(docs, text))
    members = marked.where("n_shingles > 0 and doc_id is not null")
    standing = F.min(F.struct("doc_id", *_SKETCH, "bands")).alias("m")
    # aggregates that meet a large side are written first: a hot key can then be split in the join
    classes = materialise(members.groupBy("k0", "k1").agg(standing).select("k0", "k1", F.col("m.doc_id").alias("id"), *[f"m.{c}" for c in _SKETCH], "m.bands"))
    linked = members.select("doc_id", "k0", "k1").join(classes.select("k0", "k1", "id"), ["k0", "k1"])
    same = linked.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    buckets = _with_ends(classes.select("id", F.explode("bands").alias("key")))
    ids = buckets.select("id").distinct()
    slim = materialise(classes.select("id", *_SKETCH).join(ids, "id", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = materialise(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))

    # members of a bucket against its ends
    first = buckets.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    first = first.join(_side(slim, "a"), "a").join(_side(slim, "b"), "b").where(_plausible(percent)).select("a", "b")
    links = materialise(confirm(first, texts, percent))
    # across components; members of hot buckets by their rare shingles
    parts = connected_components(links)
    mixed = materialise(_mixed(buckets.select("key", "id", "n"), parts))
    hot = mixed.where(F.col("n") > HOT).select(F.col("id").alias("doc_id")).distinct()
    if not hot.isEmpty():
        dealt = materialise(rare_prefixes(texts.join(hot, "doc_id", "left_semi"), percent).distinct())
        mixed = mixed.where(F.col("n") <= HOT).drop("n").unionByName(_mixed(dealt, parts))
    rest = materialise(confirm(_between(mixed, slim, percent), texts, percent))

    whole = connected_components(links.unionByName(rest).unionByName(same))
    out = marked.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
