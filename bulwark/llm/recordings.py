"""Fingerprint columns for recordings, and the search of a query set among all of them."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.chroma import RATE, fingerprint
from bulwark.llm.common import materialise, small_batches

#: Query fingerprints that are broadcast at once, and rows that meet them at once.
QUERY_BLOCK, ROW_BLOCK = 512, 512
#: A match differs in at most this share of bits over at least so many positions.
MOST_ERROR, LEAST_OVERLAP = 0.25, 8


def decode_wav(data: bytes) -> np.ndarray:
    """Mono samples (-1 to 1) at RATE of an uncompressed WAV file; broken files give none."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            wide, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}.get(wide)
    if kind is None or not rate:
        return np.zeros(0, np.float32)
    x = np.frombuffer(raw[: len(raw) // (wide * channels) * wide * channels], dtype=kind).astype(np.float32)
    x = (x - 128) / 128 if wide == 1 else x / float(1 << (8 * wide - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * (rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x


def samples_of(value: object) -> np.ndarray:
    """PCM samples of a cell: WAV bytes or a list of numbers; null gives none."""
    if value is None:
        return np.zeros(0, np.float32)
    if isinstance(value, (bytes, bytearray)):
        return decode_wav(bytes(value))
    return np.array([0.0 if v is None else v for v in value], dtype=np.float32)


def with_fingerprints(df: DataFrame, id_column: str, media: str, listen: Callable[[object], np.ndarray] = samples_of) -> DataFrame:
    """(id, items array<long>, cls): packed integers of each row's recording, and a digest of them.

    ``listen`` turns a cell into samples.  Null, broken and short media have no items.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(listen(v)) for v in batch.column("media").to_pylist()]
            items = pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))
            cls = pa.array([hashlib.sha256(f.tobytes()).hexdigest()[:32] if len(f) else None for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), items, cls], names=["id", "items", "cls"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(run, "id long, items array<long>, cls string")


def align(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit error, offset) of every row against every query; rows and queries each of one length.

    The offset is the one for which most 16-bit halves agree; ties go to the
    lower bit error, then to the first.  Too short an overlap gives an error of 1.
    """
    n, m = rows.shape[1], queries.shape[1]
    best = np.full((len(rows), len(queries)), -np.inf, dtype=np.float32)
    error, offset = np.ones(best.shape, np.float32), np.zeros(best.shape, np.int32)
    for d in range(LEAST_OVERLAP - m, n - LEAST_OVERLAP + 1):
        low, high = max(0, d), min(n, m + d)
        x = rows[:, None, low:high] ^ queries[None, :, low - d : high - d]
        halves = ((x & np.uint32(0xFFFF)) == 0).sum(axis=2) + ((x >> np.uint32(16)) == 0).sum(axis=2)
        wrong = np.bitwise_count(x).sum(axis=2, dtype=np.int32) / np.float32(32 * (high - low))
        vote = (halves - wrong).astype(np.float32)
        better = vote > best
        best[better], error[better], offset[better] = vote[better], wrong[better], d
    return error, offset


def search(prints: DataFrame, is_query: Column) -> DataFrame:
    """(id, n_items, class_id, match_id, offset, bit_error, n_matches), one row per row of ``prints``.

    Queries are the rows where ``is_query`` holds; every row is held against
    every query.  Rows of equal fingerprints are one class (class_id: its
    smallest id) and are searched once.  match_id is the best query other than
    the row: a query of the same class (error 0), else the one of lowest error
    (smallest id if tied) within the limits; n_matches counts the classes of
    queries, other than the own, within them.  Rows without items match nothing.
    Query classes pass the driver in blocks of QUERY_BLOCK, never all at once.
    """
    prints = materialise(prints.withColumn("query", F.when(is_query, F.col("id"))))
    named = prints.where("cls is not null")
    classes = named.groupBy("cls").agg(F.min(F.struct("id", "items")).alias("m"), F.min("query").alias("query"), F.max("query").alias("query2"))
    classes = materialise(classes.select("cls", F.col("m.id").alias("class_id"), "m.items", "query", "query2"))
    found = None
    for block in batched(classes.where("query is not null").select("cls", "query", "items").orderBy("query").toLocalIterator(), QUERY_BLOCK, strict=False):
        hits = _against(classes, [(r["cls"], r["query"], r["items"]) for r in block])
        hits = materialise(hits if found is None else _merge(found.unionByName(hits)))
        found = hits
    empty = "match_id long, offset int, bit_error double, n_matches long"
    if found is None:
        found = prints.sparkSession.createDataFrame([], f"cls string, {empty}")
    best = materialise(classes.drop("items").join(found, "cls", "left"))
    own = F.when(F.col("query") != F.col("id"), F.col("query")).when(F.col("query2") != F.col("id"), F.col("query2"))
    out = prints.select("id", "items", "cls").join(best, "cls", "left").withColumn("own", own)
    return out.select(
        "id", F.size("items").cast("long").alias("n_items"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("own", "match_id").alias("match_id"), F.when(F.col("own").isNotNull(), 0).otherwise(F.col("offset")).alias("offset"),
        F.when(F.col("own").isNotNull(), 0.0).otherwise(F.col("bit_error")).alias("bit_error"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def _merge(hits: DataFrame) -> DataFrame:
    best = F.min(F.struct("bit_error", "match_id", "offset")).alias("m")
    return hits.groupBy("cls").agg(best, F.sum("n_matches").alias("n_matches")).select("cls", "m.match_id", "m.offset", "m.bit_error", "n_matches")


def _against(classes: DataFrame, block: list[tuple[str, int, list[int]]]) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list[tuple[str, int, list[int]]]] = {}
        for q in shared.value:
            by_length.setdefault(len(q[2]), []).append(q)
        kinds = [([c for c, _, _ in qs], np.array([i for _, i, _ in qs]), np.array([x for _, _, x in qs], dtype=np.uint32)) for qs in by_length.values()]
        for batch in batches:
            names, items = batch.column("cls").to_pylist(), batch.column("items").to_pylist()
            groups: dict[int, list[int]] = {}
            for k, x in enumerate(items):
                groups.setdefault(len(x), []).append(k)
            out: list[tuple] = []
            for members in groups.values():
                for part in batched(members, ROW_BLOCK, strict=False):
                    rows = np.array([items[k] for k in part], dtype=np.uint32)
                    best: dict[int, tuple] = {}
                    for own, ids, queries in kinds:
                        error, offset = align(rows, queries)
                        at = {c: j for j, c in enumerate(own)}
                        for i, k in enumerate(part):
                            if names[k] in at:
                                error[i, at[names[k]]] = 1.0
                            good = np.flatnonzero(error[i] <= MOST_ERROR)
                            if len(good):
                                j = good[np.lexsort((ids[good], error[i, good]))[0]]
                                new = (float(error[i, j]), int(ids[j]), int(offset[i, j]))
                                old = best.get(k)
                                best[k] = (min(new, old[0]) if old else new, len(good) + (old[1] if old else 0))
                    out += [(names[k], b[1], b[2], b[0], n) for k, (b, n) in best.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds_out = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_out, strict=True)], names=["cls", "match_id", "offset", "bit_error", "n_matches"])

    return classes.select("cls", "items").mapInArrow(run, "cls string, match_id long, offset int, bit_error double, n_matches long")
