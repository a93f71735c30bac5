"""Shared helpers: table access, shared-folder checkpoints, Arrow slicing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.plans.ship import ship

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Ranks of labelled rows are drawn by this hash seed.
SAMPLE_SEED = 20_011


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a temporary one only in local mode without one (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="bulwark-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = 1024) -> None:
    """Ready the session for Arrow over texts: fewer rows per batch (Spark bounds batches by rows, and texts may be long), and the package shipped."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > most or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system: idle Python workers live on next to the executor's other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of the column ``text`` (or one row)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learned: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, none of them held out.

    Ids are taken in the order of a seeded hash, so the sample is the same on
    every run and at every partitioning.  Repeated labels of one id count once
    (the largest); null ids and null labels are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64(F.lit(SAMPLE_SEED), "doc_id"))
    )
    picked = [known.where(F.col("label") == c).orderBy("rank", "doc_id").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, text: str = "text") -> DataFrame:
    """(doc_id, label, rank, text): the bounded sample of labelled texts that a classifier is fitted on.

    The ids of ``training_labels``; of each class, in the order of their rank,
    those whose texts take ``most_bytes`` together (a text that would exceed
    them is left out).  Of differing texts of one id, the one with the smallest
    hash counts, and it counts once; so the sample does not depend on the order
    or the partitioning of the rows.  Null texts are empty.
    """
    spark = docs.sparkSession
    # both tables have at most 2 * per_class rows
    sample = training_labels(labels, label, per_class)
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.select("doc_id", value.alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "rank", "text", F.xxhash64("text").alias("h"))
    one = found.groupBy("doc_id", "label", "rank").agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("m"))
    sizes = one.select("doc_id", "label", "rank", "m.h", "m.n").toArrow()
    order = sorted(range(sizes.num_rows), key=lambda k: (sizes["rank"][k].as_py(), str(sizes["doc_id"][k].as_py())))
    left, take = {0: most_bytes, 1: most_bytes}, []
    for k in order:
        n, c = sizes["n"][k].as_py(), sizes["label"][k].as_py()
        if n <= left[c]:
            left[c] -= n
            take.append(k)
    picked = spark.createDataFrame(sizes.take(pa.array(take, pa.int64())).select(["doc_id", "label", "rank", "h"]))
    rows = docs.select("doc_id", value.alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "h"])
    return rows.groupBy("doc_id", "label", "rank").agg(F.first("text").alias("text"))
