"""Corpus pipeline: quality classifier, quality rules, near-duplicates, mixture, tokens.

Each stage takes all documents that its predecessor kept.  All but the last
return the columns of ``documents``; the last adds token ids, counts and digests.

In every stage: other columns of ``documents`` pass through unless a stage needs
their name (``n_words`` and the like are set aside while rules are judged, never
returned); texts of any length are worked on whole; repeated rows are rows like
any other; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.llm import mixture, nbsvm, near_duplicates, quality_rules
from bulwark.llm.bpe import encode_documents
from bulwark.llm.common import checkpoint_dir, table
from bulwark.llm.op1_bpe import vocabulary
from bulwark.llm.op2_quality_classifier import THRESHOLD


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go; null texts are scored as empty ones."""
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality")
    return nbsvm.score(docs, model, into="__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rule (null and empty texts do) or whose posterior quality is low."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("text"))
    return quality_rules.judge(whole).where("kept").select("__row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; rows without an id stay."""
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the blocks that the mix takes, so that sources meet their targets word by word.

    A document whose blocks are taken several times appears as often, each time
    with the words of the blocks that are taken once more; ``n_chars`` follows.
    Documents without words are not taken; null sources are one source.
    """
    return mixture.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digests of the round trip; null texts have none."""
    return encode_documents(docs, vocabulary(), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("MinHash near-dedup", deduplicate),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokenise),
]
#: No SQL expresses the trained classifier.  Tests hold the operators of the stages against brute force; of the whole they check columns and counts only.
ORACLE_SQL = None


def _written(docs: DataFrame, path: str) -> DataFrame:
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder, so that none runs twice.

    A stage's files are removed once the next one's are written; those of the
    last but one stay, as the result reads them.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _written(docs, f"{folder}/{k}")
            if k:
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    return docs.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")
