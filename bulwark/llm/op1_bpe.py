"""Query op1: byte-level BPE over all documents, there and back."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bulwark.llm.bpe import encode_documents
from bulwark.llm.common import table
from bulwark.llm.registry import query


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The rank file as it lies with the public tokenizers (its size is fixed)."""
    return Path(public_tokenizers.path(name)).read_bytes()


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = encode_documents(docs, vocabulary(), public_tokenizers.PATTERN, tokens=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
