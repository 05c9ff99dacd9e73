"""The corpus pipeline: documents in, encoded clean documents out. Each stage takes (spark, docs, sf_dir).

1. quality: rows that the factorisation machine scores below its threshold go; it is fitted on sf_dir's labels and the
   stage's own documents.
2. near copies: one document of each group of linked ones stays (five-word shingles, similarity 0.8 or more).
3. decontamination: documents that hold a benchmark item within its edit budget go.
4. secrets: each found secret is replaced by its kind; every document stays.
5. encoding: the byte-level BPE ids of each text, and whether they decode to it.

Empty tables pass through; null texts count as empty. Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, jaccard, quality, secrets
from lodestone.llm.common import Scratch
from lodestone.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: The classifier, the tokenizer and the compressor have no SQL form; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it keeps is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
