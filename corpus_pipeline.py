"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, PII, SentencePiece; part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next stage's docs. All
but the last return the columns of documents; the last adds the piece ids.

Defined results: a document whose text is null or empty passes every stage as it is (its toxicity is that of "no segment", it
has no shingles, seeds or values; its ids are null or empty); of rows that share a doc_id each is kept or dropped by its own text
in the toxicity stage and by the doc_id in the dedup and decontamination stages; rows with a null doc_id are kept; empty
tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, near_dup, pii, sentencepiece, toxicity
from skein.llm._common import shared_dir, stored

#: Documents at or above this probability of a toxic label are rejected.
REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2, REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the smallest doc_id of a group stays."""
    found = near_dup.near_duplicates(docs, shingle=5, percent=80)
    gone = stored(found.where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs, key="doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: Scan statistics, sampled segmentations and components aren't expressible in SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None
