"""The corpus pipeline: documents go through five operators, each on all that the one before kept.

Every stage is written as Parquet and read again as the next one's documents. The toxicity stage
learns from the labels that the operator's own query may learn from; the last stage returns the
digests of every document's tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import bpe, mixing, neardup, pii, toxicity
from sparquill.llm.common import shared_dir, table

#: Similarity, in percent, from which documents are near-duplicates.
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity.remainder(F.col("doc_id")) != 0)
    return toxicity.score(docs.select(*COLUMNS), model, out="__toxicity").filter("__toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return neardup.drop_near_duplicates(docs.select(*COLUMNS), NEAR_PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the temperature mixture holds their document."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every row and of the bytes they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has no word for the learned and the hashed stages; tests/llm checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is kept in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
