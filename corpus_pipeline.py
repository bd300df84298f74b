"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet below the shared checkpoint folder and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.llm import byte_bpe, mixing, near_dup, quality, secrets
from sensorframe.llm.common import stored, table
from sensorframe.llm.queries import VOCABULARY
from sensorframe.session import ship_packages


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this table, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return near_dup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``ids``, and whether the ids decode to the text."""
    model = byte_bpe.serialise_model(byte_bpe.read_ranks(VOCABULARY))
    kept = ["doc_id", "source", "_digest"]
    rows = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = byte_bpe.round_trip(rows, model, public_tokenizers.PATTERN, kept)
    return coded.select("doc_id", "source", "n_tokens", "ids",
                        (F.col("decoded_sha256") == F.col("_digest")).alias("round_trip"))


STAGES = [("quality classifier", good_documents), ("near duplicates", distinct_documents),
          ("secret scan", without_secrets), ("source mix", mixed_sources), ("byte-level BPE", token_ids)]
#: A trained classifier and exact similarity components are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``."""
    ship_packages(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
