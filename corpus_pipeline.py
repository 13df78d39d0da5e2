"""A training-data pipeline: five stages over ``documents``, each one operator.

Stages, in order: quality rules (rejected documents go), line dedup (later
matches go), SimHash near-dedup (one document of each group stays), benchmark
decontamination (documents with benchmark passages go), byte-level BPE encoding.
All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import bpe, decontam, linededup, quality, simhash
from gridlens.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, "text", "lang", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                        public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.apply(docs, "doc_id", "text")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each component; of rows with equal ids, the first by text."""
    return simhash.keep_one(docs, "doc_id", "text", shingle=3, radius=3, seed=42)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids as packed 32-bit integers."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.round_trip(docs, "doc_id", "text", path, pattern)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SimHash components, set-similarity joins and BPE have no SQL form; tests/llm
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
