"""The registered queries of the operators: thin, with production parameters.

Each query applies its operator to the whole table and derives the digest columns
from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontam, filteraudit, gracededup, langid, linededup, merkle, quality, sharding, simhash, suffix, tokenbin,
               urlfilter)
from .common import table
from .sql import AUDIT_SQL, DEDUP_SQL, MANIFEST_SQL

QUERIES = {}
ORACLE: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "op12_exact_dedup": DEDUP_SQL, "op13_merkle_manifest": MANIFEST_SQL}

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    held = F.coalesce(held, F.lit(False))
    rows = langid.sample(docs.where(~held), "doc_id", "text", "lang", max_train=1000, per_text=20_000)
    found = langid.predict(docs, "doc_id", "text", langid.train(rows))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=3, seed=42)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenbin.write(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read(spark, folder).select(
        F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), "doc_id", "text", "lang",
                         public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text", shards=16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), "page_id", "url", "html", RULES).withColumnRenamed("id", "page_id")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"A": filteraudit.few_words(50), "B": filteraudit.repetitive(65), "C": filteraudit.many_of("A-Z", 5),
               "D": filteraudit.holds_any("#$%&*|"), "E": filteraudit.EARLIER_COPY}
    return filteraudit.audit(table(spark, sf_dir, "documents"), "doc_id", "text", "source", filters,
                             table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, F.col("toxic") == 1)


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gracededup.group(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.when(even, merkle.leaf([*map(F.col, fields[:-1]), cut]))
    rows = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", fields, tampered))
    return rows.select(F.col("id").alias("doc_id"), *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
                       "proof_sha256", F.lower(F.hex("folded_root")).alias("folded_root"), "verified")
