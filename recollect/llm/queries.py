"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, oracles, pages, pii, pseudo_likelihood, quality, ranked_search, secret_scan, simhash, telephony, token_files, toxicity
from .shared import scratch, text_or_empty, written

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: The id that ends a document in the token files.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch(spark, "tokens")
    token_files.write_store(table(spark, sf_dir, "documents"), store, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def padded(payload: Column) -> Column:
    """Bytes with zeros appended up to a positive multiple of 64."""
    missing = F.when(F.octet_length(payload) == 0, 64).otherwise(F.pmod(-F.octet_length(payload), F.lit(64)))
    return F.concat(payload, F.substring(F.unhex(F.lit("00" * 64)), F.lit(1), missing))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(text_or_empty(), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), padded(data).alias("sent"))
    stored = written(telephony.store_payloads(docs, F.col("sent"), F.lit(telephony.MU_LAW)).drop("sent"), "media")
    # the bytes of each text go through all three codecs
    out = telephony.decode_media(stored, keep_pcm=False, readings=(telephony.A_LAW, telephony.ADPCM))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    scored = quality.with_score(docs, machine).select("doc_id", quality.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= quality.GOOD).cast("int"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # a source is an owner, and each of its documents a repository of it
    found = secret_scan.scan(docs, F.col("source"), F.concat_ws("/", "source", "doc_id"), keep=["doc_id"])
    return secret_scan.digest(found)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "log_likelihood", "mean")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    scored = toxicity.with_score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", F.size("passages").alias("n_passages"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.TOXIC).cast("int"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pages": op2_pages,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_telephony": op7_telephony,
    "op8_secrets": op8_secrets,
    "op9_pii": op9_pii,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_toxicity": op11_toxicity,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": oracles.DECONTAMINATION,
    "op8_secrets": oracles.SECRETS,
    "op9_pii": oracles.PII,
    "op12_ranked_search": oracles.RANKED_SEARCH,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
