"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.llm import (bpe, embedding_dedup, fingerprints, hard_negatives, line_dedup, mixing, packing, pii, runs, simhash,
                          substring, toxicity, warc)
from herbaria.llm.common import cut, scratch, table
from herbaria.llm.oracle import HARD_NEGATIVES_SQL, MIXING_SQL, WARC_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one line kept of each component of similar lines."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label by cosine."""
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), 0.93)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digests(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by the mix of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    out = simhash.simhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), n_words=4, max_bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages after a round trip through WARC archives."""
    out = warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with detected personal data replaced by surrogates."""
    key = spark.conf.get("spark.surrogates.key", "a key for tests")  # a cluster names its secret there
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document after removing repeated passages."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprints.fingerprint_chain(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, below each of its positives."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, shifted)


def planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of about a tenth of the documents repeat one stretch of their words to the end."""
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        a = g % F.size(ws)
        p = 1 + F.floor((F.size(ws) - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    planted = F.transform(F.array(words), repeat)[0]  # one lambda variable holds the words, so they are split once
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and the text without their repeats."""
    docs = planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = runs.periodic_runs(docs, min_length=6, repeats=4)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best_run.start", "best_run.length", "best_run.period",
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_line_dedup, op2_embedding_dedup, op3_toxicity, op4_bpe, op5_mixing, op6_simhash_dedup, op7_warc, op8_pii,
    op9_substring_dedup, op10_fingerprints, op11_hard_negatives, op12_periodic_runs, op13_packing)}

ORACLE: dict[str, str] = {"op5_mixing": MIXING_SQL, "op7_warc": WARC_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL}
