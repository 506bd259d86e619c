"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, BPE.

Every stage is written as Parquet to the shared checkpoint folder and read
again as the next one's input. All stages but the last return the columns of
documents; the last adds the token ids, their number and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.llm import bpe, line_dedup, mixing, simhash, toxicity
from herbaria.llm.common import scratch, table
from herbaria.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _documents(scored.filter("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines taken out; n_chars follows the text, a null text keeps its n_chars."""
    out = line_dedup.line_dedup(_documents(docs))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _documents(out.withColumn("n_chars", changed))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return _documents(simhash.keep_one(_documents(docs), n_words=4, max_bits=4))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.emit(mixing.mix(_documents(docs), ["doc_id"]), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again for the digest."""
    return bpe.with_digests(bpe.bpe_round_trip(_documents(docs), vocabulary())).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: MinHash, SimHash and BPE stages cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
