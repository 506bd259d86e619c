"""Readers (S-series). Formats are parameters; Avro and JDBC need their
connector jars on the classpath and are thin wrappers here (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.functions import scalars as S
from herbaria.operators import filters as FL

ID_LIST = T.ArrayType(T.LongType())


def scan_occurrences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bulk download scan; text columns get leading spaces stripped and blanks as NULL."""
    df = spark.read.format(fmt).load(path)
    return df.select(*[S.blank_to_null(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def scan_id_lists(spark: SparkSession, path: str, fmt: str = "parquet", text_cols: list[str] | None = None) -> DataFrame:
    """Pre-grouped id lists; text lists ``[1,2]`` (CSV) are parsed to array<bigint>."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = (reader.option("header", True).option("quote", '"').option("escape", '"')
                  .option("maxCharsPerColumn", -1))
    df = reader.load(path)
    for c in text_cols or []:
        df = df.withColumn(c, S.parse_ids(c))
    return df


def scan_table(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """Whole-table JDBC scan."""
    return spark.read.jdbc(url, table, properties=properties or {})


def scan_table_partitioned(spark: SparkSession, url: str, table: str, column: str, num_partitions: int,
                           properties: dict | None = None) -> DataFrame:
    """MIN/MAX bounds (one small aggregate pushed to the database), then
    ``num_partitions`` range scans."""
    props = properties or {}
    b = spark.read.jdbc(url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b",
                        properties=props).first()
    return spark.read.jdbc(url, table, column=column, lowerBound=int(b["lo"] or 0), upperBound=int(b["hi"] or 0) + 1,
                           numPartitions=num_partitions, properties=props)


def tolerant(spark: SparkSession) -> None:
    """Skip corrupt files; write very old dates without rebasing."""
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    spark.conf.set("spark.sql.avro.datetimeRebaseModeInWrite", "CORRECTED")
    spark.conf.set("spark.sql.parquet.datetimeRebaseModeInWrite", "CORRECTED")


def scan_download_tsv(spark: SparkSession, path: str, article_id: int) -> DataFrame:
    """Tab-separated download; id column ``gbifid`` or ``gbifID``; human
    observations dropped; distinct (article_id, occurrence_id)."""
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    idc = "gbifID" if "gbifID" in df.columns else "gbifid"
    if "basisOfRecord" in df.columns:
        df = df.filter(F.coalesce(F.col("basisOfRecord") != "HUMAN_OBSERVATION", F.lit(True)))
    return (df.select(F.lit(article_id).cast("bigint").alias("article_id"),
                      F.col(idc).try_cast("bigint").alias("occurrence_id"))
            .filter(F.col("occurrence_id").isNotNull()).dropDuplicates())


def claim_upload_rows(df: DataFrame, user_id: int, created_by: int) -> DataFrame:
    """Uploaded claim rows -> claims; action whitespace stripped, case kept.

    An accepted action makes a visible claim (``identified,recorded``
    normalised), whatever ``not_me`` says; otherwise ``not_me`` true makes a
    hidden claim without action; other rows are dropped."""
    from herbaria.functions import predicates as P
    have = {c.lower() for c in df.columns}
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    action = F.regexp_replace(text("action"), r"\s+", "")
    claimed = F.coalesce(action.isin(P.ALL_ACTIONS), F.lit(False))
    not_me = F.coalesce(F.lower(text("not_me")) == "true", F.lit(False))
    rows = df.select(F.col("gbifID").try_cast("bigint").alias("occurrence_id"), action.alias("action"),
                     claimed.alias("visible"), not_me.alias("not_me"))
    named = (F.when(F.col("action") == P.IDENTIFIED_RECORDED, F.lit(P.RECORDED_IDENTIFIED))
             .when(F.col("visible"), F.col("action")))
    return (rows.filter(F.col("occurrence_id").isNotNull() & (F.col("visible") | F.col("not_me")))
            .select(F.lit(user_id).cast("bigint").alias("user_id"), "occurrence_id", named.alias("action"), "visible",
                    F.lit(created_by).cast("bigint").alias("created_by")))


def scan_claim_upload(spark: SparkSession, path: str, user_id: int, created_by: int) -> DataFrame:
    """S8 from a CSV file (header required, ``gbifID`` required)."""
    df = spark.read.option("header", True).csv(path)
    if "gbifid" not in {c.lower() for c in df.columns}:
        raise ValueError("gbifID column is required")
    return claim_upload_rows(df, user_id, created_by)


def claim_pivot_rows(df: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(identifier, action, bracketed occurrence_ids) -> claim rows via an
    identifier -> user_id table."""
    rows = df.select("identifier", "action", F.explode(S.parse_ids("occurrence_ids")).alias("occurrence_id"))
    return rows.join(identifiers, "identifier").select("user_id", "occurrence_id", "action")


def source_id_rows(df: DataFrame) -> DataFrame:
    """agentIDs split on ``|`` or ``,``, trimmed, distinct, blanks dropped;
    both id lists exploded with their role."""
    ids = F.array_distinct(F.filter(F.transform(F.split("agentIDs", r"[|,]"), lambda x: F.trim(x)),
                                    lambda x: x != ""))
    base = df.select(ids.alias("ids"), "gbifIDs_recordedByID", "gbifIDs_identifiedByID")
    rec = base.select(F.explode("ids").alias("identifier"), F.explode("gbifIDs_recordedByID").alias("occurrence_id"),
                      F.lit("recorded").alias("role"))
    idn = base.select(F.explode("ids").alias("identifier"), F.explode("gbifIDs_identifiedByID").alias("occurrence_id"),
                      F.lit("identified").alias("role"))
    return rec.unionByName(idn)


def identifier_list(df: DataFrame, destroyed: DataFrame, col: str = "identifier") -> DataFrame:
    """Valid ORCID or Wikidata ids not destroyed."""
    ok = df.filter(S.is_orcid(col) | S.is_wiki_id(col))
    return ok.join(destroyed.select(F.col("identifier").alias(col)), col, "left_anti")


__all__ = ["scan_occurrences", "scan_id_lists", "scan_table", "scan_table_partitioned", "tolerant",
           "scan_download_tsv", "claim_upload_rows", "scan_claim_upload", "claim_pivot_rows", "source_id_rows",
           "identifier_list", "FL"]
