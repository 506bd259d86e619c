"""Data packages of all datasets (K17, job B8): tables, files, manifest, descriptors.

Every package table is written once for all datasets, into one folder per dataset.
Rows are dealt by dataset and Spark splits what is large, so a huge dataset becomes
many files written by many tasks and a small one a single file; no table is computed
twice to learn its size. Sizes and checksums are computed by executors from the files
as they lie in the shared folder; what reaches one row is a dataset's list of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.operators import packages as A

ROWS_PER_FILE = 1_000_000

#: Resources in the order of the descriptor; tables of the last two need source attributions.
RESOURCES = ["occurrences", "users", "attributions", "articles", "article-occurrences", "unascribed",
             "problem-collector-dates", "problem-determiner-dates", "users_unresolved", "missing-attributions"]
GATED = ["users_unresolved", "missing-attributions"]
# Names of licences in a descriptor.
LICENSE_NAMES = {"/zero/1.0/": "public-domain-dedication", "/by/4.0/": "cc-by-4.0", "/by-nc/4.0/": "cc-by-nc-4.0"}
# Keywords of every package.
KEYWORDS = ["specimen", "museum", "collection", "credit", "attribution"]


def package_tables(occurrences: DataFrame, claims: DataFrame, users: DataFrame, article_occurrences: DataFrame,
                   articles: DataFrame, dataset_counts: DataFrame) -> dict[str, DataFrame]:
    """The ten tables A1-A10 of every dataset, each with its datasetKey, by resource name."""
    attributions = A.attributions_table(occurrences, claims, users)
    shown = ["datasetKey", "user_id", "occurrence_id", "identifiedBy", "recordedBy", F.col("createdName").alias("createdBy"),
             F.col("createdBy").alias("createdByURI"), "createdDateTime", "modifiedDateTime"]
    missing = A.missing_attributions_table(attributions, occurrences, dataset_counts)
    unresolved = A.unresolved_users_table(occurrences, claims, dataset_counts)
    return dict(zip(RESOURCES, [
        A.occurrences_table(occurrences, claims), A.users_table(occurrences, claims, users), attributions.select(*shown),
        A.articles_table(occurrences, claims, article_occurrences, articles),
        A.citations_table(occurrences, claims, article_occurrences), A.not_them_table(occurrences, claims, users),
        A.problem_dates_table(occurrences, claims, users, "recorded"),
        A.problem_dates_table(occurrences, claims, users, "identified"),
        unresolved.withColumnRenamed("gbifID", "occurrence_id"), missing.select(*shown)]))


def write_table(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """CSV files per dataset, none with more than ``rows_per_file`` rows.

    Rows of a dataset meet in one task unless they are many: adaptive execution splits
    such a dataset by size over several tasks, each of which writes files of its own.
    """
    cells = [c for c in df.columns if c != "datasetKey" or "gbifID" in df.columns]  # only occurrences repeat the key in their rows
    rows = df.filter(F.col("datasetKey").isNotNull()).select(*cells, F.col("datasetKey").alias("dataset"))
    (rows.hint("rebalance", "dataset").write.mode("overwrite").partitionBy("dataset")
     .options(header=True, compression="gzip", escape='"', emptyValue="", maxRecordsPerFile=rows_per_file).csv(path))


def _dataset_of(path: Column) -> Column:
    """Dataset key of a file from its folder name, where Spark writes special characters as %XX."""
    raw = F.regexp_extract(path, r"/dataset=([^/]*)/", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A written table: its columns as text, and the dataset key and file of each row."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).options(header=True, escape='"', multiLine=True, recursiveFileLookup=True,
                                           pathGlobFilter="*.csv.gz").csv(path)
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # a URI, escaped once more
    return df.select("*", file.alias("file")).withColumn("dataset", _dataset_of(F.col("file")))


def manifest(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """(datasetKey, resource, file, bytes, hash) of the files of one table."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv.gz").load(path)
    return files.select(_dataset_of(F.col("path")).alias("datasetKey"), F.lit(resource).alias("resource"),
                        F.col("path").alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("hash"))


def build_packages(tables: dict[str, DataFrame], root: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write every table below ``root`` and return the manifest of all files."""
    found = []
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", rows_per_file)
        found.append(manifest(df.sparkSession, f"{root}/{name}", name))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def descriptors(files: DataFrame, datasets: DataFrame, dataset_counts: DataFrame) -> DataFrame:
    """(datasetKey, resources, files, bytes, descriptor): one JSON descriptor per dataset with a file.

    Tables without a row in a dataset are listed without files; the gated tables are
    listed only for datasets with source attributions.
    """
    order = F.create_map(*[x for i, r in enumerate(RESOURCES) for x in (F.lit(r), F.lit(i))])
    gated = dataset_counts.select("datasetKey", (F.col("source_attribution_count") > 0).alias("sourced"))
    per = files.groupBy("datasetKey", "resource").agg(
        F.array_sort(F.collect_list(F.struct(F.col("file").alias("path"), "bytes", "hash"))).alias("files"))
    keys = per.select("datasetKey").distinct().join(gated, "datasetKey", "left")
    wanted = keys.select("datasetKey", F.explode(F.array(*map(F.lit, RESOURCES))).alias("resource"), "sourced")
    wanted = wanted.filter(~F.col("resource").isin(GATED) | F.col("sourced")).drop("sourced")
    listed = wanted.join(per, ["datasetKey", "resource"], "left").groupBy("datasetKey").agg(
        F.array_sort(F.collect_list(F.struct(order[F.col("resource")].alias("at"), F.col("resource").alias("name"),
                                             F.coalesce("files", F.expr("cast(array() as array<struct<path:string,bytes:bigint,hash:string>>)")).alias("files"))))
        .alias("listed"))
    license_name = F.coalesce(*[F.when(F.col("license").contains(part), F.lit(name)) for part, name in LICENSE_NAMES.items()], F.lit(""))
    d = listed.join(datasets.select("datasetKey", "title", "license"), "datasetKey", "left")
    resources = F.transform("listed", lambda r: F.struct(
        r["name"].alias("name"), F.lit("csv").alias("format"), F.lit("gzip").alias("compression"), r["files"].alias("files")))
    body = F.struct(
        F.col("datasetKey").alias("id"), F.lit("tabular-data-package").alias("profile"),
        F.concat(F.lit("ATTRIBUTIONS MADE FOR: "), "title").alias("title"),
        F.array(F.struct(license_name.alias("name"), F.col("license").alias("path"))).alias("licenses"),
        F.array(*map(F.lit, KEYWORDS)).alias("keywords"), resources.alias("resources"))
    all_files = F.flatten(F.transform("listed", lambda r: r["files"]))
    return d.select("datasetKey", license_name.alias("license_name"), F.size("listed").cast("long").alias("resources"),
                    F.size(all_files).cast("long").alias("files"),
                    F.aggregate(all_files, F.lit(0).cast("long"), lambda s, f: s + f["bytes"]).alias("bytes"),
                    F.to_json(body).alias("descriptor"))
