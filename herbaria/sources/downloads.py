"""Downloaded specimen lists of many articles, read in one scan (S7, job B10).

Every article has tab-separated files, named by download key. Their headers differ:
the id column is ``gbifID`` or ``gbifid``, and columns stand in any order. All files are
read as lines with the file each came from; the header lines, one per file, say where
the columns of their file are, and are joined back by file. So thousands of files are
one job, and a huge file is read in splits by many tasks. Small downloads may come in
bundles, files of many downloads whose lines each begin with the key of theirs; a
header then holds for the lines of its file and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID_COLUMN, BASIS_COLUMN = "gbifid", "basisofrecord"
DROPPED_BASIS = "HUMAN_OBSERVATION"  # fixed value


def _is_header(names: Column) -> Column:
    """A line that names the id column is a header; ids are numbers, so no row does."""
    return F.array_contains(F.transform(names, F.lower), ID_COLUMN)


def scan_downloads(spark: SparkSession, path: str, key_pattern: str = r"([^/]+)\.tsv[^/]*$", glob: str = "*.tsv*",
                   bundled: bool = False) -> DataFrame:
    """(key, occurrence_id), distinct, from all files below ``path`` that match ``glob``.

    ``key_pattern`` finds the download key in a file's path; in ``bundled`` files the key is
    the first cell of each line instead. Human observations, rows
    without a numeric id and files without an id column are left out; a file without
    a basis column keeps all its rows.
    """
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob).text(path)
    cells = lines.select(F.split("value", "\t").alias("cells"), F.col("_metadata.file_path").alias("file"))
    if bundled:
        rest = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
        cells = cells.select(rest.alias("cells"), "file", F.col("cells")[0].alias("key"))
    else:
        cells = cells.withColumn("key", F.regexp_extract("file", key_pattern, 1))
    header = _is_header(F.col("cells"))
    names = F.transform("cells", F.lower)
    headers = (cells.filter(header).groupBy("file", "key").agg(F.max(F.array_position(names, ID_COLUMN)).alias("id_at"),
                                                               F.max(F.array_position(names, BASIS_COLUMN)).alias("basis_at")))
    rows = cells.filter(~header).join(headers, ["file", "key"])
    at = lambda c: F.get("cells", (F.col(c) - 1).cast("int"))
    basis = F.when(F.col("basis_at") > 0, at("basis_at"))
    return (rows.filter(F.coalesce(basis != DROPPED_BASIS, F.lit(True)))
            .select("key", at("id_at").try_cast("bigint").alias("occurrence_id"))
            .filter("occurrence_id is not null").distinct())


def process_articles(articles: DataFrame, rows: DataFrame, occurrences: DataFrame, article_occurrences: DataFrame) -> dict[str, DataFrame]:
    """Links of articles not processed yet from their downloads, and the articles marked as processed.

    New links are added once; then links of these articles to occurrences that do not
    exist are taken out (J6), links of other articles stay as they are.
    """
    todo = articles.filter(~F.coalesce("processed", F.lit(False)))
    keys = todo.select(F.col("id").alias("article_id"), F.explode("gbif_downloadkeys").alias("key"))
    found = keys.join(rows, "key").select("article_id", "occurrence_id")
    ids = todo.select(F.col("id").alias("article_id"))
    mine = article_occurrences.join(ids, "article_id", "left_semi").select("article_id", "occurrence_id")
    linked = (mine.unionByName(found).distinct()
              .join(occurrences.select(F.col("gbifID").alias("occurrence_id")), "occurrence_id", "left_semi"))
    others = article_occurrences.join(ids, "article_id", "left_anti").select("article_id", "occurrence_id")
    return {"article_occurrences": others.unionByName(linked.select("article_id", "occurrence_id")),
            "articles": articles.withColumn("processed", F.lit(True))}


def write_downloads(rows: DataFrame, path: str) -> None:
    """Write downloads in bundles (a file per download would be a file per few lines), two header variants.

    ``rows`` holds key (without tabs), gbifID and basisOfRecord; read back with
    ``scan_downloads(spark, path, glob="*.txt", bundled=True)``. A download stands in one
    bundle, its header first; there are as many bundles as write tasks.
    """
    odd = F.pmod(F.xxhash64("key"), F.lit(2)) == 1
    line = F.when(odd, F.concat_ws("\t", F.col("gbifID"), F.col("basisOfRecord"))).otherwise(F.concat_ws("\t", F.col("basisOfRecord"), F.col("gbifID")))
    head = F.when(odd, F.lit("gbifid\tbasisOfRecord")).otherwise(F.lit("basisOfRecord\tgbifID"))
    text = rows.select("key", F.lit(1).alias("o"), line.alias("value")).unionByName(
        rows.select("key").distinct().select("key", F.lit(0).alias("o"), head.alias("value")))
    value = F.concat(F.coalesce("key", F.lit("")), F.lit("\t"), "value").alias("value")
    text.repartition("key").sortWithinPartitions("key", "o").select(value).write.mode("overwrite").text(path)
