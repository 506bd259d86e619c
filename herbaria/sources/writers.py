"""Writers (K1-K4): table writes and CSV exports; packages are in ``sources.packages``.

Writes go to folders (Parquet/CSV); a JDBC sink uses Spark's batched writer
(``batchsize``) with one connection per partition, which replaces the
hand-written batch loops of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import scalars as S


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """K1."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, partitions: int,
               batch_size: int = 1000, mode: str = "append") -> None:
    """K2: bounded number of connections, batched inserts."""
    props = dict(properties, batchsize=str(batch_size))
    df.coalesce(partitions).write.mode(mode).jdbc(url, table, properties=props)


def write_clustered(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """K3: rows sorted within partitions by ``keys`` before the write."""
    df.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def id_list_csv(df: DataFrame, cols: list[str]) -> DataFrame:
    """K4: array columns rendered as ``[1,2]``."""
    out = df
    for c in cols:
        out = out.withColumn(c, S.stringify_ids(c))
    return out


def write_id_list_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    id_list_csv(df, cols).write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)


__all__ = ["write_table", "write_jdbc", "write_clustered", "id_list_csv", "write_id_list_csv", "F"]
