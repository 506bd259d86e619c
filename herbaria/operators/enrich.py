"""Batch enrichment through Arrow (U-series).

U1 sends strings to an external function in Arrow batches with
``mapInPandas``; it runs on the distinct strings only and the result is joined
back, so each value is processed once however often it repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import scalars as S

BATCH = 500


def enrich_in_batches(df: DataFrame, col: str, fn: Callable[[list[str]], list[str]], out: str = "parsed",
                      batch: int = BATCH) -> DataFrame:
    """``fn`` maps a list of strings to a list of JSON strings of the same
    length and order; NULL inputs are sent as ``''``."""
    distinct = df.select(F.col(col).alias("_v")).distinct()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            values = pdf["_v"].fillna("").tolist()
            res: list[str] = []
            for i in range(0, len(values), batch):
                chunk = values[i:i + batch]
                got = fn(chunk)
                if len(got) != len(chunk):
                    raise ValueError("enrichment function changed the batch length")
                res.extend(got)
            yield pd.DataFrame({"_v": pdf["_v"], out: res})

    enriched = distinct.mapInPandas(run, schema=f"_v string, {out} string")
    return df.join(enriched, df[col].eqNullSafe(enriched["_v"]), "left").drop("_v")


def expand_names(jobs: DataFrame, col: str = "parsed") -> DataFrame:
    """JSON array of names -> one row per name; rows with none keep one NULL row."""
    return jobs.withColumn("name", F.explode_outer(S.parse_names(col)))


def expand_ids(df: DataFrame, col: str, role: bool | None = None) -> DataFrame:
    """Id list -> one row per positive id (text lists are parsed first)."""
    ids = S.parse_ids(col) if dict(df.dtypes)[col] == "string" else F.filter(col, lambda x: x > 0)
    out = df.withColumn("occurrence_id", F.explode(F.array_distinct(ids)))
    if role is not None:
        out = out.withColumn("agent_role", F.lit(role))
    return out


def foreach_partition_sink(df: DataFrame, write_batch: Callable[[pd.DataFrame], None]) -> None:
    """U4: side-effecting sink per Arrow batch; prefer ``sources.writers`` (K2)."""
    def run(it):
        for pdf in it:
            write_batch(pdf)
            yield pd.DataFrame({"n": [len(pdf)]})
    df.mapInPandas(run, schema="n long").agg(F.sum("n")).collect()
