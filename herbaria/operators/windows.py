"""Windows, ordering, paging and sampling (N-series).

Windows that rank within a key are partitioned by that key; the only global
windows (running totals) run on small monthly aggregates. Random samples are
reproducible: rows are ordered by a seeded hash of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S
from herbaria.operators.paging import page, rank_candidates  # noqa: F401  (N6, N4)


def running_total(df: DataFrame, value: str, out: str, order=("year", "month")) -> DataFrame:
    """Cumulative sum of ``value`` in ``order``.

    Meant for small aggregates (one row per month): a window without a
    partition key runs in one task.
    """
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.sum(value).over(w).cast("bigint"))


def latest_per_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows equal to the newest ``order`` per ``key`` (ties kept).

    A grouped max joined back: a hot key is pre-aggregated map-side rather
    than sorted in one task.
    """
    latest = df.groupBy(key).agg(F.max(order).alias("_max"))
    return df.join(latest, key).filter(F.col(order) == F.col("_max")).drop("_max")


def top_k_per_group(df: DataFrame, key: str | list[str], score: str, k: int, tie: str) -> DataFrame:
    """Top ``k`` rows per key by ``score`` desc, ties broken by ``tie`` asc.

    ``df`` is already aggregated per (key, tie), so each partition of the
    window holds one row per distinct value, not raw rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sort_by_column(df: DataFrame, column: str | None, direction: str | None,
                   allowed: list[str] | None = None, tie: str = "gbifID") -> DataFrame:
    """Validated sort; eventDate/dateIdentified sort by their processed
    dates; default is typeStatus descending."""
    allowed = allowed or df.columns
    if column in ("eventDate", "dateIdentified"):
        column = f"{column}_processed"
    if column in allowed and direction in ("asc", "desc"):
        col = F.col(column).asc() if direction == "asc" else F.col(column).desc()
    else:
        col = F.col("typeStatus").desc()
    return df.orderBy(col, F.col(tie).asc())


def _draw(key: str, seed: int) -> Column:
    """A seeded random order of ``key``, the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.col(key), F.lit(seed)))


def random_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in a seeded random order of ``key``: reproducible ORDER BY RAND()."""
    return df.orderBy(_draw(key, seed), F.col(key)).limit(k)


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """N7 per group: ``k`` rows per group in seeded random order."""
    w = W.partitionBy(group).orderBy(_draw(key, seed), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def cluster_within_partitions(df: DataFrame, *cols: str) -> DataFrame:
    """Physical clustering before a write."""
    return df.sortWithinPartitions(*cols)


def newest(users: DataFrame, kind: str, n: int) -> DataFrame:
    """Latest created people with an ORCID (``orcid``) or Wikidata id."""
    return users.filter(F.col(kind).isNotNull()).orderBy(F.col("created").desc(), F.col("id").desc()).limit(n)


def specimen_of_the_day(occurrences: DataFrame, claims: DataFrame, users: DataFrame, seed: int) -> DataFrame:
    """For every calendar day one holotype with an image, drawn with a recorded claim on it.

    Every recorded claim on every holotype of the day has the same chance (a seeded
    hash; the smallest wins). ``collectors`` names the first two people by id with a
    visible recorded claim on it, joined by ``and``."""
    occ = occurrences.filter((F.lower("typeStatus") == "holotype") & (F.col("hasImage") == 1)
                             & (F.col("eventDate_processed_year") > 1800))
    days = occ.select("gbifID", F.col("eventDate_processed_month").alias("month"), F.col("eventDate_processed_day").alias("day"))
    recorded = claims.filter(P.rec()).select(F.col("occurrence_id").alias("gbifID"), "user_id", "visible")
    draw = F.md5(F.concat_ws(":", "user_id", "gbifID", F.lit(seed)))
    drawn = (recorded.join(days, "gbifID").withColumn("draw", draw).groupBy("month", "day")
             .agg(F.min_by(F.struct("gbifID", "user_id"), "draw").alias("p")).select("month", "day", "p.*"))
    shown = recorded.filter("visible").select("gbifID", F.col("user_id").alias("id")).join(drawn.select("gbifID").distinct(), "gbifID", "left_semi")
    w = W.partitionBy("gbifID").orderBy("id")
    two = shown.withColumn("nth", F.row_number().over(w)).filter("nth <= 2")
    named = two.join(users.select("id", S.user_names()["viewname"].alias("name")), "id")
    text = (named.groupBy("gbifID").agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("names"))
            .select("gbifID", F.array_join(F.transform("names", lambda n: n["name"]), " and ").alias("collectors")))
    return drawn.join(text, "gbifID", "left").select("month", "day", "gbifID", "user_id", "collectors")


def best_statement(statements: DataFrame, entity: str = "entity", prop: str = "property",
                   rank: str = "rank", tie: str = "statement_id") -> DataFrame:
    """First statement per (entity, property) by rank score desc, then id."""
    w = W.partitionBy(entity, prop).orderBy(S.rank_score(rank).desc(), F.col(tie).asc())
    return statements.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
