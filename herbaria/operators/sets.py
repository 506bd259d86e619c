"""Set operations and de-duplication (X-series) and insert-ignore (M1).

De-duplication takes the ``min`` of a struct that starts with the declared
order, not a window: the aggregate combines map-side, so a key with millions of
copies is reduced before the shuffle. Spark plans it as two sort aggregates, so
whole rows are sorted on both sides of the shuffle; wide rows (X1) are dealt first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P


#: Tasks that may share the copies of one gbifID.
STRETCHES = 4


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep one row per ``keys``: the smallest by ``order`` then by all other
    columns, so the result never depends on input order (X1, M1)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("_p"))
    return picked.select(*keys, *[F.col("_p")[f"o{i}"].alias(c) for i, c in enumerate(order)],
                         *[F.col("_p")[c].alias(c) for c in rest]).select(*df.columns)


def dedupe_occurrences(raw: DataFrame, order: list[str]) -> DataFrame:
    """One row per gbifID, chosen by a declared order.

    Rows are dealt by gbifID and stretch first, so a task sorts a share that shrinks
    with the number of partitions, not a whole input split, which spills. A gbifID
    with millions of copies is reduced by ``STRETCHES`` tasks before their rows meet.
    """
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.pmod(F.xxhash64(*order), F.lit(STRETCHES))
    return first_per_key(raw.repartition(parts, "gbifID", stretch), ["gbifID"], order)


def union_roles(recorded: DataFrame, identified: DataFrame) -> DataFrame:
    """(agent_id, agent_role, occurrence_id) from both roles, non-null agent, distinct."""
    rec = recorded.select("agent_id", F.lit(True).alias("agent_role"), "occurrence_id")
    idn = identified.select("agent_id", F.lit(False).alias("agent_role"), "occurrence_id")
    return (rec.unionByName(idn).filter(F.col("agent_id").isNotNull())
            .dropDuplicates(["agent_id", "agent_role", "occurrence_id"]))


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """X3."""
    return df.select(*cols).distinct()


def classify_roles(recorded: DataFrame, identified: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, occurrence_id, action): recorded-only, identified-only, both,
    in one grouped pass."""
    rec = recorded.select(key, "occurrence_id", F.lit(True).alias("r"), F.lit(False).alias("i"))
    idn = identified.select(key, "occurrence_id", F.lit(False).alias("r"), F.lit(True).alias("i"))
    g = rec.unionByName(idn).groupBy(key, "occurrence_id").agg(F.bool_or("r").alias("r"), F.bool_or("i").alias("i"))
    action = (F.when(F.col("r") & F.col("i"), F.lit(P.RECORDED_IDENTIFIED))
              .when(F.col("r"), F.lit(P.RECORDED)).otherwise(F.lit(P.IDENTIFIED)))
    return g.select(key, "occurrence_id", action.alias("action"))


def key_diff(new: DataFrame, old: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys only in new, keys only in old)."""
    n, o = new.select(key).distinct(), old.select(key).distinct()
    return n.join(o, key, "left_anti"), o.join(n, key, "left_anti")


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """X6."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def known_ids_diff(new: DataFrame, existing: DataFrame, destroyed: DataFrame, key: str = "identifier") -> DataFrame:
    """Ids that are neither known nor destroyed."""
    return (new.select(key).distinct().join(existing.select(key), key, "left_anti")
            .join(destroyed.select(key), key, "left_anti"))


def ids_to_merge(redirects: DataFrame, existing: DataFrame, key: str = "identifier") -> DataFrame:
    """Redirected ids that exist locally."""
    return redirects.join(existing.select(key), key, "left_semi")


def except_person(people: DataFrame, viewer_col: str, person_col: str = "user_id") -> DataFrame:
    """Drop rows where the listed person is the viewer."""
    return people.filter(F.col(person_col) != F.col(viewer_col))


def insert_ignore(target: DataFrame, delta: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """M1: rows of ``target`` plus delta rows whose key is new; within the delta
    the first row by ``order`` wins."""
    d = delta.select(*target.columns)
    if order:
        d = first_per_key(d, keys, order)
    else:
        d = d.dropDuplicates(keys)
    return target.unionByName(d.join(target.select(*keys), keys, "left_anti"))
