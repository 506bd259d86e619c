"""Rows made once for all people with the same agents (J25, M2, G37; ranked in ``paging``: N4, K13).

People matched with the same agents have the same candidates but for what each of
them has claimed. They share a list: its rows are made once and travel in packs, a
person travels once per pack with the claims that fall into it, and a person's rows
are unfolded where the two meet, shuffled no more. A person with agents of their own
has a list of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.operators.pairs import join_in_blocks
from herbaria.session import checkpoint_dir

#: Rows of a list that travel in one pack, and people of a list that one task may unfold a pack for.
STRETCH = 8192


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of checkpoints; its size is known when later joins are planned."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def share(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, lists) of ``rows``, which hold user_id and other columns.

    People (user_id, list) with equal rows, repeats counted, have the same ``list``; lists
    holds the rows of one person of each, without user_id. Rows are compared by their
    number and four sums over two 64-bit hashes, which combine in the map tasks, so
    the rows of a person are not gathered.
    """
    names = [c for c in rows.columns if c != "user_id"]
    told = [x for c in names for x in (F.col(c), F.col(c).isNull())]  # hashes pass over nulls
    one, two = F.xxhash64(*told), F.xxhash64(F.lit(1), *told)
    low = 0xFFFFFFFF
    sums = [F.count(F.lit(1)), *[F.sum(h.bitwiseAND(F.lit(low))) for h in (one, two)], *[F.sum(F.shiftright(h, 32)) for h in (one, two)]]
    marks = [s.alias(f"_s{i}") for i, s in enumerate(sums)]
    mark = F.unhex(F.md5(F.concat_ws(",", *[f"_s{i}" for i in range(len(sums))])))
    people = kept(rows.groupBy("user_id").agg(*marks).select("user_id", mark.alias("list")))
    # one person stands for all of a list; a missing person id may, so it is packed
    chosen = kept(people.groupBy("list").agg(F.min(F.struct("user_id")).alias("one")).select("list", F.col("one.user_id").alias("_one")))
    return people, rows.join(chosen, F.col("user_id").eqNullSafe(F.col("_one"))).select("list", *names)


def sizes(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(list, buckets): the packs that each list needs for the links of its agents."""
    linked = links.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))
    return kept(lists.select("list", "agent_id").join(linked, "agent_id").groupBy("list")
                .agg(F.ceil(F.sum("n") / STRETCH).alias("buckets")))


def pack(content: DataFrame, buckets: DataFrame, by: list[str], each: list[str], dealt: str) -> DataFrame:
    """(list, bucket, by, rows): rows of ``content`` with the columns ``each`` as arrays, dealt by ``dealt``; written once."""
    placed = content.join(buckets, "list").withColumn("bucket", F.pmod(F.xxhash64(dealt), F.col("buckets"))).drop("buckets")
    return kept(placed.repartition(partitions(content), "list", "bucket").groupBy("list", "bucket", *by)
                .agg(F.collect_list(F.struct(*each)).alias("rows")))


def held(people: DataFrame, claims: DataFrame) -> DataFrame:
    """(user_id, occurrence_id, list): what people have claimed or rejected, once each."""
    had = claims.select("user_id", "occurrence_id").filter("user_id is not null and occurrence_id is not null")
    return had.repartition(partitions(claims), "user_id").distinct().join(people, "user_id")


def meet(asked: DataFrame, people: DataFrame, packs: DataFrame, place: str) -> DataFrame:
    """Join of ``asked`` (user_id, list, ``place``, ...) and ``packs`` (list, ``place``, ...); a pack of a list
    with many people is copied once for every ``STRETCH`` of them."""
    blocks = (people.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / STRETCH).alias("_blocks")).filter("_blocks > 1"))
    last = F.coalesce("_blocks", F.lit(1).cast("long"))
    a = asked.join(blocks, "list", "left").withColumn("_block", F.pmod(F.xxhash64("user_id"), last)).drop("_blocks")
    b = packs.join(blocks, "list", "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last - 1))).drop("_blocks")
    parts, on = partitions(packs), ["list", place, "_block"]
    # merged: a hash join of people by pack unfolds several times slower
    return a.repartition(parts, *on).hint("merge").join(b.repartition(parts, *on), on).drop("_block")


def per_bucket(people: DataFrame, packs: DataFrame, brought: DataFrame) -> DataFrame:
    """(user_id, list, bucket, ...): every person of a list with each of its packs, and what they bring to it."""
    last = packs.groupBy("list").agg(F.max("bucket").alias("_last"))
    every = people.join(last, "list").select("user_id", "list", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("bucket"))
    return every.join(brought, ["user_id", "bucket"], "left")


def unclaimed(people: DataFrame, packs: DataFrame, buckets: DataFrame, claims: DataFrame, by: list[str], each: list[str]) -> DataFrame:
    """(user_id, by, each): the rows of each person's packs, dealt by occurrence, less occurrences they claimed or rejected."""
    there = packs.select("list", F.explode("rows.occurrence_id").alias("occurrence_id"))
    had = (held(people, claims).join(there, ["list", "occurrence_id"], "left_semi").join(buckets, "list")
           .groupBy("user_id", F.pmod(F.xxhash64("occurrence_id"), F.col("buckets")).alias("bucket"))
           .agg(F.collect_list("occurrence_id").alias("had")))
    met = meet(per_bucket(people, packs, had), people, packs, "bucket")
    rows = met.select("user_id", "had", *by, F.explode("rows").alias("_r")).select("user_id", "had", *by, *[F.col(f"_r.{c}").alias(c) for c in each])
    free = F.col("had").isNull() | F.col("occurrence_id").isNull() | ~F.array_contains("had", F.col("occurrence_id"))
    return rows.filter(free).drop("had")


def listed_links(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The links of the agents of each list; the two share no column but agent_id."""
    return join_in_blocks(lists, links, "agent_id")
