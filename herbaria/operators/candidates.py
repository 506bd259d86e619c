"""Specimens whose collectors are not all claimed yet (T4, G24; job B7).

The reference looks at each counted specimen, fetches the co-collectors of its
claimed collectors and asks the search index whether one of the specimen's agents
is among them. The network of all claims is far larger than what is asked for, so
here it is narrowed from both ends before it is built: to collectors of counted
specimens on one side, to people with the agents of one of them on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.operators.pairs import join_in_blocks
from herbaria.operators.shared import kept, share


def _recorders(claims: DataFrame) -> DataFrame:
    return claims.filter(P.vis() & P.rec()).select("occurrence_id", "user_id").distinct()


def networked(counts: DataFrame, recorders: DataFrame, min_network: int = 2) -> DataFrame:
    """Counted specimens whose collectors together have at least ``min_network`` (1 or 2) co-collectors.

    Two collectors of one specimen are each other's co-collectors, so only
    specimens with a single one need their network, and of it no more than its
    smallest and largest member.
    """
    if min_network not in (1, 2):
        raise ValueError("min_network is 1 or 2")
    collectors = recorders.join(counts.select("occurrence_id"), "occurrence_id", "left_semi")
    per = collectors.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("only"))
    alone = per.filter("n = 1").select("occurrence_id", F.col("only").alias("collector"))
    asked = alone.select("collector").distinct()
    theirs = recorders.withColumnRenamed("user_id", "collector").join(asked, "collector", "left_semi")
    met = join_in_blocks(theirs, recorders.withColumnRenamed("user_id", "other"), "occurrence_id").filter("other <> collector")
    ends = met.groupBy("collector").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    if min_network == 2:
        ends = ends.filter("low <> high")
    few = alone.join(ends.select("collector"), "collector", "left_semi").select("occurrence_id")
    return per.filter("n > 1").select("occurrence_id").unionByName(few)


def occurrence_has_candidate(counts: DataFrame, claims: DataFrame, occurrence_agents: DataFrame, scores: DataFrame,
                             min_score: float, min_network: int = 2) -> DataFrame:
    """T4: rows of ``counts`` with an agent who may be an unclaimed co-collector.

    Kept are specimens whose claimed collectors' whole network has ``min_network``
    people, and where a recorder agent matches (``scores``: user_id, agent_id, score
    over ``min_score``) a member of that network who is not one of the collectors.
    People matched with the same agents share a list, so a specimen names the lists of
    its agents, not their people, and meets the co-collectors of a collector by list.
    Most such specimens are found through one of their collectors, which is asked
    first; all collectors are asked only for specimens not found yet.
    """
    counts, recorders = kept(counts), kept(_recorders(claims))  # read several times below
    agents = occurrence_agents.filter("agent_role").select("occurrence_id", "agent_id").distinct()
    good = scores.filter((F.col("score") > min_score) & F.col("user_id").isNotNull()).select("user_id", "agent_id")
    people, lists = share(good)
    asked = counts.select("occurrence_id").distinct()
    named = kept(join_in_blocks(agents.join(asked, "occurrence_id", "left_semi"), lists.distinct(), "agent_id").select("occurrence_id", "list").distinct())
    members = kept(recorders.join(people, "user_id").select("occurrence_id", "user_id", "list"))
    collectors = recorders.join(asked, "occurrence_id", "left_semi")
    one = collectors.groupBy("occurrence_id").agg(F.min("user_id").alias("user_id"))
    found = kept(_hits(named, one, recorders, members))
    left = kept(named.join(found, "occurrence_id", "left_anti"))
    hit = found.unionByName(_hits(left, collectors.join(left.select("occurrence_id").distinct(), "occurrence_id", "left_semi"), recorders, members))
    return (counts.join(networked(counts, recorders, min_network), "occurrence_id", "left_semi")
            .join(hit, "occurrence_id", "left_semi"))


def _hits(named: DataFrame, collectors: DataFrame, recorders: DataFrame, members: DataFrame) -> DataFrame:
    """(occurrence_id) of ``named`` with a person of one of its lists (``members``: the lists of recorders) who is a
    co-collector of one of ``collectors`` and not a collector of it."""
    asked = kept(join_in_blocks(named, collectors.withColumnRenamed("user_id", "collector"), "occurrence_id"))
    pairs = asked.select("collector", "list").distinct()
    ours = recorders.withColumnRenamed("user_id", "collector").join(pairs.select("collector").distinct(), "collector", "left_semi")
    met = (join_in_blocks(ours, members, "occurrence_id").filter("user_id <> collector").select("collector", "list", "user_id")
           .join(pairs, ["collector", "list"], "left_semi").distinct())
    return (join_in_blocks(asked, met, ["collector", "list"]).select("occurrence_id", "user_id")
            .join(recorders, ["occurrence_id", "user_id"], "left_anti").select("occurrence_id").distinct())


def open_items(counts: DataFrame, claims: DataFrame, seed: int) -> DataFrame:
    """Counted specimens with fewer recorded claims than agents, in a seeded random order.

    ``draw`` orders them; the reference shows one, the first of ``draw`` here.
    """
    claimed = claims.filter(P.rec()).groupBy("occurrence_id").agg(F.count("user_id").alias("claimed"))
    return (counts.filter("agent_count > 1").select("occurrence_id", "agent_count").join(claimed, "occurrence_id")
            .filter("claimed < agent_count")
            .withColumn("draw", F.md5(F.concat_ws(":", F.col("occurrence_id"), F.lit(seed)))))


def drawn_item(items: DataFrame) -> DataFrame:
    """The one specimen that is shown; a top-one aggregate, no sort."""
    return items.agg(F.min_by(F.struct("occurrence_id", "agent_count", "claimed"), "draw").alias("item")).filter("item is not null").select("item.*")
