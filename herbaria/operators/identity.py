"""Who is the same: components of shared identifiers, conflicts, chains of merges.

Two organisations that share a value of any of five identifiers are one, and so is
everything reached through such links. Components come from star contraction: each
round links every node to the smallest one it can see, in logarithmically many
rounds, each an aggregate and a join. Lineage is cut every round by a checkpoint in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.operators import mutate as M
from herbaria.session import checkpoint_dir

ORGANIZATION_IDS = ["isni", "grid", "ror", "ringgold", "wikidata"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Ends when a round changes nothing; null ends link nothing. Nodes are numbers.
    """
    checkpoint_dir(edges.sparkSession)
    links = edges.filter("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        # large star: whatever a node sees that is larger goes to the smallest it sees
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(small, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and the smaller ones it sees go to the smallest of them
        low = large.filter("a <> b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        links = (low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def organization_groups(organizations: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(organization_id, group_id): organisations linked through shared identifiers; alone: a group of one.

    A value links its holders to the smallest of them, so a value shared by many
    makes as many links as holders, not pairs.
    """
    ids = ids or ORGANIZATION_IDS
    long = organizations.select("id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ids])).alias("x")).select("id", "x.*").filter("value is not null")
    first = long.groupBy("kind", "value").agg(F.min("id").alias("first"))
    edges = long.join(first, ["kind", "value"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(edges)
    return (organizations.select(F.col("id").alias("organization_id"))
            .join(found.withColumnRenamed("node", "organization_id"), "organization_id", "left")
            .select("organization_id", F.coalesce("component", "organization_id").alias("group_id")))


def conflicts(organizations: DataFrame, groups: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(group_id, identifier, values): groups that hold two values of one identifier, which must not be merged."""
    ids = ids or ORGANIZATION_IDS
    j = groups.join(organizations.withColumnRenamed("id", "organization_id"), "organization_id")
    long = j.select("group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("identifier"), F.col(c).alias("value")) for c in ids])).alias("x"))
    pairs = long.select("group_id", "x.identifier", "x.value").filter("value is not null").distinct()
    return pairs.groupBy("group_id", "identifier").agg(F.count(F.lit(1)).alias("values")).filter("values > 1")


def merge_same_organizations(organizations: DataFrame, user_organizations: DataFrame) -> dict[str, DataFrame]:
    """M6: organisations that share identifiers become one, unless their identifiers conflict.

    Returns the organisations, the memberships re-pointed and distinct, the mapping
    (organization_id, dest) of those that were merged away, and the conflicts.
    """
    checkpoint_dir(organizations.sparkSession)
    groups = organization_groups(organizations).checkpoint()
    clash = conflicts(organizations, groups)
    many = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = groups.join(many, "group_id", "left_semi").join(clash, "group_id", "left_anti")
    merged, members = M.merge_organizations(organizations, user_organizations, wanted)
    dest = merged.select(F.col("id").alias("dest")).join(wanted.withColumnRenamed("organization_id", "dest"), "dest")
    mapping = wanted.join(dest, "group_id").filter("organization_id <> dest").select("organization_id", "dest")
    return {"organizations": merged, "user_organizations": members.distinct(), "mapping": mapping, "conflicts": clash}


def final_destinations(pairs: DataFrame) -> DataFrame:
    """(src, dest) merges with every chain followed to its end.

    ``a`` into ``b`` and ``b`` into ``c`` make ``a`` into ``c``. Merges in a circle all go to the
    smallest id of the circle, which stays; what leads into a circle goes there
    too. A person merged into two others goes to the smaller one.
    """
    one = pairs.filter("src <> dest").groupBy("src").agg(F.min("dest").alias("dest"))
    text = one.select(F.col("src").cast("string").alias("identifier"), F.col("dest").cast("string").alias("redirect_to"))
    ends = M.resolve_redirects(text).checkpoint()
    straight = ends.filter(~F.col("cycle")).select(F.col("identifier").cast("long").alias("src"), F.col("resolved").cast("long").alias("dest"))
    # what is left forms circles and the ways into them: one component each
    circling = one.join(ends.filter("cycle").select(F.col("identifier").cast("long").alias("src")), "src", "left_semi")
    inside = _on_circles(circling)
    comp = components(circling.select(F.col("src").alias("a"), F.col("dest").alias("b")))
    kept = comp.join(inside.withColumnRenamed("src", "node"), "node", "left_semi").groupBy("component").agg(F.min("node").alias("dest"))
    round_ = comp.join(kept, "component").filter("node <> dest").select(F.col("node").alias("src"), "dest")
    return straight.unionByName(round_)


def _on_circles(pairs: DataFrame) -> DataFrame:
    """Sources of ``pairs`` that lie on a circle: those left when ends without an arrow to them are peeled off."""
    rest, n = pairs.checkpoint(), -1
    while True:
        now = rest.count()
        if now == n:
            return rest.select("src")
        n = now
        rest = rest.join(rest.select(F.col("dest").alias("src")).distinct(), "src", "left_semi").checkpoint()


def refresh_profiles(users: DataFrame, claims: DataFrame, authority: DataFrame, memberships: DataFrame,
                     user_organizations: DataFrame) -> dict[str, DataFrame]:
    """Profile columns from an authority table, and the merges that it brings about.

    ``authority`` holds user_id and any profile columns. A null there keeps the old
    value. ORCID people it does not list are dropped. A person whose Wikidata id
    changes to one that another person holds is merged into that person (M5), along
    chains and out of circles (``final_destinations``). Memberships of listed people
    are replaced. Returns users, claims, user_organizations, merges (src, dest) and
    redirects (identifier, redirect_to) of the people merged away.
    """
    new_users, orgs = M.refresh_profiles(users, authority, memberships, user_organizations)
    holders = users.filter("wikidata is not null").groupBy("wikidata").agg(F.min("id").alias("dest"))
    moved = (authority.filter("wikidata is not null").select(F.col("user_id").alias("src"), "wikidata")
             .join(users.select(F.col("id").alias("src"), F.col("wikidata").alias("old")), "src")
             .filter(F.col("old").isNull() | (F.col("old") != F.col("wikidata"))))
    pairs = moved.join(holders, "wikidata").select("src", "dest").filter("src <> dest")
    merges = final_destinations(pairs).checkpoint()
    gone = merges.select(F.col("src").alias("id"))
    public = users.filter("is_public").select(F.col("id").alias("src")).join(merges, "src").select(F.col("dest").alias("id")).distinct()
    kept = (new_users.join(gone, "id", "left_anti").join(public.withColumn("_public", F.lit(True)), "id", "left")
            .withColumn("is_public", F.coalesce("_public", "is_public")).select(*users.columns))
    named = users.select("id", F.coalesce("orcid", "wikidata", F.col("id").cast("string")).alias("identifier"))
    redirects = (merges.join(named.withColumnRenamed("id", "src"), "src")
                 .join(named.select(F.col("id").alias("dest"), F.col("identifier").alias("redirect_to")), "dest")
                 .select("identifier", "redirect_to"))
    return {"users": kept, "claims": M.merge_users(claims, merges), "merges": merges, "redirects": redirects,
            "user_organizations": orgs.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti")}
