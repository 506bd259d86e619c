"""Mutations as table rewrites (M-series): new table = f(old table, delta).

No row-level storage is involved: every function returns the rewritten table
(or the rows to add) as a DataFrame, for all people / organisations at once.
Iterative steps cut their lineage with ``checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S
from herbaria.operators import sets as X
from herbaria.operators import shared as SH
from herbaria.session import checkpoint_dir


def bulk_claim(requests: DataFrame, occurrence_agents: DataFrame, claims: DataFrame,
               occurrences: DataFrame | None = None, conditions: str | None = None) -> DataFrame:
    """M2: claim rows for (user_id, agent_id, ignore, created_by) requests.

    The agent's specimens are split into recorded-only, identified-only and
    both (X4), minus occurrences the person already has (claimed or
    rejected). ``ignore`` requests add rejections (NULL action, hidden).
    With ``conditions`` (F6 JSON) the agent's occurrences are narrowed first.
    """
    links = occurrence_agents
    if conditions:
        from herbaria.operators.filters import where_conditions
        keep = where_conditions(occurrences, conditions).select(F.col("gbifID").alias("occurrence_id"))
        links = links.join(keep, "occurrence_id", "left_semi")
    # one answer for all people with the same requests, less what each of them has
    people, lists = SH.share(requests.select("user_id", "agent_id", "ignore", "created_by"))
    links = links.select("agent_id", "occurrence_id", "agent_role")
    roles = (SH.listed_links(lists, links).groupBy("list", "occurrence_id", "ignore", "created_by")
             .agg(F.bool_or("agent_role").alias("r"), F.bool_or(~F.col("agent_role")).alias("i")))
    action = (F.when(F.col("ignore"), F.lit(None).cast("string"))
              .when(F.col("r") & F.col("i"), F.lit(P.RECORDED_IDENTIFIED))
              .when(F.col("r"), F.lit(P.RECORDED)).otherwise(F.lit(P.IDENTIFIED)))
    rows = roles.select("list", "occurrence_id", action.alias("action"), (~F.col("ignore")).alias("visible"),
                        "created_by")
    # two requests for the same (person, occurrence): the first by created_by, then action
    rows = X.first_per_key(rows, ["list", "occurrence_id"], ["created_by", "action"])
    buckets, by = SH.sizes(lists, links), ["action", "visible", "created_by"]
    packs = SH.pack(rows, buckets, by, ["occurrence_id"], "occurrence_id")
    return SH.unclaimed(people, packs, buckets, claims, by, ["occurrence_id"]).select("user_id", "occurrence_id", *by)


def bulk_claim_counts(new_rows: DataFrame, distinct: bool = True) -> DataFrame:
    """M2 audit: number of distinct occurrences attributed per person (see README on Q12).

    Rows of ``bulk_claim`` hold a person's occurrence once: with ``distinct`` False
    they are counted in the map tasks instead of being shuffled to be made distinct."""
    count = F.count_distinct if distinct else F.count
    return new_rows.groupBy("user_id").agg(count("occurrence_id").alias("num_attributed"))


def resolve_redirects(destroyed: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """M8: (identifier, resolved, banned, cycle) following redirect_to to its end.

    Pointer jumping: every round replaces a pointer to a destroyed identifier
    by that identifier's pointer, so a chain of length n resolves in log2(n)
    rounds. A chain that ends at a banned entry (blank redirect) resolves to
    NULL. While a chain is open, each round closes at least one of its pointers; so
    pointers still open after a round that closed none, or after ``max_rounds``,
    count as leading into a cycle.
    """
    spark = destroyed.sparkSession
    checkpoint_dir(spark)
    d = destroyed.select("identifier", F.when(F.trim("redirect_to") != "", F.col("redirect_to")).alias("nxt"))
    ids = d.select(F.col("identifier").alias("nxt"), F.lit(True).alias("is_destroyed"))
    cur = (d.join(ids, "nxt", "left").select("identifier", "nxt",
                                             F.coalesce("is_destroyed", F.lit(False)).alias("open")))
    before, rounds = -1, 0
    while True:
        cur = cur.checkpoint(eager=True)
        left = cur.filter("open").count()
        if left in (0, before) or rounds == max_rounds:
            break
        before, rounds = left, rounds + 1
        hop = cur.select(F.col("identifier").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("open").alias("open2"))
        cur = (cur.join(hop, "nxt", "left")
               .select("identifier",
                       F.when(F.col("open"), F.col("nxt2")).otherwise(F.col("nxt")).alias("nxt"),
                       F.when(F.col("open"), F.col("open2")).otherwise(F.lit(False)).alias("open")))
    return cur.select("identifier", F.when(~F.col("open"), F.col("nxt")).alias("resolved"),
                      (F.col("nxt").isNull() & ~F.col("open")).alias("banned"), F.col("open").alias("cycle"))


def merge_people(users: DataFrame, claims: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """M5: the three tables after merging people (src into dest): users without the sources, whose
    public flag goes over to the destination; claims (``merge_users``); redirect rows
    (identifier, redirect_to) to append to the destroyed identifiers."""
    carried = (users.filter("is_public").select(F.col("id").alias("src")).join(pairs, "src")
               .select(F.col("dest").alias("id")).distinct().withColumn("_public", F.lit(True)))
    kept = (users.join(pairs.select(F.col("src").alias("id")), "id", "left_anti").join(carried, "id", "left")
            .withColumn("is_public", F.coalesce("_public", "is_public")).select(*users.columns))
    named = users.select("id", F.coalesce("orcid", "wikidata", F.col("id").cast("string")).alias("identifier"))
    redirects = (pairs.join(named.withColumnRenamed("id", "src"), "src")
                 .join(named.select(F.col("id").alias("dest"), F.col("identifier").alias("redirect_to")), "dest")
                 .select("identifier", "redirect_to"))
    return {"users": kept, "claims": merge_users(claims, pairs), "redirects": redirects}


def merge_users(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """M5: rewrite claims for (src, dest) merges.

    Claims of ``src`` on occurrences ``dest`` does not hold move to ``dest``
    (their claimant becomes ``dest`` where it was ``src``); the rest of the
    source's claims are dropped. When several sources bring the same
    occurrence, the smallest source id wins.
    """
    src_ids = pairs.select(F.col("src").alias("user_id"))
    keep = claims.join(src_ids, "user_id", "left_anti").withColumn("_prio", F.lit(0).cast("bigint"))
    moved = (claims.join(pairs.withColumnRenamed("src", "user_id"), "user_id")
             .withColumn("created_by", F.when(F.col("created_by") == F.col("user_id"), F.col("dest"))
                         .otherwise(F.col("created_by")))
             .withColumn("_prio", F.col("user_id"))
             .withColumn("user_id", F.col("dest")).drop("dest"))
    moved = moved.join(claims.select("user_id", "occurrence_id"), ["user_id", "occurrence_id"], "left_anti")
    both = keep.unionByName(moved.select(*keep.columns))
    return X.first_per_key(both, ["user_id", "occurrence_id"], ["_prio"]).drop("_prio")


def merge_organizations(organizations: DataFrame, user_organizations: DataFrame, groups: DataFrame) -> tuple[
        DataFrame, DataFrame]:
    """M6: merge organisation groups (group_id, organization_id).

    The destination is the member with most people (ties: smallest id);
    identifiers must agree within a group — groups with two different values
    of an identifier are reported in ``conflict`` and not merged; institution
    codes are unioned; memberships are re-pointed. Returns (organisations,
    memberships) after the merge.
    """
    counts = user_organizations.groupBy("organization_id").agg(F.count("user_id").alias("n"))
    g = groups.join(counts, "organization_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dest = (g.groupBy("group_id").agg(F.max(F.struct("n", (-F.col("organization_id")).alias("neg"))).alias("b"))
            .select("group_id", (-F.col("b.neg")).alias("dest")))
    o = organizations.withColumnRenamed("id", "organization_id")
    idcols = ["wikidata", "ror", "grid", "ringgold", "isni"]
    per_group = (g.join(o, "organization_id").groupBy("group_id")
                 .agg(*[F.count_distinct(c).alias(f"n_{c}") for c in idcols],
                      *[F.max(c).alias(c) for c in idcols],
                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("institution_codes")))).alias("codes")))
    ok = per_group.filter(" AND ".join(f"n_{c} <= 1" for c in idcols)).join(dest, "group_id")
    mapping = g.join(ok.select("group_id", "dest"), "group_id").select("organization_id", "dest")
    merged_orgs = (o.join(mapping.filter(F.col("organization_id") != F.col("dest")), "organization_id", "left_anti")
                   .join(ok.select(F.col("dest").alias("organization_id"), *[F.col(c).alias(f"m_{c}") for c in idcols],
                                   "codes"), "organization_id", "left")
                   .select(F.col("organization_id").alias("id"), "name",
                           *[F.coalesce(F.col(f"m_{c}"), F.col(c)).alias(c) for c in idcols],
                           F.coalesce("codes", "institution_codes").alias("institution_codes")))
    members = (user_organizations.join(mapping, "organization_id", "left")
               .withColumn("organization_id", F.coalesce("dest", "organization_id")).drop("dest"))
    return merged_orgs, members


def claim_upsert(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """M7: apply a batch of (user_id, occurrence_id, action, visible, created_by):
    hidden rows replace an existing claim; other rows are inserted only when new."""
    hidden = batch.filter(F.col("visible") == F.lit(False))
    shown = batch.filter(F.col("visible") == F.lit(True))
    base = claims.join(hidden.select("user_id", "occurrence_id"), ["user_id", "occurrence_id"], "left_anti")
    cols = base.columns
    add_hidden = hidden.select(*[c if c in hidden.columns else F.lit(None).alias(c) for c in cols])
    base = base.unionByName(add_hidden.select(*cols))
    return X.insert_ignore(base, shown.select(*[c if c in shown.columns else F.lit(None).alias(c) for c in cols]),
                           ["user_id", "occurrence_id"], order=["created_by"])


def claim_update(claims: DataFrame, updates: DataFrame) -> DataFrame:
    """M7: set action / visible / claimant of existing claims from ``updates``."""
    u = updates.select("user_id", "occurrence_id", *[F.col(c).alias(f"u_{c}") for c in ("action", "visible", "created_by")],
                       F.lit(True).alias("_hit"))
    j = claims.join(u, ["user_id", "occurrence_id"], "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c)
                      if c in ("action", "visible", "created_by") else F.col(c) for c in claims.columns])


def claim_delete(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """M7: drop claims listed in ``keys`` (user_id, occurrence_id)."""
    return claims.join(keys.select("user_id", "occurrence_id"), ["user_id", "occurrence_id"], "left_anti")


def identifier_table(users: DataFrame) -> DataFrame:
    """M9: long table (identifier, user_id, priority): ORCID 1, Wikidata 2, id 3."""
    return (users.select(F.col("orcid").alias("identifier"), F.col("id").alias("user_id"), F.lit(1).alias("priority"))
            .unionByName(users.select(F.col("wikidata").alias("identifier"), F.col("id").alias("user_id"),
                                      F.lit(2).alias("priority")))
            .unionByName(users.select(F.col("id").cast("string").alias("identifier"), F.col("id").alias("user_id"),
                                      F.lit(3).alias("priority")))
            .filter(F.col("identifier").isNotNull()))


def resolve_identifier(requests: DataFrame, users: DataFrame, col: str = "identifier") -> DataFrame:
    """M9: map identifiers to user ids; the kind is decided by the identifier's
    shape (ORCID, Wikidata id, integer) as in the lookup."""
    kind = (F.when(S.is_orcid(col), F.lit(1)).when(S.is_wiki_id(col), F.lit(2))
            .when(S.is_integer(col), F.lit(3)))
    r = requests.withColumn("priority", kind)
    return r.join(identifier_table(users).withColumnRenamed("identifier", col), [col, "priority"], "left").drop("priority")


# Order in which an organisation's identifiers are looked up.
ORGANIZATION_LOOKUP = ["wikidata", "ror", "ringgold", "grid", "isni"]


def resolve_organization(requests: DataFrame, organizations: DataFrame, col: str = "identifier") -> DataFrame:
    """M9 for organisations: the one that holds the identifier under the first kind of
    ``ORGANIZATION_LOOKUP``; two that share a value: the smaller id."""
    kinds = F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("value")) for i, c in enumerate(ORGANIZATION_LOOKUP)])
    long = organizations.select("id", F.explode(kinds).alias("k")).select("id", "k.*").filter("value is not null")
    best = long.groupBy("value").agg(F.min(F.col("at") * F.lit(1 << 48) + F.col("id")).alias("best"))
    found = best.select(F.col("value").alias(col), (F.col("best") % F.lit(1 << 48)).alias("organization_id"))
    return requests.join(found, col, "left")


def attach_organization(rows: DataFrame, organizations: DataFrame) -> DataFrame:
    """Organisation id of rows carrying ror/grid/ringgold/wikidata, matched
    in that order; ``new_org`` marks rows with an id but no match (to create);
    rows without any id are skipped."""
    out = rows
    order = ["ror", "grid", "ringgold", "wikidata"]
    for c in order:  # an id that two organisations hold names the smaller one
        o = organizations.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"org_{c}"))
        out = out.join(o, c, "left")
    any_id = F.coalesce(*[F.col(c) for c in order]).isNotNull()
    org = F.coalesce(*[F.col(f"org_{c}") for c in order])
    return (out.filter(any_id).withColumn("organization_id", org)
            .withColumn("new_org", F.col("organization_id").isNull())
            .drop(*[f"org_{c}" for c in order]))


def purge_orphan_claims(claims: DataFrame, orphan_report: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Drop visible orphan claims of the listed people."""
    listed = orphan_report.select("user_id").distinct()
    orphan_rows = (claims.filter(P.vis()).join(listed, "user_id", "left_semi")
                   .join(occurrences.select(F.col("gbifID").alias("occurrence_id")), "occurrence_id", "left_anti")
                   .select("user_id", "occurrence_id"))
    return claims.join(orphan_rows, ["user_id", "occurrence_id"], "left_anti")


def archive_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the previous occurrences table that vanished in the new one."""
    return old.join(new.select("gbifID"), "gbifID", "left_anti")


def refresh_datasets(datasets: DataFrame, occurrences: DataFrame, claims: DataFrame,
                     occurrence_agents: DataFrame) -> DataFrame:
    """Add new dataset keys, drop vanished ones and those without agents, and
    recompute counters; kept datasets keep their other columns, new ones have none."""
    from herbaria.operators import counters as C
    return C.refresh_datasets(datasets, C.full_state(occurrences, claims), occurrences, occurrence_agents)


def make_public(users: DataFrame, claims: DataFrame, since, now) -> DataFrame:
    """Private Wikidata people with a claim since ``since`` become public."""
    from herbaria.operators.filters import wikidata_to_publish
    flip = wikidata_to_publish(users, claims, since).select("id").withColumn("_flip", F.lit(True))
    j = users.join(flip, "id", "left")
    return j.select(*[F.when(F.col("_flip"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_public" else
                      (F.when(F.col("_flip"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
                       if c == "made_public" else F.col(c)) for c in users.columns])


def mark_articles(articles: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Set a status column (``processed`` or ``mail_sent``) for listed article ids."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = articles.join(hit, "id", "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == column else F.col(c)
                      for c in articles.columns])


def refresh_profiles(users: DataFrame, authority: DataFrame, memberships: DataFrame,
                     user_organizations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Update profile columns from an authority table (user_id, family,
    given, date_born, date_died, ...); ORCID people absent from the authority
    are dropped; memberships of refreshed people are replaced."""
    a_cols = [c for c in authority.columns if c != "user_id" and c in users.columns]
    a = authority.select("user_id", *[F.col(c).alias(f"a_{c}") for c in a_cols], F.lit(True).alias("_seen"))
    j = users.join(a.withColumnRenamed("user_id", "id"), "id", "left")
    j = j.filter(F.col("orcid").isNull() | F.col("_seen"))
    new_users = j.select(*[F.when(F.col("_seen"), F.col(f"a_{c}")).otherwise(F.col(c)).alias(c) if c in a_cols
                           else F.col(c) for c in users.columns])
    refreshed = authority.select("user_id").distinct()
    kept = user_organizations.join(refreshed, "user_id", "left_anti")
    return new_users, kept.unionByName(memberships.select(*user_organizations.columns))


def add_articles(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Insert found articles whose DOI is new and that have a download key;
    dataset DOIs come from ``gbifDOI:`` tags (P35)."""
    f = (found.filter(F.size("gbif_downloadkeys") > 0)
         .withColumn("gbif_dois", S.extract_prefixed_tags("tags")).drop("tags"))
    cols = [c for c in articles.columns]
    f = f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(articles.schema[c].dataType).alias(c) for c in cols])
    return X.insert_ignore(articles, f, ["doi"], order=["id"])
