"""Joins (J-series): anti/semi, self-join networks, interval and theta joins.

All are computed for every person / dataset / organisation at once. Inputs are
de-duplicated to the join keys before a self join so the pair expansion works
on (person, occurrence) rows only. Pairs of a large group are made in blocks
(``herbaria.operators.pairs``), by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S
from herbaria.operators import filters as FL
from herbaria.operators import shared as SH
from herbaria.operators.pairs import distinct_members, gather, join_in_blocks, pair_members, parts_of

#: Co-collectors of one person that travel in one row.
PACK = 256
#: Co-collectors, repeats included, that one row gathers for an occurrence.
MET = 250_000


def _occ_id(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(F.col("gbifID").alias("occurrence_id"))


# -- J1-J7: existence ------------------------------------------------------------

def missing_claims(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Distinct occurrence ids of visible claims with no occurrence."""
    return (FL.visible(claims).select("occurrence_id")
            .join(_occ_id(occurrences), "occurrence_id", "left_anti").distinct())


def datasets_lost_attribution(dataset_counts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Datasets that had source attributions and now have none."""
    had = dataset_counts.filter(F.col("source_attribution_count") > 0)
    now = (occurrences.filter(F.col("recordedByID").isNotNull() | F.col("identifiedByID").isNotNull())
           .select("datasetKey"))
    return had.join(now, "datasetKey", "left_anti")


def attach_agent_id(names: DataFrame, agents: DataFrame) -> DataFrame:
    """Map the nine-part name key to the agent id (left join, NULL when absent).

    The agents table is joined by a plain equi-join; Spark broadcasts it only
    when its measured size is under the threshold and shuffles otherwise.
    """
    keys = S.AGENT_KEY
    return names.join(agents.select(F.col("id").alias("agent_id"), *keys), keys, "left")


def attach_taxon_id(families: DataFrame, taxa: DataFrame) -> DataFrame:
    """Map family to taxon id."""
    return families.join(taxa.select(F.col("id").alias("taxon_id"), "family"), "family", "left")


def orphans(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Visible claims without an occurrence, with person and claimant."""
    return (FL.visible(claims).join(_occ_id(occurrences), "occurrence_id", "left_anti")
            .select("occurrence_id", "user_id", "created_by"))


def purge_orphans(table: DataFrame, occurrences: DataFrame, only_hidden: bool = False) -> DataFrame:
    """Keep rows whose occurrence exists (optionally only hidden claims are purged)."""
    kept = table.join(_occ_id(occurrences), "occurrence_id", "left_semi")
    if only_hidden:
        kept = kept.unionByName(table.filter(F.col("visible")).join(_occ_id(occurrences), "occurrence_id",
                                                                   "left_anti"))
    return kept


def unresolved_source_people(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """Occurrences with a source collector id but no claim at all."""
    return (occurrences.filter(F.col("recordedByID").isNotNull())
            .join(claims.select(F.col("occurrence_id").alias("gbifID")), "gbifID", "left_anti"))


# -- J8: people of a scope ----------------------------------------------------------

def people_of(scope: DataFrame, claims: DataFrame, small: bool = False) -> DataFrame:
    """(scope key, user_id) for people with a visible claim in the scope.

    ``small``: keys have few occurrences each, as articles; the people of an
    occurrence then travel in packs."""
    keys = [c for c in scope.columns if c != "occurrence_id"]
    if small:
        return distinct_members(gather(scope, FL.visible(claims).select("occurrence_id", "user_id")), "user_id").select(*keys, "user_id")
    return (FL.visible(claims).select("occurrence_id", "user_id")
            .join(scope, "occurrence_id").select(*keys, "user_id").distinct())


# -- J9-J13: self joins ---------------------------------------------------------------

def _role_rows(claims: DataFrame, kind: str) -> DataFrame:
    return FL.with_role(claims, kind).select("occurrence_id", "user_id").distinct()


def network(claims: DataFrame, left_role: str, right_role: str) -> DataFrame:
    """(user_id, other_id, shared) for people sharing a specimen.

    ``user_id`` holds ``left_role`` and ``other_id`` holds ``right_role`` on
    the same occurrence; ``shared`` counts the occurrences.
    """
    a = _role_rows(claims, left_role).withColumnRenamed("user_id", "user_id")
    b = _role_rows(claims, right_role).withColumnRenamed("user_id", "other_id")
    return (join_in_blocks(a, b, "occurrence_id").filter(F.col("user_id") != F.col("other_id"))
            .groupBy("user_id", "other_id").agg(F.count(F.lit(1)).alias("shared")))


def recorded_with(claims: DataFrame) -> DataFrame:
    """Co-collectors."""
    return network(claims, "recorded", "recorded")


def identified_for(claims: DataFrame) -> DataFrame:
    """user_id identified specimens that other_id collected."""
    return network(claims, "identified", "recorded")


def identified_by(claims: DataFrame) -> DataFrame:
    """other_id identified specimens that user_id collected."""
    return network(claims, "recorded", "identified")


def specimens_of_pair(claims: DataFrame, left_role: str, right_role: str) -> DataFrame:
    """(user_id, other_id, occurrence_id) behind each pair of J9-J11."""
    a = FL.with_role(claims, left_role).select("occurrence_id", "user_id")
    b = _role_rows(claims, right_role).withColumnRenamed("user_id", "other_id")
    return join_in_blocks(a, b, "occurrence_id").filter(F.col("user_id") != F.col("other_id"))


def agents_recorded_with(occurrence_agents: DataFrame) -> DataFrame:
    """(agent_id, other_agent_id) sharing an occurrence the agent recorded.

    An occurrence's agents travel to each recorder as lists and meet there once,
    instead of a row per pair and occurrence.
    """
    rec = occurrence_agents.filter(F.col("agent_role")).select("occurrence_id", "agent_id").distinct()
    anyrole = occurrence_agents.select("occurrence_id", F.col("agent_id").alias("other_agent_id")).distinct()
    met = distinct_members(gather(rec.select("agent_id", "occurrence_id"), anyrole), "other_agent_id")
    return met.filter(F.col("agent_id") != F.col("other_agent_id")).select("agent_id", "other_agent_id")


def same_family(agents: DataFrame, first_initial: bool = False) -> DataFrame:
    """(agent_id, other_agent_id) with the same family (and first given initial).

    Agents without a family name (unparsed ones) have no namesakes; with
    ``first_initial`` neither have those without a given name.
    """
    a = agents.filter(F.col("family") != "").select(F.col("id").alias("agent_id"), "family",
                      F.lower(F.substring("given", 1, 1)).alias("initial"))
    keys = ["family", "initial"] if first_initial else ["family"]
    a = (a.filter(F.col("initial") != "") if first_initial else a).select("agent_id", *keys)
    out = pair_members(a, a.withColumnRenamed("agent_id", "other_agent_id"), keys)
    out = out.filter(F.col("agent_id") != F.col("other_agent_id"))
    return out.select("agent_id", "other_agent_id", "family")


# -- J15-J17: interval joins ------------------------------------------------------------

def _year_col(kind: str) -> str:
    return "eventDate_processed_year" if kind == "recorded" else "dateIdentified_processed_year"


def employment_specimens(organizations: DataFrame, user_organizations: DataFrame, claims: DataFrame,
                         occurrences: DataFrame, kind: str = "recorded") -> DataFrame:
    """Specimens of members deposited at other institutions during membership.

    Equi-join on user_id plus a range residual on the year; the organisation's
    earliest start year (default 1600) bounds the years as well.
    """
    year = _year_col(kind)
    first_start = (user_organizations.groupBy("organization_id")
                   .agg(F.coalesce(F.min("start_year"), F.lit(1600)).alias("org_first_start")))
    uo = user_organizations.join(first_start, "organization_id")
    c = claims.filter(F.col("action").contains(kind)).select("user_id", "occurrence_id")
    occ = occurrences.filter(F.col("institutionCode").isNotNull()).select(
        F.col("gbifID").alias("occurrence_id"), "institutionCode", F.col(year).alias("y"))
    orgs = organizations.select(F.col("id").alias("organization_id"), "institution_codes")
    j = (uo.join(c, "user_id").join(occ, "occurrence_id").join(orgs, "organization_id"))
    in_range = ((F.col("end_year").isNull() & (F.col("y") >= F.col("start_year")))
                | (F.col("end_year").isNotNull() & F.col("start_year").isNotNull()
                   & (F.col("y") >= F.col("start_year")) & (F.col("y") <= F.col("end_year"))))
    not_own = ~F.array_contains("institution_codes", F.col("institutionCode"))
    return (j.filter(in_range & not_own & (F.col("y") >= F.col("org_first_start")))
            .select("organization_id", "user_id", "occurrence_id", "institutionCode", "y"))


def employment_specimens_in_year(organizations: DataFrame, user_organizations: DataFrame,
                                 claims: DataFrame, occurrences: DataFrame, year: int,
                                 kind: str = "recorded") -> DataFrame:
    """Same as J15 for the memberships that contain ``year``."""
    ycol = _year_col(kind)
    uo = user_organizations.filter((F.col("end_year").isNull() & (F.col("start_year") <= year))
                                   | ((F.col("start_year") <= year) & (F.col("end_year") >= year)))
    c = claims.filter(F.col("action").contains(kind)).select("user_id", "occurrence_id")
    occ = occurrences.filter(F.col("institutionCode").isNotNull() & (F.col(ycol) == year)).select(
        F.col("gbifID").alias("occurrence_id"), "institutionCode")
    orgs = organizations.select(F.col("id").alias("organization_id"), "institution_codes")
    return (uo.join(c, "user_id").join(occ, "occurrence_id").join(orgs, "organization_id")
            .filter(~F.array_contains("institution_codes", F.col("institutionCode")))
            .select("organization_id", "user_id", "occurrence_id", "institutionCode"))


def org_articles(user_organizations: DataFrame, claims: DataFrame, occurrences: DataFrame,
                 article_occurrences: DataFrame) -> DataFrame:
    """(organization_id, article_id, user_id) for articles citing specimens
    collected or identified during a membership (current or past)."""
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"),
                             F.col("eventDate_processed_year").alias("ey"),
                             F.col("dateIdentified_processed_year").alias("iy"))
    c = FL.visible(claims).select("user_id", "occurrence_id")
    j = user_organizations.join(c, "user_id").join(occ, "occurrence_id")
    s, e = F.col("start_year"), F.col("end_year")
    current = (e.isNull() & (F.col("ey") > 1900) & (s > 1900) & ((F.col("ey") >= s) | (F.col("iy") >= s)))
    past = (e.isNotNull() & s.isNotNull()
            & (((F.col("ey") >= s) & (F.col("ey") <= e)) | ((F.col("iy") >= s) & (F.col("iy") <= e))))
    links = j.filter(current | past).select("occurrence_id", "organization_id", "user_id")
    found = distinct_members(gather(article_occurrences.select("article_id", "occurrence_id"), links), "m")
    return found.select("m.organization_id", "article_id", "m.user_id")


# -- J18-J20: theta joins on life dates ------------------------------------------------

def claims_outside_life(users: DataFrame, claims: DataFrame, occurrences: DataFrame,
                        kind: str = "recorded", when: str = "before_birth", as_of=None) -> DataFrame:
    """Visible claims by others dated on/before birth, or on/after death
    (and not in the future), for recordings (event date) or identifications."""
    field = "eventDate_processed" if kind == "recorded" else "dateIdentified_processed"
    c = FL.claims_received(claims).filter(P.role(kind))
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), F.col(field).alias("d"))
    u = users.select(F.col("id").alias("user_id"), "date_born", "date_died")
    j = c.join(u, "user_id").join(occ, "occurrence_id")
    if when == "before_birth":
        cond = F.col("d") <= F.col("date_born")
    else:
        cond = (F.col("d") >= F.col("date_died")) & (F.col("d") <= S._as_of(as_of))
    return j.filter(cond).select("user_id", "occurrence_id", "created_by", "created", "d")


def lifespan_violations(users: DataFrame, claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Recorded claims (any visibility) with born >= event or died <= event."""
    c = claims.filter(P.rec()).select("user_id", "occurrence_id")
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), "datasetKey", "eventDate_processed")
    u = users.select(F.col("id").alias("user_id"), "date_born", "date_died")
    return (c.join(u, "user_id").join(occ, "occurrence_id")
            .filter((F.col("date_born") >= F.col("eventDate_processed"))
                    | (F.col("date_died") <= F.col("eventDate_processed")))
            .select("datasetKey", "user_id", "occurrence_id"))


def date_warnings(users: DataFrame, claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Visible claims dated on or outside the resolved life dates of a person
    with a birth date, where the specimen names a recorder or a determiner."""
    u = (users.filter(F.col("date_born").isNotNull())
         .select(F.col("id").alias("user_id"),
                 S.resolved_date("date_born", "date_born_precision").alias("born"),
                 S.resolved_date("date_died", "date_died_precision").alias("died")))
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), "eventDate_processed",
                             "dateIdentified_processed", "recordedBy", "identifiedBy")
    j = FL.visible(claims).select("user_id", "occurrence_id", "action").join(u, "user_id").join(occ, "occurrence_id")
    rec_bad = P.rec() & F.col("recordedBy").isNotNull() & ((F.col("eventDate_processed") <= F.col("born"))
                         | (F.col("eventDate_processed") >= F.col("died")))
    idn_bad = P.idn() & F.col("identifiedBy").isNotNull() & ((F.col("dateIdentified_processed") <= F.col("born"))
                         | (F.col("dateIdentified_processed") >= F.col("died")))
    return (j.withColumn("collected_warning", F.coalesce(rec_bad, F.lit(False)))
            .withColumn("identified_warning", F.coalesce(idn_bad, F.lit(False)))
            .filter(F.col("collected_warning") | F.col("identified_warning"))
            .select("user_id", "occurrence_id", "collected_warning", "identified_warning"))


# -- J21-J32 ------------------------------------------------------------------------------

def agents_of(scope: DataFrame, occurrence_agents: DataFrame, agents: DataFrame,
              role: bool | None = None, small: bool = False) -> DataFrame:
    """(scope key, agent_id) of named agents linked to the scope, optionally by role; ``small`` as in J8."""
    keys = [c for c in scope.columns if c != "occurrence_id"]
    oa = occurrence_agents if role is None else occurrence_agents.filter(F.col("agent_role") == role)
    named = agents.filter(F.col("family") != "").select(F.col("id").alias("agent_id"))
    if small:
        links = oa.select("occurrence_id", "agent_id").join(named, "agent_id", "left_semi").select("occurrence_id", "agent_id")
        return distinct_members(gather(scope, links), "agent_id").select(*keys, "agent_id")
    return (scope.join(oa.select("occurrence_id", "agent_id"), "occurrence_id")
            .select(*keys, "agent_id").distinct().join(named, "agent_id", "left_semi"))


def cited_specimens(claims: DataFrame, article_occurrences: DataFrame) -> DataFrame:
    """Visible claims used in articles: (user_id, article_id, occurrence_id)."""
    return (FL.visible(claims).select("user_id", "occurrence_id")
            .join(article_occurrences, "occurrence_id"))


def articles_citing(articles: DataFrame, claims: DataFrame, article_occurrences: DataFrame) -> DataFrame:
    """(user_id, article) pairs, distinct; the article joins its people before they are rows."""
    cited = article_occurrences.select(F.col("article_id").alias("id"), "occurrence_id")
    people = gather(cited, FL.visible(claims).select("occurrence_id", "user_id"))
    return distinct_members(people.join(parts_of(articles, cited, ["id"]), ["id", "_part"]), "user_id")


def claimed_candidates(person_agents: DataFrame, occurrence_agents: DataFrame, claims: DataFrame,
                       shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(user_id, agent_id, occurrence_id): specimens of a person's matched agents that the person has claimed or
    rejected, once each; a claim meets the links of its person's list (``shared``: those of ``person_agents``)."""
    people, lists = shared or SH.share(person_agents.select("user_id", "agent_id"))
    links = SH.listed_links(lists.select("list", "agent_id").distinct(), occurrence_agents.select("occurrence_id", "agent_id").distinct())
    return join_in_blocks(SH.held(people, claims), links, ["list", "occurrence_id"]).select("user_id", "agent_id", "occurrence_id")


def unclaimed_candidates(person_agents: DataFrame, occurrence_agents: DataFrame,
                         claims: DataFrame) -> DataFrame:
    """(user_id, occurrence_id, agent_id) candidate occurrences of a person's
    matched agents that the person has not claimed or rejected.

    Candidates are made once for all people with the same agents and unfolded where a
    person, with the claims they have among them, meets them."""
    people, lists = SH.share(person_agents.select("user_id", "agent_id"))
    links = occurrence_agents.select("agent_id", "occurrence_id")
    buckets = SH.sizes(lists, links)
    packs = SH.pack(SH.listed_links(lists, links), buckets, [], ["occurrence_id", "agent_id"], "occurrence_id")
    return SH.unclaimed(people, packs, buckets, claims, [], ["occurrence_id", "agent_id"])


def merge_by_id(scores: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    """Full outer merge where the later side wins; rows without a count dropped."""
    cols = [c for c in set(scores.columns) | set(counts.columns) if c != key]
    s = scores.select(key, *[F.col(c).alias(f"_s_{c}") for c in scores.columns if c != key])
    n = counts.select(key, *[F.col(c).alias(f"_n_{c}") for c in counts.columns if c != key])
    j = s.join(n, key, "full_outer")
    out = j.select(key, *[F.coalesce(*([F.col(f"_n_{c}")] if c in counts.columns else [])
                                     + ([F.col(f"_s_{c}")] if c in scores.columns else [])).alias(c)
                          for c in sorted(cols)])
    count_col = next(c for c in counts.columns if c != key)
    return out.filter(F.col(count_col).isNotNull())


def collector_network(claims: DataFrame) -> DataFrame:
    """For each occurrence, the co-collectors of its claimed collectors who
    are not themselves claimed on it: (occurrence_id, user_id).

    A collector's co-collectors travel in packs, dealt by occurrence together with
    the people claimed on it; an occurrence whose collectors bring more than ``MET``
    co-collectors is dealt in parts by co-collector.
    """
    rec = _role_rows(claims, "recorded")
    edges = recorded_with(claims).select(F.col("user_id").alias("collector"), F.col("other_id").alias("other"))
    degrees = edges.groupBy("collector").agg(F.count(F.lit(1)).alias("degree"))
    pack = F.pmod(F.xxhash64("other"), F.ceil(F.col("degree") / PACK))
    packs = (edges.join(degrees, "collector").groupBy("collector", pack.alias("pack"))
             .agg(F.sort_array(F.collect_list("other")).alias("others")).drop("pack"))
    asked = rec.withColumnRenamed("user_id", "collector")
    parts = (asked.join(degrees, "collector").groupBy(F.col("occurrence_id").alias("large")).agg(F.sum("degree").alias("met"))
             .filter(F.col("met") > MET).select("large", F.ceil(F.col("met") / MET).alias("parts")))
    asked = (asked.join(parts, F.expr("occurrence_id <=> large"), "left")
             .select("occurrence_id", "collector", F.coalesce("parts", F.lit(1).cast("long")).alias("parts")))
    none = F.expr("cast(array() as array<bigint>)")
    met = join_in_blocks(asked, packs, "collector").select("occurrence_id", "parts", "others",
                                                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    here = F.filter("others", lambda x: F.pmod(F.xxhash64(x), F.col("parts")) == F.col("part"))
    met = met.select("occurrence_id", "part", F.when(F.col("parts") == 1, F.col("others")).otherwise(here).alias("others"), none.alias("own"))
    own = (asked.filter("occurrence_id is not null and collector is not null")
           .select("occurrence_id", F.pmod(F.xxhash64("collector"), F.col("parts")).alias("part"), none.alias("others"),
                   F.array("collector").alias("own")))
    every = met.unionByName(own).groupBy("occurrence_id", "part").agg(
        F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("own")).alias("own"))
    return every.select("occurrence_id", F.explode(F.array_except("others", "own")).alias("user_id"))


def dataset_flags(datasets: DataFrame, occurrences: DataFrame, claims: DataFrame,
                  occurrence_agents: DataFrame) -> DataFrame:
    """has_claim (a visible claim) and has_agent (a linked agent) per dataset."""
    occ = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
    with_claim = occ.join(FL.visible(claims).select("occurrence_id"), "occurrence_id", "left_semi") \
        .select("datasetKey").distinct().withColumn("has_claim", F.lit(True))
    with_agent = occ.join(occurrence_agents.select("occurrence_id"), "occurrence_id", "left_semi") \
        .select("datasetKey").distinct().withColumn("has_agent", F.lit(True))
    return (datasets.select("datasetKey").join(with_claim, "datasetKey", "left")
            .join(with_agent, "datasetKey", "left")
            .select("datasetKey", F.coalesce("has_claim", F.lit(False)).alias("has_claim"),
                    F.coalesce("has_agent", F.lit(False)).alias("has_agent")))


def shared_claims(claims: DataFrame) -> DataFrame:
    """Claims whose occurrence has a visible claim by another person."""
    vis = FL.visible(claims).select("occurrence_id", F.col("user_id").alias("other_id"))
    per_occ = vis.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("n"),
                                               F.min("other_id").alias("lo"), F.max("other_id").alias("hi"))
    j = claims.join(per_occ, "occurrence_id")
    # another visible claimant exists if the occurrence has a visible claimant other than this person
    other = (F.col("lo") != F.col("user_id")) | (F.col("hi") != F.col("user_id"))
    return j.filter(other).drop("n", "lo", "hi")


def helped(claims: DataFrame) -> DataFrame:
    """(claimant_id, user_id) — people a claimant attributed to (visible, not self)."""
    return (FL.claims_given(claims).select(F.col("created_by").alias("claimant_id"), "user_id").distinct())


def same_organization_people(user_organizations: DataFrame) -> DataFrame:
    """(user_id, other_id) sharing an organisation.

    A pair is made at the smallest organisation the two share, so that pairs are not
    compared with each other: only two people of several organisations can meet
    again, and they bring the list of theirs along.
    """
    a = user_organizations.filter(F.col("user_id").isNotNull() & F.col("organization_id").isNotNull()).select("user_id", "organization_id").distinct()
    several = a.groupBy("user_id").agg(F.collect_list("organization_id").alias("all")).filter(F.size("all") > 1)
    a = a.join(several, "user_id", "left")
    b = a.select(F.col("user_id").alias("other_id"), "organization_id", F.col("all").alias("other_all"))
    first = F.array_min(F.array_intersect("all", "other_all"))
    return (join_in_blocks(a, b, "organization_id").filter(F.col("user_id") != F.col("other_id"))
            .filter(F.col("all").isNull() | F.col("other_all").isNull() | (F.col("organization_id") == first))
            .select("user_id", "other_id"))


def members(user_organizations: DataFrame, users: DataFrame, kind: str = "active") -> DataFrame:
    """(organization_id, user_id) of active, inactive or public members."""
    uo = user_organizations.select("organization_id", "user_id", "end_year")
    u = users.select(F.col("id").alias("user_id"), "wikidata", "is_public")
    j = uo.join(u, "user_id")
    if kind == "active":
        out = j.filter(F.col("end_year").isNull() & F.col("wikidata").isNull())
    elif kind == "public":
        out = j.filter(F.col("end_year").isNull() & F.col("is_public"))
    elif kind == "inactive":
        known_end = j.filter(F.col("end_year").isNotNull())
        unknown_end = j.filter(F.col("wikidata").isNotNull())
        out = known_end.select("organization_id", "user_id").union(unknown_end.select("organization_id", "user_id"))
    else:
        raise ValueError(kind)
    return out.select("organization_id", "user_id").distinct()
