"""Aggregations (G-series), all computed for every person / dataset / scope at once.

Each function returns a lazy DataFrame; filtering to one key is left to the
caller so Catalyst can push it down. Aggregations shuffle on their grouping
keys after a map-side partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.operators.pairs import counted_members, gather


def scope_of_occurrences(occurrences: DataFrame, scope: str) -> DataFrame:
    """(scope key, occurrence_id) pairs for scope ``datasetKey`` or ``family``."""
    return occurrences.select(F.col(scope), F.col("gbifID").alias("occurrence_id"))


def named_agent_links(occurrence_agents: DataFrame, agents: DataFrame) -> DataFrame:
    """occurrence_agents restricted to agents with a non-blank family."""
    named = agents.filter(F.col("family") != "").select(F.col("id").alias("agent_id"))
    return occurrence_agents.join(named, "agent_id", "left_semi")


def agent_counts(scope: DataFrame, occurrence_agents: DataFrame, agents: DataFrame,
                 claims: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(scope key, agent_id) -> count of specimen links.

    ``scope`` holds (key..., occurrence_id). With ``claims`` given, only
    occurrences without any claim row (visible or not) are counted (G13). ``small``:
    keys have few occurrences each, as articles; agents then travel in packs.
    """
    keys = [c for c in scope.columns if c != "occurrence_id"]
    if claims is not None:
        scope = scope.join(claims.select("occurrence_id"), "occurrence_id", "left_anti")
    links = named_agent_links(occurrence_agents, agents)
    if small:
        return counted_members(gather(scope, links.select("occurrence_id", "agent_id")), "agent_id", "count_all")
    return (scope.join(links, "occurrence_id")
            .groupBy(*keys, "agent_id")
            .agg(F.count(F.lit(1)).alias("count_all")))


# ---------------------------------------------------------------------------
# Per-person aggregates
# ---------------------------------------------------------------------------

def _visible(claims: DataFrame) -> DataFrame:
    return claims.filter(P.vis())


def _helped_only(claims: DataFrame, helped: bool) -> DataFrame:
    return claims.filter(F.col("created_by") != F.col("user_id")) if helped else claims


def families_by_role(claims: DataFrame, taxon_occurrences: DataFrame, kind: str = "recorded",
                     helped: bool = False) -> DataFrame:
    """(user_id, family, count) of visible claims in a role."""
    c = _helped_only(_visible(claims).filter(P.role(kind)), helped).select("user_id", "occurrence_id")
    return (c.join(taxon_occurrences, "occurrence_id")
            .groupBy("user_id", "family").agg(F.count(F.lit(1)).alias("n")))


def role_counts(claims: DataFrame) -> DataFrame:
    """One pass over visible claims: identified, recorded, all, both, either."""
    return (_visible(claims).groupBy("user_id")
            .agg(F.count_if(P.idn()).alias("identified"),
                 F.count_if(P.rec()).alias("recorded"),
                 F.count(F.lit(1)).alias("all_claims"),
                 F.count_if(P.both()).alias("both_roles"),
                 F.count_if(P.any_role()).alias("either_role")))


def country_counts(claims: DataFrame, occurrences: DataFrame, countries: DataFrame,
                   helped: bool = False) -> DataFrame:
    """(user_id, country, recorded, identified). Combined-role claims count in
    both; NULL and unknown codes are summed under ``OTHER``."""
    c = _helped_only(_visible(claims).filter(P.any_role()), helped).select("user_id", "occurrence_id", "action")
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"),
                             F.coalesce("countryCode", F.lit("ZZ")).alias("code"))
    known = countries.select(F.col("code").alias("code"), F.lit(True).alias("known"))
    j = c.join(occ, "occurrence_id").join(known, "code", "left")
    country = F.when(F.col("known"), F.col("code")).otherwise(F.lit("OTHER"))
    combined = P.both()
    return (j.groupBy("user_id", country.alias("country"))
            .agg(F.count_if((F.col("action") == P.RECORDED) | combined).alias("recorded"),
                 F.count_if((F.col("action") == P.IDENTIFIED) | combined).alias("identified")))


def distinct_countries(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Number of distinct country codes of a person's recordings."""
    c = _visible(claims).filter(P.rec()).select("user_id", F.col("occurrence_id").alias("gbifID"))
    return (c.join(occurrences.select("gbifID", "countryCode"), "gbifID")
            .groupBy("user_id").agg(F.count_distinct("countryCode").alias("countries")))


def families_countries(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Distinct (user_id, role, family, countryCode); combined claims go to recorded."""
    c = _visible(claims).filter(P.any_role()).select("user_id", F.col("occurrence_id").alias("gbifID"), "action")
    j = c.join(occurrences.select("gbifID", "family", "countryCode"), "gbifID").filter(F.col("family").isNotNull())
    role_col = (F.when(F.col("action").contains("recorded"), F.lit("recorded"))
                .when(F.col("action").contains("identified"), F.lit("identified")))
    return j.select("user_id", role_col.alias("role"), "family", "countryCode").distinct()


def year_bins(claims: DataFrame, occurrences: DataFrame, kind: str = "recorded", width: int = 5,
              helped: bool = False, as_of=None) -> DataFrame:
    """(user_id, bin, n) with bins floor(year/width)*width, zero-filled
    between each person's first and last bin. Dates after ``as_of`` are left out."""
    field = "eventDate_processed" if kind == "recorded" else "dateIdentified_processed"
    c = _helped_only(_visible(claims).filter(P.role(kind)), helped).select(
        "user_id", F.col("occurrence_id").alias("gbifID"))
    limit = F.lit(as_of) if as_of is not None else F.current_date()
    occ = occurrences.filter(F.col(f"{field}_year").isNotNull() & (F.col(field) <= limit)).select(
        "gbifID", (F.floor(F.col(f"{field}_year") / width) * width).cast("int").alias("bin"))
    counts = c.join(occ, "gbifID").groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy("user_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = spans.select("user_id", F.explode(F.sequence("lo", "hi", F.lit(width))).alias("bin"))
    return (grid.join(counts, ["user_id", "bin"], "left")
            .select("user_id", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def deposited_at(claims: DataFrame, occurrences: DataFrame, kind: str = "recorded") -> DataFrame:
    """(user_id, institutionCode, n) of visible claims in a role."""
    c = _visible(claims).filter(P.role(kind)).select("user_id", F.col("occurrence_id").alias("gbifID"))
    return (c.join(occurrences.filter(F.col("institutionCode").isNotNull()).select("gbifID", "institutionCode"),
                   "gbifID")
            .groupBy("user_id", "institutionCode").agg(F.count(F.lit(1)).alias("n")))


def collector_strings(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(user_id, recordedBy, n) of a person's visible recordings."""
    c = _visible(claims).filter(P.rec()).select("user_id", F.col("occurrence_id").alias("gbifID"))
    return (c.join(occurrences.select("gbifID", "recordedBy"), "gbifID")
            .groupBy("user_id", "recordedBy").agg(F.count(F.lit(1)).alias("n")))


def helped_counts(claims: DataFrame) -> DataFrame:
    """(claimant_id, user_id, n, latest) of visible claims made for others."""
    return (_visible(claims).filter(F.col("created_by") != F.col("user_id"))
            .groupBy(F.col("created_by").alias("claimant_id"), "user_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max("created").alias("latest")))


def latest_attribution(claims: DataFrame) -> DataFrame:
    """Per person greatest(max created, max updated) of visible claims."""
    return (_visible(claims).groupBy("user_id")
            .agg(F.greatest(F.max("created"), F.coalesce(F.max("updated"), F.max("created"))).alias("latest")))


def lifelist_rank(claims: DataFrame, taxon_occurrences: DataFrame) -> DataFrame:
    """Number of distinct families a person recorded."""
    c = _visible(claims).filter(P.rec()).select("user_id", "occurrence_id")
    return (c.join(taxon_occurrences, "occurrence_id").groupBy("user_id")
            .agg(F.count_distinct("family").alias("rank")))


# ---------------------------------------------------------------------------
# Per-scope aggregates
# ---------------------------------------------------------------------------

def source_counts(occurrences: DataFrame) -> DataFrame:
    """G1: rows per dataset carrying a source person id."""
    return (occurrences.filter(F.col("recordedByID").isNotNull() | F.col("identifiedByID").isNotNull())
            .groupBy("datasetKey").agg(F.count(F.lit(1)).alias("n")))


def timeline(claims: DataFrame, occurrences: DataFrame, scope: str, kind: str = "recorded",
             start_year: int = 1000, end_year: int | None = None) -> DataFrame:
    """(scope, user_id, min_date, max_date) of visible claims in a role
    whose year lies in [start_year, end_year]."""
    field = "eventDate_processed" if kind == "recorded" else "dateIdentified_processed"
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), scope, F.col(field).alias("d"),
                             F.col(f"{field}_year").alias("y"))
    if end_year is None:
        end_year = 9999
    occ = occ.filter(F.col("y").between(start_year, end_year) & F.col("d").isNotNull())
    c = _visible(claims).filter(P.role(kind)).select("user_id", "occurrence_id")
    return (c.join(occ, "occurrence_id").groupBy(scope, "user_id")
            .agg(F.min("d").alias("min_date"), F.max("d").alias("max_date")))


def dataset_progress(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """Total, claimed (distinct visible) and unclaimed occurrences per dataset."""
    occ = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
    claimed = (occ.join(_visible(claims).select("occurrence_id").distinct(), "occurrence_id")
               .groupBy("datasetKey").agg(F.count(F.lit(1)).alias("claimed")))
    total = occ.groupBy("datasetKey").agg(F.count(F.lit(1)).alias("total"))
    return (total.join(claimed, "datasetKey", "left")
            .select("datasetKey", "total", F.coalesce("claimed", F.lit(0)).cast("bigint").alias("claimed"))
            .withColumn("unclaimed", F.greatest(F.col("total") - F.col("claimed"), F.lit(0)).cast("bigint")))


def code_counts(occurrences: DataFrame, code: str) -> DataFrame:
    """(datasetKey, code, n) for institutionCode or collectionCode; NULL codes skipped."""
    return (occurrences.filter(F.col(code).isNotNull()).groupBy("datasetKey", code)
            .agg(F.count(F.lit(1)).alias("n")))


def code_lists(occurrences: DataFrame, code: str) -> DataFrame:
    """Sorted distinct codes per dataset, joined by ``|``."""
    return (occurrences.filter(F.col(code).isNotNull()).select("datasetKey", code).distinct()
            .groupBy("datasetKey").agg(F.array_join(F.sort_array(F.collect_list(code)), "|").alias("codes")))


def scribes(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """(datasetKey, scribe_id): claimants of visible claims for others, not bots."""
    c = (_visible(claims).filter((F.col("created_by") != F.col("user_id")) & ~P.is_bot("created_by"))
         .select("occurrence_id", "created_by"))
    occ = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
    return c.join(occ, "occurrence_id").select("datasetKey", F.col("created_by").alias("scribe_id")).distinct()


def article_stats(article_occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """Per article distinct claimed specimens and total linked specimens."""
    vis = _visible(claims).select("occurrence_id").distinct()
    claimed = (article_occurrences.join(vis, "occurrence_id").groupBy("article_id")
               .agg(F.count(F.lit(1)).alias("claimed")))
    total = article_occurrences.groupBy("article_id").agg(F.count(F.lit(1)).alias("total"))
    return (total.join(claimed, "article_id", "left")
            .select("article_id", "total", F.coalesce("claimed", F.lit(0)).cast("bigint").alias("claimed")))


def article_user_counts(article_occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """(article_id, user_id, n) visible claims of a person cited by the article."""
    cited = article_occurrences.select("article_id", "occurrence_id")
    return counted_members(gather(cited, _visible(claims).select("occurrence_id", "user_id")), "user_id", "n")


def occurrence_counts(claims: DataFrame, occurrence_agents: DataFrame) -> DataFrame:
    """Occurrences with more than one recorded claim (any visibility), with
    their recorder-agent count; counts of NULL, 1 or 2 agents dropped."""
    users = (claims.filter(F.col("action").like("%recorded%")).groupBy("occurrence_id")
             .agg(F.count(F.lit(1)).alias("user_count")).filter(F.col("user_count") > 1))
    agents = (occurrence_agents.filter(F.col("agent_role")).groupBy("occurrence_id")
              .agg(F.count_distinct("agent_id").alias("agent_count")))
    return (users.join(agents, "occurrence_id", "left")
            .filter(F.col("agent_count").isNotNull() & ~F.col("agent_count").isin(1, 2)))


def recorder_report(occurrence_agents: DataFrame, occurrences: DataFrame, as_of=None) -> DataFrame:
    """Per recorder agent: specimens, range of the years as written, first and last
    valid year (P22), families, institution codes.

    Lists are as long as there are distinct families and codes, not specimens."""
    from herbaria.functions import scalars as S
    links = occurrence_agents.filter(F.col("agent_role")).select("agent_id", F.col("occurrence_id").alias("gbifID"))
    occ = occurrences.select("gbifID", "family", "institutionCode", "year", S.valid_year("year", as_of).alias("valid"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    return (links.join(occ, "gbifID").groupBy("agent_id")
            .agg(F.count(F.lit(1)).alias("n"), F.concat_ws("–", F.min("year"), F.max("year")).alias("event_range"),
                 F.min("valid").alias("min_year"), F.max("valid").alias("max_year"),
                 joined("family").alias("families"), joined("institutionCode").alias("institutions")))


def agent_profile_values(occurrence_agents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(agent_id, agent_role, kind, value, n): the distinct institutions, countries, scientific
    names and, for recordings, coordinates of each agent, with their specimens.

    Long form: an agent may have any number of coordinates and names. Each specimen
    link is read once; equal values combine in the map tasks.
    """
    from herbaria.functions import scalars as S
    links = occurrence_agents.select("agent_id", "agent_role", F.col("occurrence_id").alias("gbifID"))
    occ = occurrences.select("gbifID", "institutionCode", "countryCode", "scientificName", S.coordinates().alias("at"))
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    place = F.when(F.col("agent_role"), F.concat_ws(",", F.transform("at", lambda x: x.cast("string"))))
    facts = F.array(value("institution", F.col("institutionCode")), value("country", F.col("countryCode")),
                    value("name", F.col("scientificName")), value("coordinates", F.when(F.col("at").isNotNull(), place)))
    return (links.join(occ, "gbifID").select("agent_id", "agent_role", F.explode(facts).alias("f"))
            .select("agent_id", "agent_role", "f.*").filter("value <> ''")
            .groupBy("agent_id", "agent_role", "kind", "value").agg(F.count(F.lit(1)).alias("n")))


def agent_profile(occurrence_agents: DataFrame, occurrences: DataFrame, as_of=None) -> DataFrame:
    """Per agent and role: numbers of distinct institutions, countries, names and coordinates, and
    the range of years (of the event, or else the year; of the identification)."""
    from herbaria.functions import scalars as S
    values = agent_profile_values(occurrence_agents, occurrences)
    number = lambda kind: F.count(F.when(F.col("kind") == kind, F.lit(1)))
    counts = values.groupBy("agent_id", "agent_role").agg(
        number("institution").alias("institutions"), number("country").alias("countries"),
        number("name").alias("names"), number("coordinates").alias("coordinates"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    event = S.valid_year(F.coalesce(given("eventDate"), given("year")), as_of)
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), event.alias("event"), S.valid_year("dateIdentified", as_of).alias("det"))
    year = F.when(F.col("agent_role"), F.col("event")).otherwise(F.col("det"))
    years = (occurrence_agents.join(occ, "occurrence_id").groupBy("agent_id", "agent_role")
             .agg(F.min(year).alias("min_year"), F.max(year).alias("max_year")))
    zero = F.lit(0).cast("long")
    return years.join(counts, ["agent_id", "agent_role"], "left").select(
        "agent_id", "agent_role", *[F.coalesce(c, zero).alias(c) for c in ("institutions", "countries", "names", "coordinates")],
        "min_year", "max_year")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Per person: orphan count and the sorted distinct claimant ids."""
    return (orphans.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array_join(F.sort_array(F.collect_set(F.col("created_by").cast("string"))), ",")
                 .alias("claimants")))


def dataset_counters(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """Occurrences per dataset and claims made by the source agent per dataset."""
    occ = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
    total = occ.groupBy("datasetKey").agg(F.count(F.lit(1)).alias("occurrences_count"))
    src = (claims.filter(F.col("created_by") == P.SOURCE_AGENT_ID).select("occurrence_id")
           .join(occ, "occurrence_id").groupBy("datasetKey")
           .agg(F.count(F.lit(1)).alias("source_attribution_count")))
    return (total.join(src, "datasetKey", "left")
            .select("datasetKey", "occurrences_count",
                    F.coalesce("source_attribution_count", F.lit(0)).cast("bigint").alias("source_attribution_count")))


def duplicate_values(organizations: DataFrame, attr: str) -> DataFrame:
    """Organisations whose ``attr`` value is shared with another organisation."""
    dup = (organizations.filter(F.col(attr).isNotNull()).groupBy(attr)
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(attr))
    return organizations.join(dup, attr, "left_semi")


def country_people(users: DataFrame) -> DataFrame:
    """People per country code of the pipe list."""
    codes = users.select(F.explode(F.split("country_code", r"\|")).alias("code")).filter(F.col("code") != "")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def scribe_stats(claims: DataFrame) -> DataFrame:
    """Attributions made for others (non-NULL action, non-bot claimant), distinct
    scribes and distinct recipients: claims per (scribe, recipient) pair first, then
    people of either side, so no row is copied for a distinct count."""
    c = claims.filter(F.col("action").isNotNull() & ~P.is_bot("created_by")
                      & (F.col("user_id") != F.col("created_by")))
    pairs = c.groupBy("created_by", "user_id").agg(F.count(F.lit(1)).alias("n"))
    people = F.explode(F.array(F.struct(F.lit(True).alias("scribe"), F.col("created_by").alias("id"), "n"),
                               F.struct(F.lit(False).alias("scribe"), F.col("user_id").alias("id"), F.lit(0).cast("long").alias("n"))))
    sides = pairs.select(people.alias("p")).select("p.*").groupBy("scribe", "id").agg(F.sum("n").alias("n"))
    return sides.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("attribution_count"), F.count_if("scribe").alias("scribe_count"),
                     F.count_if(~F.col("scribe")).alias("recipient_count"))


def monthly(claims: DataFrame, kind: str, as_of) -> DataFrame:
    """Per (year, month) count before the first day of ``as_of``'s month,
    with a running total (N1). ``kind`` is claims / attributions / rejected."""
    from herbaria.operators.windows import running_total
    c = claims.filter(~P.is_bot("created_by"))
    if kind == "claims":
        c = c.filter(P.vis() & (F.col("created_by") == F.col("user_id")))
    elif kind == "attributions":
        c = c.filter(P.vis() & (F.col("created_by") != F.col("user_id")))
    elif kind == "rejected":
        c = c.filter(F.col("visible") == F.lit(False))
    else:
        raise ValueError(kind)
    first_of_month = F.trunc(F.lit(as_of).cast("date"), "month").cast("timestamp_ntz")
    c = c.filter(F.col("created") < first_of_month)
    counts = c.groupBy(F.year("created").alias("year"), F.month("created").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    return running_total(counts, "n", "total")


def monthly_profiles(users: DataFrame, as_of) -> DataFrame:
    """Per month profiles with wikidata / ORCID and their running totals."""
    from herbaria.operators.windows import running_total
    first_of_month = F.trunc(F.lit(as_of).cast("date"), "month").cast("timestamp_ntz")
    counts = (users.filter(F.col("created") < first_of_month)
              .groupBy(F.year("created").alias("year"), F.month("created").alias("month"))
              .agg(F.count("wikidata").alias("wikidata_n"), F.count("orcid").alias("orcid_n")))
    return running_total(running_total(counts, "wikidata_n", "wikidata_total"), "orcid_n", "orcid_total")


def profile_totals(users: DataFrame) -> DataFrame:
    """Per identifier kind: total, visited, public, with deposit. A person with both ids counts in both."""
    kinds = F.array(F.when(F.col("orcid").isNotNull(), F.lit("orcid")), F.when(F.col("wikidata").isNotNull(), F.lit("wikidata")))
    return (users.select(F.explode(kinds).alias("kind"), "visited", "is_public", "zenodo_doi").filter("kind is not null").groupBy("kind")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("visited")).alias("visited"),
                 F.count_if(F.col("is_public")).alias("public"), F.count("zenodo_doi").alias("doi")))


def site_totals(datasets: DataFrame, dataset_counts: DataFrame, destroyed: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, n): datasets, datasets with source attributions, merged Wikidata people, claims of the source."""
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return (row(datasets, "datasets").unionByName(row(dataset_counts.filter("source_attribution_count > 0"), "datasets_with_identifiers"))
            .unionByName(row(destroyed.filter("identifier like 'Q%'"), "wikidata_merged"))
            .unionByName(row(claims.filter(F.col("created_by") == P.SOURCE_AGENT_ID), "source_claims")))


def org_user_counts(user_organizations: DataFrame) -> DataFrame:
    """Members per organisation."""
    return user_organizations.groupBy("organization_id").agg(F.count("user_id").alias("user_count"))


def others_tally(employment: DataFrame) -> DataFrame:
    """J15/J16 rows tallied per (organisation, institutionCode)."""
    return employment.groupBy("organization_id", "institutionCode").agg(F.count(F.lit(1)).alias("n"))


def unattributed_by_agent(person_agents: DataFrame, occurrence_agents: DataFrame, claims: DataFrame) -> DataFrame:
    """(user_id, agent_id, n): unclaimed candidate occurrences (J25) per matched agent.

    Counted without listing them: the agent's occurrences less those the person has.
    The counts travel in packs to all people with the same agents.
    """
    from herbaria.operators import shared as SH
    from herbaria.operators.joins import claimed_candidates
    shared = people, lists = SH.share(person_agents.select("user_id", "agent_id"))
    all_ = (occurrence_agents.select("agent_id", "occurrence_id").distinct()
            .groupBy("agent_id").agg(F.count(F.lit(1)).alias("linked")))
    counts = lists.distinct().join(all_, "agent_id")
    buckets = SH.kept(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SH.STRETCH).alias("buckets")))
    packs = SH.pack(counts, buckets, [], ["agent_id", "linked"], "agent_id")
    had = (claimed_candidates(person_agents, occurrence_agents, claims, shared).groupBy("user_id", "agent_id").agg(F.count(F.lit(1)).alias("had"))
           .join(people, "user_id").join(buckets, "list")
           .groupBy("user_id", F.pmod(F.xxhash64("agent_id"), F.col("buckets")).alias("bucket")).agg(F.collect_list(F.struct("agent_id", "had")).alias("had")))
    met = SH.meet(SH.per_bucket(people, packs, had), people, packs, "bucket")
    rows = (met.select("user_id", F.col("had.agent_id").alias("_agents"), F.col("had.had").alias("_had"), F.explode("rows").alias("_r"))
            .select("user_id", "_r.agent_id", "_r.linked", "_agents", "_had"))
    less = F.when(F.array_contains("_agents", F.col("agent_id")), F.get("_had", F.array_position("_agents", F.col("agent_id")).cast("int") - 1))
    return rows.select("user_id", "agent_id", (F.col("linked") - F.coalesce(less, F.lit(0))).alias("n")).filter("n > 0")


def unattributed_counts(person_agents: DataFrame, occurrence_agents: DataFrame, claims: DataFrame) -> DataFrame:
    """Distinct unclaimed candidate occurrences (J25) per person.

    Occurrences of a set of agents are counted once for all people matched with the
    same set, then those the person has are taken off.
    """
    from herbaria.operators import shared as SH
    from herbaria.operators.joins import claimed_candidates
    shared = people, lists = SH.share(person_agents.select("user_id", "agent_id").filter(F.col("agent_id").isNotNull()))
    links = occurrence_agents.select("agent_id", "occurrence_id").distinct()
    all_ = (SH.listed_links(lists.distinct(), links).select("list", "occurrence_id").distinct()
            .groupBy("list").agg(F.count(F.lit(1)).alias("linked")))
    had = (claimed_candidates(person_agents, occurrence_agents, claims, shared).select("user_id", "occurrence_id").distinct()
           .groupBy("user_id").agg(F.count(F.lit(1)).alias("had")))
    return (people.join(all_, "list").join(had, "user_id", "left")
            .select("user_id", (F.col("linked") - F.coalesce("had", F.lit(0))).alias("n")).filter("n > 0"))


def download_totals(articles: DataFrame, downloads: DataFrame) -> DataFrame:
    """Per article the sum of record totals over its download keys."""
    keys = articles.select(F.col("id").alias("article_id"), F.explode("gbif_downloadkeys").alias("key"))
    return (keys.join(downloads, "key").groupBy("article_id")
            .agg(F.sum("total_records").cast("bigint").alias("total_records")))
