"""Composite jobs (B-series): whole refresh and report runs built from operators.

Each job returns DataFrames (or writes them with ``sources.writers``); nothing
is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.functions import scalars as S
from herbaria.operators import filters as FL
from herbaria.operators import sets as X


def occurrence_refresh(raw: DataFrame, as_of=None, order: tuple[str, ...] = ("source_row", "source_line")) -> DataFrame:
    """B1: admit records (F1), one row per gbifID by a declared order (X1), then
    clean (P1-P5). The de-duplication is the only shuffle."""
    admitted = FL.admit_records(raw, identified_by="v_identifiedBy", recorded_by="v_recordedBy")
    order_cols = [c for c in order if c in admitted.columns]
    deduped = X.dedupe_occurrences(admitted, order_cols).drop(*order_cols)
    return S.clean_occurrences(deduped, as_of=as_of)


def agent_build(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: parsed names -> agents and (agent, role, occurrence) links.

    U2 expands the JSON names, once for all jobs with the same ones (a job with none
    keeps one row and falls back to its raw string), P8-P10 build the nine-part key, X3 keeps distinct
    keys, the surrogate id is the SHA-256 of the key (no read-back from a
    database, and no two keys with one id), U3 explodes both id lists and X2 de-duplicates the links.
    """
    from herbaria.operators import enrich as U
    names = U.expand_names(jobs.select("agents", "parsed").distinct())
    cols = [F.col("name")[f].alias(f) for f in S.NAME_FIELDS]
    named = names.select("agents", "parsed", *cols)
    keyed = S.agent_key(named, raw="agents")
    key_id = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in S.AGENT_KEY])), 256)
    keyed = keyed.withColumn("agent_id", key_id)
    agents = keyed.select("agent_id", *S.AGENT_KEY).distinct()
    ids = keyed.select(F.col("agents").alias("_agents"), F.col("parsed").alias("_parsed"), "agent_id")
    same = F.col("agents").eqNullSafe(F.col("_agents")) & F.col("parsed").eqNullSafe(F.col("_parsed"))
    of = lambda lists: jobs.select("agents", "parsed", lists).join(ids, same).select("agent_id", lists)
    rec = U.expand_ids(of("gbifIDs_recordedBy"), "gbifIDs_recordedBy")
    idn = U.expand_ids(of("gbifIDs_identifiedBy"), "gbifIDs_identifiedBy")
    links = X.union_roles(rec.select("agent_id", "occurrence_id"), idn.select("agent_id", "occurrence_id"))
    return agents, links


def taxon_build(family_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid families (F7) -> taxa with the SHA-256 of the name as id, and distinct
    (occurrence_id, taxon_id) links from the id lists (U3)."""
    from herbaria.operators import enrich as U
    valid = FL.valid_family(family_groups)
    taxa = valid.select("family").distinct().withColumn("id", F.sha2("family", 256))
    links = (U.expand_ids(valid, "gbifIDs_family").join(taxa.withColumnRenamed("id", "taxon_id"), "family")
             .select("occurrence_id", "taxon_id").distinct())
    return taxa, links


def orphan_cleanup(claims: DataFrame, occurrences: DataFrame, users: DataFrame,
                   article_occurrences: DataFrame) -> dict[str, DataFrame]:
    """J5 -> K20 report -> M11 purge of visible orphans -> J6 purge of
    hidden orphan claims and article links."""
    from herbaria.operators import exports as K
    from herbaria.operators import joins as J
    from herbaria.operators import mutate as M
    orphans = J.orphans(claims, occurrences)
    report = K.orphan_report(orphans, users)
    purged = M.purge_orphan_claims(claims, report, occurrences)
    purged = J.purge_orphans(purged, occurrences, only_hidden=True)
    links = J.purge_orphans(article_occurrences, occurrences)
    return {"report": report, "claims": purged, "article_occurrences": links}


def import_source_claims(occurrences: DataFrame, users: DataFrame, claims: DataFrame,
                         destroyed: DataFrame, authority_ids: DataFrame | None = None) -> DataFrame:
    """Source ids on occurrences -> people (P17) -> redirects followed,
    banned and bots skipped (M8) -> three-way roles (X4) -> insert-ignore (M1)
    as claims made by the source agent.

    ORCID and Wikidata ids are looked up as they are. Numbers of other
    authorities count only through ``authority_ids`` (authority, id, wikidata);
    without that table they name nobody. Local user ids are never matched."""
    from herbaria.functions import predicates as P
    from herbaria.operators import mutate as M
    ids = (occurrences.select(F.col("gbifID").alias("occurrence_id"),
                              S.classify_source_id("recordedByID").alias("r"),
                              S.classify_source_id("identifiedByID").alias("i")))

    def named(source: str) -> DataFrame:
        found = ids.filter(F.col(source).isNotNull()).select("occurrence_id", f"{source}.authority", f"{source}.id")
        own = found.filter(F.col("authority").isin("orcid", "wikidata")).select("occurrence_id", F.col("id").alias("identifier"))
        if authority_ids is None:
            return own
        mapped = found.join(authority_ids.select("authority", "id", F.col("wikidata").alias("identifier")), ["authority", "id"])
        return own.unionByName(mapped.select("occurrence_id", "identifier"))

    rec, idn = named("r"), named("i")
    redirects = M.resolve_redirects(destroyed)
    lookup = (M.identifier_table(users).filter("priority < 3").select("identifier", "user_id")
              .join(redirects.select("identifier"), "identifier", "left_anti"))

    def people(df):
        r = df.join(redirects, "identifier", "left")
        r = r.filter(~F.coalesce(F.col("banned"), F.lit(False)))
        r = r.withColumn("identifier", F.coalesce("resolved", "identifier"))
        return r.join(lookup, "identifier").filter(~P.is_bot("user_id")).select("user_id", "occurrence_id")

    new = X.classify_roles(people(rec), people(idn)).withColumn("created_by", F.lit(P.SOURCE_AGENT_ID).cast("bigint"))
    target = claims.select("user_id", "occurrence_id", "action", "created_by")
    return X.insert_ignore(target, new, ["user_id", "occurrence_id"], order=["action"])


def candidate_counts(claims: DataFrame, occurrence_agents: DataFrame, scores: DataFrame, min_score: float) -> DataFrame:
    """G23 counts, narrowed to specimens with a candidate (T4); G24 draws from them."""
    from herbaria.operators import aggs as G
    from herbaria.operators import candidates as C
    counts = G.occurrence_counts(claims, occurrence_agents)
    return C.occurrence_has_candidate(counts, claims, occurrence_agents, scores, min_score)


def statistics_rebuild(users: DataFrame, claims: DataFrame, as_of) -> DataFrame:
    """The blocks of the statistics pages (block, year, month, n, total): monthly claims, attributions
    and rejections (G32), profiles (G33), and scribes (G31: n attributions, total scribes).
    The profiles of people are G22 (``operators.profiles.user_stats``)."""
    from herbaria.operators import aggs as G
    out = []
    for kind in ("claims", "attributions", "rejected"):
        out.append(G.monthly(claims, kind, as_of).select(F.lit(kind).alias("block"), "year", "month", "n", "total"))
    profiles = G.monthly_profiles(users, as_of)
    for kind in ("wikidata", "orcid"):
        out.append(profiles.select(F.lit(f"profiles_{kind}").alias("block"), "year", "month", F.col(f"{kind}_n").alias("n"),
                                   F.col(f"{kind}_total").alias("total")))
    none = F.lit(None).cast("int")
    scribes = G.scribe_stats(claims)
    out.append(scribes.select(F.lit("scribes").alias("block"), none.alias("year"), none.alias("month"),
                              F.col("attribution_count").alias("n"), F.col("scribe_count").alias("total")))
    rows = out[0]
    for df in out[1:]:
        rows = rows.unionByName(df)
    return rows


def public_dump(claims: DataFrame, users: DataFrame, countries: DataFrame, base_url: str, path: str) -> None:
    """The claims of public people as triples (K5) and their profiles (K6), as gzip CSV files."""
    from herbaria.operators import exports as K
    options = {"header": True, "compression": "gzip", "escape": '"', "emptyValue": ""}
    K.claim_triples(claims, users).write.mode("overwrite").options(**options).csv(f"{path}/claims")
    K.public_profiles(users, countries, base_url).write.mode("overwrite").options(**options).csv(f"{path}/profiles")
