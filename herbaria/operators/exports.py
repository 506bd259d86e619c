"""Export tables (K5-K16, K18-K22): the rows behind CSV/JSON-LD downloads,
computed for all people / articles / datasets at once; ``sources.writers``
writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S
from herbaria.operators.pairs import counted_members, gather, parts_of
from herbaria.operators.packages import PACKAGE_OCCURRENCE_COLUMNS

# Predicates of the public claim dump and the profile columns.
RECORDED_PREDICATE = "http://rs.tdwg.org/dwc/iri/recordedBy"
IDENTIFIED_PREDICATE = "http://rs.tdwg.org/dwc/iri/identifiedBy"


def claim_triples(claims: DataFrame, users: DataFrame) -> DataFrame:
    """K5: (Subject, Predicate, Object) for claims of public people: one row per
    role; Wikidata URI preferred over ORCID. Claims without a role have no row."""
    u = users.filter(F.col("is_public")).select(F.col("id").alias("user_id"),
                                                S.person_uri(wikidata_first=True).alias("Object"))
    c = claims.filter(F.col("action").isNotNull()).select("user_id", "occurrence_id", "action")
    j = c.join(u, "user_id").select(S.occurrence_uri("occurrence_id").alias("Subject"),
                                    F.explode(F.split("action", ",")).alias("role"), "Object")
    pred = F.when(F.trim("role") == "recorded", F.lit(RECORDED_PREDICATE)).otherwise(F.lit(IDENTIFIED_PREDICATE))
    return j.select("Subject", pred.alias("Predicate"), "Object")


def public_profiles(users: DataFrame, countries: DataFrame, base_url: str) -> DataFrame:
    """K6: the public people, one row each; Country holds the names of their country codes in order."""
    codes = users.filter("is_public").select("id", F.posexplode(F.split("country_code", r"\|")).alias("at", "code"))
    named = (codes.join(countries.select("code", "name"), "code").groupBy("id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda c: c["name"]), "|").alias("Country")))
    u = users.filter("is_public").join(named, "id", "left")
    return u.select(F.col("family").alias("Family"), F.col("given").alias("Given"), F.col("particle").alias("Particle"),
                    F.col("other_names").alias("OtherNames"), F.col("label").alias("LabelName"), "Country",
                    F.col("keywords").alias("Keywords"), "wikidata", F.col("orcid").alias("ORCID"),
                    F.concat(F.lit(base_url.rstrip("/") + "/"), S.identifier()).alias("URL"))


def claim_pivot(claims: DataFrame, users: DataFrame, max_ids: int = 100_000) -> DataFrame:
    """K7: (identifier, action, occurrence_ids): per person and role the sorted
    occurrence ids of source-made claims, rendered as ``[1,2]``.

    Both spellings of the combined role are one row; claims without a role are
    left out. A person with more than ``max_ids`` claims of a role has several
    rows, dealt by hash, of about that many ids; readers of the format take any
    number of rows per person."""
    src = claims.filter((F.col("created_by") == P.SOURCE_AGENT_ID) & F.col("action").isin(P.ALL_ACTIONS))
    rows = src.select("user_id", F.when(P.both(), F.lit(P.RECORDED_IDENTIFIED)).otherwise(F.col("action")).alias("action"), "occurrence_id")
    sizes = rows.groupBy("user_id", "action").agg(F.ceil(F.count(F.lit(1)) / max_ids).alias("lists"))
    dealt = rows.join(sizes, ["user_id", "action"]).withColumn("list", F.pmod(F.xxhash64("occurrence_id"), F.col("lists")))
    lists = (dealt.groupBy("user_id", "action", "list")
             .agg(S.stringify_ids(F.sort_array(F.collect_list("occurrence_id"))).alias("occurrence_ids")))
    return (lists.join(users.select(F.col("id").alias("user_id"), S.identifier().alias("identifier")), "user_id")
            .select("identifier", "action", "occurrence_ids"))


def agent_specimens(occurrences: DataFrame) -> DataFrame:
    """K8: whitelist columns + gbifID."""
    return occurrences.select("gbifID", *PACKAGE_OCCURRENCE_COLUMNS)


def article_counts(claims: DataFrame, article_occurrences: DataFrame, articles: DataFrame, base_url: str) -> DataFrame:
    """K9: per (user, article) doi, reference (``NO TITLE`` when missing), specimen count and
    the page of the person's specimens cited there."""
    c = claims.filter(P.vis()).select("user_id", "occurrence_id")
    cited = article_occurrences.select("article_id", "occurrence_id")
    people = gather(cited, c.select("occurrence_id", "user_id"))
    a = articles.select(F.col("id").alias("article_id"), "doi",
                        F.coalesce("citation", F.lit("NO TITLE")).alias("reference"),
                        F.concat(F.lit(base_url.rstrip("/") + "/profile/citation/"), F.col("doi")).alias("url"))
    a = parts_of(a, cited, ["article_id"])
    out = counted_members(people.join(a, ["article_id", "_part"]), "user_id", "num_specimens")
    return out.select("article_id", "user_id", "num_specimens", "doi", "reference", "url")


def article_specimens(claims: DataFrame, article_occurrences: DataFrame, articles: DataFrame, occurrences: DataFrame) -> DataFrame:
    """A person's visible specimens used in an article: user_id, used_in_doi and the exported columns."""
    c = claims.filter(P.vis()).select("user_id", F.col("occurrence_id").alias("gbifID"))
    used = (article_occurrences.select("article_id", F.col("occurrence_id").alias("gbifID"))
            .join(articles.select(F.col("id").alias("article_id"), F.col("doi").alias("used_in_doi")), "article_id"))
    # specimen columns are wide, they come in the last join and move with the specimen alone
    return (c.join(used.drop("article_id"), "gbifID").join(occurrences.select("gbifID", *PACKAGE_OCCURRENCE_COLUMNS), "gbifID")
            .select("user_id", "used_in_doi", "gbifID", *PACKAGE_OCCURRENCE_COLUMNS))


def user_specimens(claims: DataFrame, occurrences: DataFrame, users: DataFrame) -> DataFrame:
    """Visible claims with specimen columns and claimant name / URI / date."""
    c = claims.filter(P.vis()).select("user_id", F.col("occurrence_id").alias("gbifID"), "action", "created_by",
                                      "created")
    k = users.select(F.col("id").alias("created_by"), S.user_names()["viewname"].alias("claimantName"),
                     S.person_uri().alias("claimantURI"))
    # the claimant first: specimen columns are wide, they come in the last join and move no more
    return (c.join(k, "created_by", "left").join(occurrences.select("gbifID", *PACKAGE_OCCURRENCE_COLUMNS), "gbifID")
            .select("created_by", "gbifID", "user_id", "action", "created", *PACKAGE_OCCURRENCE_COLUMNS, "claimantName", "claimantURI"))


def attributions_given(claims: DataFrame, occurrences: DataFrame, users: DataFrame) -> DataFrame:
    """Claims a claimant made for others with the exported columns, the role, the
    person's URI in the column of each role, and the date."""
    c = claims.filter(P.vis() & (F.col("created_by") != F.col("user_id"))).select(
        "created_by", "user_id", F.col("occurrence_id").alias("gbifID"), "action", "created")
    u = users.select(F.col("id").alias("user_id"), S.person_uri().alias("uri"))
    j = c.join(u, "user_id").join(occurrences.select("gbifID", *PACKAGE_OCCURRENCE_COLUMNS), "gbifID")
    recorded, identified = F.col("action").contains("recorded"), F.col("action").contains("identified")
    return j.select("created_by", "user_id", "gbifID", *PACKAGE_OCCURRENCE_COLUMNS, "action",
                    F.when(recorded, F.col("uri")).alias("attributedRecordedByID"),
                    F.when(identified, F.col("uri")).alias("attributedIdentifiedByID"), F.col("created").alias("attributed"))


def _person(base_url: str) -> Column:
    """A person in a JSON-LD document."""
    alias = F.coalesce(F.split("other_names", r"\|"), F.array().cast("array<string>"))
    return F.struct(F.lit("Person").alias("@type"), F.concat(F.lit(base_url.rstrip("/") + "/"), S.identifier()).alias("@id"),
                    S.person_uri().alias("sameAs"), F.col("given").alias("givenName"), F.col("family").alias("familyName"),
                    S.user_names()["viewname"].alias("name"), alias.alias("alternateName"))


def occurrence_documents(occurrences: DataFrame, claims: DataFrame, users: DataFrame, article_occurrences: DataFrame,
                         articles: DataFrame, base_url: str) -> DataFrame:
    """One JSON document per specimen: its columns, recorded[], identified[], associatedReferences[] and
    annotations[] where a collector's known life does not hold the date.

    A person claims a specimen once, so the lists are as long as a specimen has
    claims and citations, by person and article id."""
    from herbaria.operators.joins import date_warnings
    base = base_url.rstrip("/")
    people = users.select(F.col("id").alias("user_id"), _person(base).alias("person"),
                          S.user_names()["viewname"].alias("name"), S.lifespan_label().alias("life"))
    c = claims.filter(P.vis()).select("user_id", "occurrence_id", "action").join(people, "user_id")

    def listed(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy("occurrence_id").agg(F.array_sort(F.collect_list(F.struct("user_id", "person"))).alias("l"))
        return per.select("occurrence_id", F.transform("l", lambda x: x["person"]).alias(name))

    refs = articles.select(F.col("id").alias("article_id"), F.struct(
        F.lit("ScholarlyArticle").alias("@type"), F.concat(F.lit(f"{base}/article/"), "doi").alias("@id"),
        F.concat(F.lit("https://doi.org/"), "doi").alias("sameAs"), F.col("citation").alias("description")).alias("ref"))
    refs = (article_occurrences.join(refs, "article_id").groupBy("occurrence_id")
            .agg(F.array_sort(F.collect_list(F.struct("article_id", "ref"))).alias("l"))
            .select("occurrence_id", F.transform("l", lambda x: x["ref"]).alias("associatedReferences")))
    warned = date_warnings(users, claims, occurrences).filter("collected_warning").groupBy("occurrence_id").agg(F.min("user_id").alias("user_id"))
    warned = warned.join(people.select("user_id", "name", "life"), "user_id").select("occurrence_id", "name", "life")
    occ = occurrences.select(F.col("gbifID").alias("occurrence_id"), *PACKAGE_OCCURRENCE_COLUMNS)
    j = (occ.join(listed(c.filter(P.rec()), "recorded"), "occurrence_id", "left").join(listed(c.filter(P.idn()), "identified"), "occurrence_id", "left")
         .join(refs, "occurrence_id", "left").join(warned, "occurrence_id", "left"))
    note = F.when(F.col("life").isNotNull(), F.array(F.struct(
        F.lit("oa:Annotation").alias("@type"), F.lit("eventDate").alias("oa:property"),
        F.concat(F.lit("The date "), F.coalesce("eventDate", F.lit("")), F.lit(" may be incorrect: it falls outside the known lifespan of "),
                 "name", F.lit(", "), "life").alias("rdf:value"))))
    body = F.struct(F.lit("PreservedSpecimen").alias("@type"), F.concat(F.lit(f"{base}/occurrence/"), "occurrence_id").alias("@id"),
                    S.occurrence_uri("occurrence_id").alias("sameAs"), "recorded", "identified", "associatedReferences",
                    note.alias("annotations"), *PACKAGE_OCCURRENCE_COLUMNS)
    return j.select("occurrence_id", F.to_json(body).alias("document"))


def person_list_by_taxon(claims: DataFrame, taxon_occurrences: DataFrame) -> DataFrame:
    """(family, user_id, roles) with roles ``identified``, ``recorded`` or both."""
    c = claims.filter(P.vis() & P.any_role()).select("user_id", "occurrence_id", "action")
    j = c.join(taxon_occurrences, "occurrence_id")
    g = j.groupBy("family", "user_id").agg(F.bool_or(P.idn()).alias("i"), F.bool_or(P.rec()).alias("r"))
    roles = F.concat_ws(",", F.when(F.col("i"), F.lit("identified")), F.when(F.col("r"), F.lit("recorded")))
    return g.select("family", "user_id", roles.alias("roles"))


def orphan_report(orphans: DataFrame, users: DataFrame) -> DataFrame:
    """Identifier, name, count and claimant names joined by ``; `` (as many as the
    person has claimants of orphans)."""
    names = users.select(F.col("id").alias("created_by"), S.user_names()["viewname"].alias("claimant"))
    per = (orphans.join(names, "created_by", "left").groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("n"),
                F.array_join(F.sort_array(F.collect_set("claimant")), "; ").alias("claimants")))
    u = users.select(F.col("id").alias("user_id"), S.identifier().alias("identifier"),
                     S.user_names()["viewname"].alias("name"))
    return per.join(u, "user_id")


def new_identifiers(users: DataFrame, known: DataFrame) -> DataFrame:
    """Public local identifiers not in a known list; a person's ORCID and Wikidata id both count."""
    ids = (users.filter(F.col("is_public")).select(F.explode(F.array("orcid", "wikidata")).alias("identifier"))
           .filter(F.col("identifier").isNotNull()))
    return ids.join(known.select("identifier"), "identifier", "left_anti")


def timeline_rows(timeline: DataFrame, users: DataFrame, scope: str) -> DataFrame:
    """Identifier, name, min/max dates (ISO) and lifespan label."""
    u = users.select(F.col("id").alias("user_id"), S.identifier().alias("identifier"),
                     S.user_names()["fullname"].alias("name"), S.lifespan_label().alias("lifespan"))
    return timeline.join(u, "user_id").select(scope, "identifier", "name",
                                              F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
                                              F.date_format("max_date", "yyyy-MM-dd").alias("max_date"), "lifespan")


def network_rows(recorded_with: DataFrame, users: DataFrame, base_url: str) -> DataFrame:
    """A person's network for JSON-LD, one row per co-collector: user_id, person, co_collector (JSON).

    A document is the person with all rows of theirs; rows stay apart, as a person
    may have any number of co-collectors.
    """
    person = F.to_json(_person(base_url))
    p = users.select("id", person.alias("person"))
    return (recorded_with.select("user_id", "other_id").join(p.withColumnRenamed("id", "user_id"), "user_id")
            .join(p.select(F.col("id").alias("other_id"), F.col("person").alias("co_collector")), "other_id")
            .select("user_id", "other_id", "person", "co_collector"))
