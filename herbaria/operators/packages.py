"""Dataset package tables (A-series), built once for every dataset.

The common input is the set of (datasetKey, occurrence_id) pairs with a
visible claim; every table is keyed by datasetKey so a writer can
deal them to one folder per dataset (see ``sources.packages``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S

ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
# Exported occurrence columns of a package (after gbifID).
PACKAGE_OCCURRENCE_COLUMNS = [
    "datasetKey", "license", "occurrenceID", "basisOfRecord", "dateIdentified", "decimalLatitude",
    "decimalLongitude", "country", "countryCode", "eventDate", "year", "kingdom", "family", "identifiedBy",
    "institutionCode", "collectionCode", "catalogNumber", "recordedBy", "scientificName", "typeStatus", "recordedByID", "identifiedByID",
]


def claimed_pairs(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """(datasetKey, occurrence_id) of occurrences with a visible claim."""
    vis = claims.filter(P.vis()).select("occurrence_id")
    return (occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
            .join(vis, "occurrence_id", "left_semi"))


def occurrences_table(occurrences: DataFrame, claims: DataFrame) -> DataFrame:
    """A1."""
    vis = claims.filter(P.vis()).select(F.col("occurrence_id").alias("gbifID"))
    return occurrences.join(vis, "gbifID", "left_semi").select("gbifID", *PACKAGE_OCCURRENCE_COLUMNS)


def _in_datasets(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Visible claims with the datasetKey of their occurrence."""
    keys = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"))
    return claims.filter(P.vis()).join(keys, "occurrence_id")


def _list_text(values: Column) -> Column:
    """``["a", "b"]``, as list cells are written."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))


def users_table(occurrences: DataFrame, claims: DataFrame, users: DataFrame) -> DataFrame:
    """A2: public people with a visible claim in the dataset, under the package's field names."""
    people = (_in_datasets(claims.select("occurrence_id", "user_id", "visible"), occurrences)
              .select("datasetKey", F.col("user_id").alias("id")).distinct())
    u = users.filter(F.col("is_public")).select(
        "id", S.user_names()["viewname"].alias("name"), F.col("family").alias("familyName"), "particle",
        F.col("given").alias("givenName"), _list_text(F.split("other_names", r"\|")).alias("alternateName"),
        S.person_uri().alias("sameAs"), "orcid", "wikidata",
        F.col("date_born").alias("birthDate"), F.col("date_born_precision").alias("birthDatePrecision"),
        F.col("date_died").alias("deathDate"), F.col("date_died_precision").alias("deathDatePrecision"))
    return people.join(u, "id")


def attributions_table(occurrences: DataFrame, claims: DataFrame, users: DataFrame) -> DataFrame:
    """A3: claim provenance; the person URI goes to the column of its role."""
    c = _in_datasets(claims, occurrences)
    person = users.select(F.col("id").alias("user_id"), S.person_uri().alias("uri"))
    names = S.user_names()
    claimant = users.select(F.col("id").alias("created_by"), names["viewname"].alias("createdName"),
                            S.person_uri().alias("createdBy"))
    j = c.join(person, "user_id").join(claimant, "created_by")
    return j.select(
        "datasetKey", "user_id", "occurrence_id",
        F.when(F.col("action").contains("identified"), F.col("uri")).alias("identifiedBy"),
        F.when(F.col("action").contains("recorded"), F.col("uri")).alias("recordedBy"),
        "createdName", "createdBy", "created_by",
        F.date_format("created", ISO).alias("createdDateTime"),
        F.date_format("updated", ISO).alias("modifiedDateTime"))


def articles_table(occurrences: DataFrame, claims: DataFrame, article_occurrences: DataFrame,
                   articles: DataFrame) -> DataFrame:
    """A4: distinct articles citing claimed occurrences of the dataset, ids as URLs."""
    pairs = claimed_pairs(occurrences, claims)
    ids = pairs.join(article_occurrences, "occurrence_id").select("datasetKey", F.col("article_id").alias("id")).distinct()
    doi = "https://doi.org/"
    a = articles.select("id", F.col("citation").alias("reference"), F.concat(F.lit(doi), "doi").alias("sameAs"),
                        _list_text(F.transform("gbif_dois", lambda d: F.concat(F.lit(doi), d))).alias("datasets"))
    return ids.join(a, "id")


def citations_table(occurrences: DataFrame, claims: DataFrame, article_occurrences: DataFrame) -> DataFrame:
    """A5."""
    return claimed_pairs(occurrences, claims).join(article_occurrences, "occurrence_id").select(
        "datasetKey", "article_id", "occurrence_id")


def missing_attributions_table(attributions: DataFrame, occurrences: DataFrame,
                               dataset_counts: DataFrame) -> DataFrame:
    """A3 rows not made by the source agent, on occurrences with neither
    source id, for datasets that have source attributions."""
    gated = dataset_counts.filter(F.col("source_attribution_count") > 0).select("datasetKey")
    no_ids = occurrences.filter(F.col("recordedByID").isNull() & F.col("identifiedByID").isNull()).select(
        F.col("gbifID").alias("occurrence_id"))
    return (attributions.filter(F.col("created_by") != P.SOURCE_AGENT_ID)
            .join(no_ids, "occurrence_id", "left_semi").join(gated, "datasetKey", "left_semi")
            .select(*attributions.columns))


def not_them_table(occurrences: DataFrame, claims: DataFrame, users: DataFrame) -> DataFrame:
    """Every hidden claim of the dataset with specimen, person and claimant
    (all hidden claims; see README for the parity note)."""
    h = claims.filter(F.col("visible") == F.lit(False)).select("user_id", "occurrence_id", "created_by", "created", "updated")
    occ = occurrences.select("datasetKey", F.col("gbifID").alias("occurrence_id"), "catalogNumber", "recordedBy",
                             "recordedByID", "identifiedBy", "identifiedByID")
    name = S.user_names()["viewname"]
    u = users.select(F.col("id").alias("user_id"), S.person_uri().alias("differentFrom"), name.alias("name"), "wikidata", "orcid")
    k = users.select(F.col("id").alias("created_by"), name.alias("createdBy"), S.person_uri().alias("createdByURI"))
    j = h.join(occ, "occurrence_id").join(u, "user_id").join(k.withColumnRenamed("createdBy", "createdName"), "created_by")
    return j.select("datasetKey", "occurrence_id", "catalogNumber", "recordedBy", "recordedByID", "identifiedBy", "identifiedByID",
                    "differentFrom", "user_id", "name", "wikidata", "orcid", F.col("createdName").alias("createdBy"), "createdByURI",
                    F.date_format("created", ISO).alias("createdDateTime"), F.date_format("updated", ISO).alias("modifiedDateTime"))


def problem_dates_table(occurrences: DataFrame, claims: DataFrame, users: DataFrame,
                        kind: str = "recorded") -> DataFrame:
    """Visible claims of Wikidata people whose specimen date lies on or
    outside the resolved life dates. A8 skips pure identifications (event
    date); A9 skips pure recordings (identification date). The dates are given as
    they were written."""
    field, written = ("eventDate_processed", ["eventDate", "year"]) if kind == "recorded" else (
        "dateIdentified_processed", ["dateIdentified"])
    skip = P.IDENTIFIED if kind == "recorded" else P.RECORDED
    c = claims.filter(P.vis() & (F.col("action") != skip)).select("user_id", "occurrence_id")
    u = users.filter(F.col("wikidata").isNotNull()).select(
        F.col("id").alias("user_id"), "wikidata", F.col("date_born").alias("birthDate"),
        F.col("date_born_precision").alias("birthDatePrecision"), F.col("date_died").alias("deathDate"),
        F.col("date_died_precision").alias("deathDatePrecision"),
        S.resolved_date("date_born", "date_born_precision").alias("rb"),
        S.resolved_date("date_died", "date_died_precision").alias("rd"))
    occ = occurrences.filter(F.col(field).isNotNull()).select(
        "datasetKey", F.col("gbifID").alias("occurrence_id"), "catalogNumber", *written, F.col(field).alias("d"))
    j = c.join(u, "user_id").join(occ, "occurrence_id")
    bad = F.coalesce(F.col("rb") >= F.col("d"), F.lit(False)) | F.coalesce(F.col("rd") <= F.col("d"), F.lit(False))
    return j.filter(bad).drop("rb", "rd", "d")


def unresolved_users_table(occurrences: DataFrame, claims: DataFrame, dataset_counts: DataFrame) -> DataFrame:
    """A10: occurrences with a source collector id and no claim, gated like A6."""
    gated = dataset_counts.filter(F.col("source_attribution_count") > 0).select("datasetKey")
    return (occurrences.filter(F.col("recordedByID").isNotNull())
            .join(claims.select(F.col("occurrence_id").alias("gbifID")), "gbifID", "left_anti")
            .join(gated, "datasetKey", "left_semi")
            .select("datasetKey", "gbifID", "recordedBy", "recordedByID"))
