"""Registered set, de-duplication, package and refresh queries (X, M1, A, B1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from herbaria.functions import scalars as S
from herbaria.operators import aggs
from herbaria.operators import filters as FL
from herbaria.operators import packages as A
from herbaria.operators import sets as X
from herbaria.plans.registry import query
from herbaria.sources.testdata import AS_OF

_RAW_COLS = ["gbifID", "datasetKey", "basisOfRecord", "occurrenceStatus", "v_occurrenceID", "v_scientificName",
             "scientificName", "eventDate", "dateIdentified", "v_eventDate", "recordedBy", "v_recordedBy",
             "v_identifiedBy", "v_recordedByID", "v_institutionCode", "v_catalogNumber", "v_typeStatus", "hasImage"]
_ORDER_SQL = ", ".join(["source_row", "source_line"] + [c for c in _RAW_COLS if c != "gbifID"])
_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in _ORDER_SQL.split(", "))

_ADMIT_SQL = """
SELECT * FROM raw_download
WHERE basisOfRecord IN ('OCCURRENCE','LIVING_SPECIMEN','FOSSIL_SPECIMEN','PRESERVED_SPECIMEN','MATERIAL_SAMPLE','MATERIAL_CITATION')
  AND (v_identifiedBy IS NOT NULL OR v_recordedBy IS NOT NULL)
  AND NOT coalesce(occurrenceStatus = 'ABSENT', FALSE)
  AND (v_scientificName IS NULL OR NOT (v_scientificName LIKE '%BOLD:%' OR v_scientificName LIKE '%BOLD-%'
                                        OR v_scientificName LIKE '%BIOUG%'))
"""


def _admitted(m):
    return FL.admit_records(m.raw_download, identified_by="v_identifiedBy", recorded_by="v_recordedBy")


@query("F1_admit_records", f"""
SELECT datasetKey, basisOfRecord, count(*) AS n FROM ({_ADMIT_SQL}) GROUP BY 1, 2
""")
def f1(m):
    return _admitted(m).groupBy("datasetKey", "basisOfRecord").agg(F.count(F.lit(1)).alias("n"))


@query("X1_dedupe_occurrences", f"""
SELECT {", ".join(_RAW_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY gbifID ORDER BY {_ORDER_SQL}) AS rn FROM raw_download) WHERE rn = 1
""")
def x1(m):
    return X.dedupe_occurrences(m.raw_download, ["source_row", "source_line"]).select(*_RAW_COLS)


@query("B1_occurrence_refresh", f"""
WITH adm AS ({_ADMIT_SQL}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gbifID ORDER BY {_ORDER_SQL}) AS rn FROM adm) WHERE rn = 1)
SELECT gbifID, datasetKey, v_occurrenceID AS occurrenceID, coalesce(v_scientificName, scientificName) AS scientificName,
  CASE WHEN TRY_CAST(eventDate AS TIMESTAMP) < TIMESTAMP '2002-01-01' THEN CAST(TRY_CAST(eventDate AS TIMESTAMP) AS DATE) END AS eventDate_processed,
  CASE WHEN TRY_CAST(dateIdentified AS TIMESTAMP) < TIMESTAMP '2002-01-01' THEN CAST(TRY_CAST(dateIdentified AS TIMESTAMP) AS DATE) END AS dateIdentified_processed,
  v_eventDate AS eventDate, v_recordedBy AS recordedBy, v_identifiedBy AS identifiedBy, v_recordedByID AS recordedByID,
  v_institutionCode AS institutionCode, v_catalogNumber AS catalogNumber, lower(v_typeStatus) AS typeStatus,
  CASE WHEN hasImage THEN 1 ELSE 0 END AS hasImage,
  CAST(year(CASE WHEN TRY_CAST(eventDate AS TIMESTAMP) < TIMESTAMP '2002-01-01' THEN CAST(TRY_CAST(eventDate AS TIMESTAMP) AS DATE) END) AS INTEGER) AS eventDate_processed_year
FROM d
""")
def b1(m):
    from herbaria.plans.jobs import occurrence_refresh
    return occurrence_refresh(m.raw_download, as_of=AS_OF).select(
        "gbifID", "datasetKey", "occurrenceID", "scientificName", "eventDate_processed", "dateIdentified_processed",
        "eventDate", "recordedBy", "identifiedBy", "recordedByID", "institutionCode", "catalogNumber", "typeStatus",
        "hasImage", "eventDate_processed_year")


@query("X2_union_roles", """
SELECT DISTINCT agent_id, agent_role, occurrence_id FROM (
  SELECT agent_id, TRUE AS agent_role, occurrence_id FROM occurrence_agents WHERE agent_role
  UNION ALL SELECT agent_id, FALSE, occurrence_id FROM occurrence_agents WHERE NOT agent_role)
WHERE agent_id IS NOT NULL
""")
def x2(m):
    oa = m.occurrence_agents
    return X.union_roles(oa.filter("agent_role"), oa.filter("NOT agent_role"))


@query("X3_distinct_families", "SELECT DISTINCT family FROM occurrences")
def x3(m):
    return X.distinct_keys(m.occurrences, ["family"])


_SOURCE_PEOPLE_SQL = """
rec AS (SELECT u.id AS user_id, o.gbifID AS occurrence_id FROM occurrences o
        JOIN users u ON u.wikidata = regexp_extract(o.recordedByID, 'wikidata\\.org/(?:entity|wiki)/(Q[0-9]+)', 1)),
idn AS (SELECT u.id AS user_id, o.gbifID AS occurrence_id FROM occurrences o
        JOIN users u ON u.orcid = regexp_extract(o.identifiedByID, 'orcid\\.org/((?:[0-9]{4}-){3}[0-9]{3}[0-9X])', 1)),
x4 AS (SELECT user_id, occurrence_id,
         CASE WHEN bool_or(r) AND bool_or(i) THEN 'recorded,identified' WHEN bool_or(r) THEN 'recorded' ELSE 'identified' END AS action
       FROM (SELECT user_id, occurrence_id, TRUE AS r, FALSE AS i FROM rec
             UNION ALL SELECT user_id, occurrence_id, FALSE, TRUE FROM idn) GROUP BY 1, 2)
"""


def _source_people(m):
    occ = m.occurrences
    users = m.users
    rec = (occ.select(F.col("gbifID").alias("occurrence_id"), S.extract_id("recordedByID", "wikidata").alias("wikidata"))
           .join(users.select(F.col("id").alias("user_id"), "wikidata"), "wikidata").select("user_id", "occurrence_id"))
    idn = (occ.select(F.col("gbifID").alias("occurrence_id"), S.extract_id("identifiedByID", "orcid").alias("orcid"))
           .join(users.select(F.col("id").alias("user_id"), "orcid"), "orcid").select("user_id", "occurrence_id"))
    return X.classify_roles(rec, idn)


@query("X4_classify_roles", "WITH " + _SOURCE_PEOPLE_SQL + " SELECT * FROM x4")
def x4(m):
    return _source_people(m)


@query("M1_insert_ignore_source_claims", "WITH " + _SOURCE_PEOPLE_SQL + """
SELECT user_id, occurrence_id, action, created_by FROM claims
UNION ALL
SELECT x.user_id, x.occurrence_id, x.action, 2 AS created_by FROM x4 x
WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.user_id = x.user_id AND c.occurrence_id = x.occurrence_id)
""")
def m1(m):
    delta = _source_people(m).withColumn("created_by", F.lit(2).cast("bigint"))
    target = m.claims.select("user_id", "occurrence_id", "action", "created_by")
    return X.insert_ignore(target, delta, ["user_id", "occurrence_id"], order=["action"])


@query("X5_dataset_key_diff", """
WITH fresh AS (SELECT DISTINCT CASE WHEN collectionCode < 'f' THEN datasetKey || '-new' ELSE datasetKey END AS datasetKey FROM occurrences),
old AS (SELECT datasetKey FROM datasets UNION SELECT 'Brand#' || p_size FROM part)
SELECT datasetKey, 'new' AS side FROM (FROM fresh EXCEPT FROM old)
UNION ALL SELECT datasetKey, 'vanished' FROM (FROM old EXCEPT FROM fresh)
""")
def x5(m):
    """A download in which some datasets came in under new keys, against a table with keys of the past."""
    key = F.when(F.col("collectionCode") < "f", F.concat("datasetKey", F.lit("-new"))).otherwise(F.col("datasetKey"))
    old = m.datasets.select("datasetKey").unionByName(m.raw("part").select(F.concat(F.lit("Brand#"), "p_size").alias("datasetKey"))).distinct()
    new, gone = X.key_diff(m.occurrences.select(key.alias("datasetKey")), old, "datasetKey")
    return new.withColumn("side", F.lit("new")).unionByName(gone.withColumn("side", F.lit("vanished")))


@query("X6_union_distinct_people", """
SELECT user_id FROM claims WHERE visible AND action = 'recorded'
UNION SELECT user_id FROM claims WHERE visible AND action = 'identified'
""")
def x6(m):
    v = FL.visible(m.claims)
    return X.union_distinct(v.filter(F.col("action") == "recorded").select("user_id"),
                            v.filter(F.col("action") == "identified").select("user_id"))


@query("X7_known_ids_diff", """
SELECT DISTINCT regexp_extract(recordedByID, 'wikidata\\.org/(?:entity|wiki)/(Q[0-9]+)', 1) AS identifier FROM occurrences
WHERE recordedByID IS NOT NULL
EXCEPT SELECT wikidata FROM users WHERE wikidata IS NOT NULL
EXCEPT SELECT 'Q' || CAST(CAST(identifier AS BIGINT) + 999 AS VARCHAR) FROM destroyed_users
""")
def x7(m):
    new = m.occurrences.select(S.extract_id("recordedByID", "wikidata").alias("identifier")).filter(
        F.col("identifier").isNotNull())
    existing = m.users.filter(F.col("wikidata").isNotNull()).select(F.col("wikidata").alias("identifier"))
    destroyed = m.destroyed_users.select(
        F.concat(F.lit("Q"), (F.col("identifier").cast("bigint") + 999).cast("string")).alias("identifier"))
    return X.known_ids_diff(new, existing, destroyed)


@query("X8_ids_to_merge", """
SELECT identifier, redirect_to FROM destroyed_users d
WHERE d.identifier IN (SELECT CAST(id AS VARCHAR) FROM users)
""")
def x8(m):
    existing = m.users.select(F.col("id").cast("string").alias("identifier"))
    return X.ids_to_merge(m.destroyed_users.select("identifier", "redirect_to"), existing)


# --- A-series: package tables for every dataset -------------------------------

_CLAIMED_SQL = """
claimed AS (SELECT o.datasetKey, o.gbifID AS occurrence_id FROM occurrences o
            WHERE EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID AND c.visible))
"""
_URI = "coalesce('https://orcid.org/' || {p}.orcid, 'http://www.wikidata.org/entity/' || {p}.wikidata)"
_FULLNAME = ("CASE WHEN {p}.family IS NULL OR trim({p}.family) = '' THEN {p}.orcid ELSE "
             "trim(concat_ws(' ', nullif(trim({p}.given), ''), nullif(trim(concat_ws(' ', nullif(trim({p}.particle), ''), "
             "nullif(trim({p}.family), ''))), ''))) END")


@query("A1_package_occurrences", "WITH " + _CLAIMED_SQL + f"""
SELECT o.gbifID, {", ".join("o." + c for c in A.PACKAGE_OCCURRENCE_COLUMNS)}
FROM occurrences o WHERE o.gbifID IN (SELECT occurrence_id FROM claimed)
""")
def a1(m):
    return A.occurrences_table(m.occurrences, m.claims)


_VIEWNAME = "coalesce({p}.label, " + _FULLNAME + ")"
_LIST = """'[' || array_to_string(list_transform({v}, lambda x: '"' || {x} || '"'), ', ') || ']'"""


@query("A2_package_users", "WITH " + _CLAIMED_SQL + f"""
SELECT DISTINCT cl.datasetKey, u.id, {_VIEWNAME.format(p='u')} AS name, u.family AS familyName, u.particle, u.given AS givenName,
  {_LIST.format(v="string_split(u.other_names, '|')", x='x')} AS alternateName, {_URI.format(p='u')} AS sameAs, u.orcid, u.wikidata,
  u.date_born AS birthDate, u.date_born_precision AS birthDatePrecision, u.date_died AS deathDate,
  u.date_died_precision AS deathDatePrecision
FROM claims c JOIN claimed cl ON cl.occurrence_id = c.occurrence_id JOIN users u ON u.id = c.user_id
WHERE c.visible AND u.is_public
""")
def a2(m):
    return A.users_table(m.occurrences, m.claims, m.users)


_ATTR_SQL = _CLAIMED_SQL + f""",
attr AS (
SELECT cl.datasetKey, c.user_id, c.occurrence_id,
  CASE WHEN c.action LIKE '%identified%' THEN {_URI.format(p='u')} END AS identifiedBy,
  CASE WHEN c.action LIKE '%recorded%' THEN {_URI.format(p='u')} END AS recordedBy,
  coalesce(k.label, {_FULLNAME.format(p='k')}) AS createdName,
  {_URI.format(p='k')} AS createdBy, c.created_by,
  strftime(c.created, '%Y-%m-%dT%H:%M:%S+00:00') AS createdDateTime,
  strftime(c.updated, '%Y-%m-%dT%H:%M:%S+00:00') AS modifiedDateTime
FROM claims c JOIN claimed cl ON cl.occurrence_id = c.occurrence_id
JOIN users u ON u.id = c.user_id JOIN users k ON k.id = c.created_by
WHERE c.visible)
"""


@query("A3_package_attributions", "WITH " + _ATTR_SQL + " SELECT * FROM attr")
def a3(m):
    return A.attributions_table(m.occurrences, m.claims, m.users)


@query("A4_package_articles", "WITH " + _CLAIMED_SQL + """
SELECT DISTINCT cl.datasetKey, a.id, a.citation AS reference, 'https://doi.org/' || a.doi AS sameAs,
  """ + _LIST.format(v="a.gbif_dois", x="'https://doi.org/' || x") + """ AS datasets
FROM claimed cl JOIN article_occurrences ao ON ao.occurrence_id = cl.occurrence_id JOIN articles a ON a.id = ao.article_id
""")
def a4(m):
    return A.articles_table(m.occurrences, m.claims, m.article_occurrences, m.articles)


@query("A5_package_citations", "WITH " + _CLAIMED_SQL + """
SELECT cl.datasetKey, ao.article_id, ao.occurrence_id FROM claimed cl JOIN article_occurrences ao ON ao.occurrence_id = cl.occurrence_id
""")
def a5(m):
    return A.citations_table(m.occurrences, m.claims, m.article_occurrences)


_GATE_SQL = """
gate AS (SELECT o.datasetKey FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
         WHERE c.created_by = 2 GROUP BY 1 HAVING count(*) > 0)
"""


@query("A6_package_missing_attributions", "WITH " + _ATTR_SQL + "," + _GATE_SQL + """
SELECT a.* FROM attr a JOIN occurrences o ON o.gbifID = a.occurrence_id
WHERE a.created_by <> 2 AND o.recordedByID IS NULL AND o.identifiedByID IS NULL
  AND a.datasetKey IN (SELECT datasetKey FROM gate)
""")
def a6(m):
    attr = A.attributions_table(m.occurrences, m.claims, m.users)
    return A.missing_attributions_table(attr, m.occurrences, aggs.dataset_counters(m.occurrences, m.claims))


@query("A7_package_not_them", f"""
SELECT o.datasetKey, c.occurrence_id, o.catalogNumber, o.recordedBy, o.recordedByID, o.identifiedBy, o.identifiedByID,
  {_URI.format(p='u')} AS differentFrom, c.user_id, {_VIEWNAME.format(p='u')} AS name, u.wikidata, u.orcid,
  {_VIEWNAME.format(p='k')} AS createdBy, {_URI.format(p='k')} AS createdByURI,
  strftime(c.created, '%Y-%m-%dT%H:%M:%S+00:00') AS createdDateTime, strftime(c.updated, '%Y-%m-%dT%H:%M:%S+00:00') AS modifiedDateTime
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id JOIN users u ON u.id = c.user_id JOIN users k ON k.id = c.created_by
WHERE NOT c.visible
""")
def a7(m):
    return A.not_them_table(m.occurrences, m.claims, m.users)


_RES = """CASE WHEN {d} IS NULL THEN NULL
  WHEN {p} = 'century' THEN make_date(CAST(year({d}) - 100 AS INTEGER), 1, 1)
  WHEN {p} = 'year' THEN make_date(CAST(year({d}) AS INTEGER), 12, 31)
  WHEN {p} = 'month' THEN make_date(CAST(year({d}) AS INTEGER), CAST(month({d}) AS INTEGER), 28)
  ELSE {d} END"""
_PROBLEM_SQL = f"""
SELECT o.datasetKey, c.occurrence_id, o.catalogNumber, c.user_id, u.wikidata, u.date_born AS birthDate,
       u.date_born_precision AS birthDatePrecision, u.date_died AS deathDate, u.date_died_precision AS deathDatePrecision, {{cols}}
FROM claims c JOIN users u ON u.id = c.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action <> '{{skip}}' AND u.wikidata IS NOT NULL AND o.{{f}} IS NOT NULL
  AND (coalesce({_RES.format(d='u.date_born', p='u.date_born_precision')} >= o.{{f}}, FALSE)
       OR coalesce({_RES.format(d='u.date_died', p='u.date_died_precision')} <= o.{{f}}, FALSE))
"""

query("A8_package_problem_collector_dates", _PROBLEM_SQL.format(f="eventDate_processed", skip="identified", cols='o.eventDate, o."year"'))(
    lambda m: A.problem_dates_table(m.occurrences, m.claims, m.users, "recorded"))
query("A9_package_problem_determiner_dates", _PROBLEM_SQL.format(f="dateIdentified_processed", skip="recorded", cols="o.dateIdentified"))(
    lambda m: A.problem_dates_table(m.occurrences, m.claims, m.users, "identified"))


@query("A10_package_unresolved_users", "WITH " + _GATE_SQL + """
SELECT o.datasetKey, o.gbifID, o.recordedBy, o.recordedByID FROM occurrences o
WHERE o.recordedByID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID)
  AND o.datasetKey IN (SELECT datasetKey FROM gate)
""")
def a10(m):
    return A.unresolved_users_table(m.occurrences, m.claims, aggs.dataset_counters(m.occurrences, m.claims))
