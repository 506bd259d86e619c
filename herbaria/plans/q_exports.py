"""Registered export, enrichment, job and scalar-projection queries (K, U, B, P)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from herbaria.functions import scalars as S
from herbaria.operators import aggs
from herbaria.operators import enrich as U
from herbaria.operators import exports as K
from herbaria.operators import joins as J
from herbaria.operators.packages import PACKAGE_OCCURRENCE_COLUMNS
from herbaria.plans import jobs as B
from herbaria.plans.registry import query
from herbaria.sources.testdata import AS_OF

_URI_W = "coalesce('http://www.wikidata.org/entity/' || u.wikidata, 'https://orcid.org/' || u.orcid)"
_URI = "coalesce('https://orcid.org/' || {p}.orcid, 'http://www.wikidata.org/entity/' || {p}.wikidata)"
_FULL = ("CASE WHEN {p}.family IS NULL OR trim({p}.family) = '' THEN {p}.orcid ELSE "
         "trim(concat_ws(' ', nullif(trim({p}.given), ''), nullif(trim(concat_ws(' ', nullif(trim({p}.particle), ''), "
         "nullif(trim({p}.family), ''))), ''))) END")


@query("K5_claim_triples", f"""
SELECT 'https://gbif.org/occurrence/' || CAST(c.occurrence_id AS VARCHAR) AS Subject,
  CASE WHEN r.role = 'recorded' THEN 'http://rs.tdwg.org/dwc/iri/recordedBy' ELSE 'http://rs.tdwg.org/dwc/iri/identifiedBy' END AS Predicate,
  {_URI_W} AS Object
FROM claims c JOIN users u ON u.id = c.user_id,
LATERAL (SELECT unnest(string_split(c.action, ',')) AS role) r
WHERE c.action IS NOT NULL AND u.is_public
""")
def k5(m):
    return K.claim_triples(m.claims, m.users)


BASE_URL = "https://people.example.org"
_WHO = "coalesce({p}.orcid, {p}.wikidata, CAST({p}.id AS VARCHAR))"
_VIEW = "coalesce({p}.label, " + _FULL + ")"


@query("K6_public_profiles", f"""
SELECT u.family AS Family, u.given AS Given, u.particle AS Particle, u.other_names AS OtherNames, u.label AS LabelName,
  (SELECT string_agg(c.name, '|' ORDER BY x.at) FROM (SELECT id, unnest(string_split(country_code, '|')) AS code,
     generate_subscripts(string_split(country_code, '|'), 1) AS at FROM users) x JOIN countries c ON c.code = x.code WHERE x.id = u.id) AS Country,
  u.keywords AS Keywords, u.wikidata, u.orcid AS ORCID, '{BASE_URL}/' || {_WHO.format(p='u')} AS URL
FROM users u WHERE u.is_public
""")
def k6(m):
    return K.public_profiles(m.users, m.countries, BASE_URL)


@query("K7_claim_pivot", """
WITH c AS (SELECT user_id, occurrence_id,
                  CASE WHEN action = 'identified,recorded' THEN 'recorded,identified' ELSE action END AS role
           FROM claims WHERE created_by = 2 AND action IS NOT NULL),
g AS (SELECT user_id, role, '[' || string_agg(CAST(occurrence_id AS VARCHAR), ',' ORDER BY occurrence_id) || ']' AS ids
      FROM c GROUP BY user_id, role)
SELECT coalesce(u.orcid, u.wikidata, CAST(u.id AS VARCHAR)) AS identifier, g.role AS action, g.ids AS occurrence_ids
FROM g JOIN users u ON u.id = g.user_id
""")
def k7(m):
    return K.claim_pivot(m.claims, m.users)


@query("K9_article_counts", """
SELECT c.user_id, ao.article_id, count(*) AS num_specimens, a.doi, coalesce(a.citation, 'NO TITLE') AS reference,
       'https://people.example.org/profile/citation/' || a.doi AS url
FROM claims c JOIN article_occurrences ao ON ao.occurrence_id = c.occurrence_id JOIN articles a ON a.id = ao.article_id
WHERE c.visible GROUP BY c.user_id, ao.article_id, a.doi, a.citation
""")
def k9(m):
    return K.article_counts(m.claims, m.article_occurrences, m.articles, BASE_URL)


_OCC = ", ".join(f'o."{c}"' for c in PACKAGE_OCCURRENCE_COLUMNS)


@query("K10_article_specimens", f"""
SELECT c.user_id, a.doi AS used_in_doi, o.gbifID, {_OCC}
FROM claims c JOIN article_occurrences ao ON ao.occurrence_id = c.occurrence_id JOIN articles a ON a.id = ao.article_id
JOIN occurrences o ON o.gbifID = c.occurrence_id WHERE c.visible
""")
def k10(m):
    return K.article_specimens(m.claims, m.article_occurrences, m.articles, m.occurrences)


@query("K12_attributions_given", f"""
SELECT c.created_by, c.user_id, o.gbifID, {_OCC}, c.action, c.created AS attributed,
  CASE WHEN c.action LIKE '%recorded%' THEN {_URI.format(p='u')} END AS attributedRecordedByID,
  CASE WHEN c.action LIKE '%identified%' THEN {_URI.format(p='u')} END AS attributedIdentifiedByID
FROM claims c JOIN users u ON u.id = c.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.created_by <> c.user_id
""")
def k12(m):
    return K.attributions_given(m.claims, m.occurrences, m.users)


_NAMES_OF = """(SELECT string_agg(coalesce(u.label, """ + _FULL.format(p="u") + """), '; ' ORDER BY c.user_id) FROM claims c JOIN users u ON u.id = c.user_id
  WHERE c.visible AND c.occurrence_id = o.gbifID AND c.action IN {roles})"""
_REC = "('recorded','recorded,identified','identified,recorded')"
_IDN = "('identified','recorded,identified','identified,recorded')"
_RESOLVED = """CASE WHEN {d} IS NULL THEN NULL
  WHEN {p} = 'century' THEN make_date(CAST(year({d}) - 100 AS INTEGER), 1, 1)
  WHEN {p} = 'year' THEN make_date(CAST(year({d}) AS INTEGER), 12, 31)
  WHEN {p} = 'month' THEN make_date(CAST(year({d}) AS INTEGER), CAST(month({d}) AS INTEGER), 28)
  ELSE {d} END"""


@query("K16_occurrence_documents", f"""
WITH docs AS (SELECT o.gbifID AS occurrence_id, o.scientificName, o.catalogNumber, {_NAMES_OF.format(roles=_REC)} AS recorded,
    {_NAMES_OF.format(roles=_IDN)} AS identified,
    (SELECT string_agg('https://doi.org/' || a.doi, '; ' ORDER BY a.id) FROM article_occurrences ao JOIN articles a ON a.id = ao.article_id
     WHERE ao.occurrence_id = o.gbifID) AS refs,
    EXISTS (SELECT 1 FROM claims c JOIN users u ON u.id = c.user_id WHERE c.visible AND c.occurrence_id = o.gbifID AND c.action IN {_REC}
      AND o.recordedBy IS NOT NULL AND u.date_born IS NOT NULL
      AND (o.eventDate_processed <= {_RESOLVED.format(d='u.date_born', p='u.date_born_precision')}
           OR o.eventDate_processed >= {_RESOLVED.format(d='u.date_died', p='u.date_died_precision')})) AS warned
  FROM occurrences o)
SELECT * FROM docs
""")
def k16(m):
    """The documents, read back to the fields that the SQL has."""
    docs = K.occurrence_documents(m.occurrences, m.claims, m.users, m.article_occurrences, m.articles, BASE_URL)
    doc = F.from_json("document", "recorded array<struct<name:string>>, identified array<struct<name:string>>, scientificName string, "
                      "catalogNumber string, associatedReferences array<struct<sameAs:string>>, annotations array<struct<`oa:property`:string>>")
    text = lambda c, f: F.when(F.col(f"d.{c}").isNotNull(), F.array_join(F.transform(f"d.{c}", lambda x: x[f]), "; "))
    return docs.select("occurrence_id", doc.alias("d")).select(
        "occurrence_id", "d.scientificName", "d.catalogNumber", text("recorded", "name").alias("recorded"),
        text("identified", "name").alias("identified"), text("associatedReferences", "sameAs").alias("refs"),
        F.col("d.annotations").isNotNull().alias("warned"))


@query("K19_person_list_by_taxon", """
SELECT t.family, c.user_id,
  concat_ws(',', CASE WHEN bool_or(c.action IN ('identified','recorded,identified','identified,recorded')) THEN 'identified' END,
                 CASE WHEN bool_or(c.action IN ('recorded','recorded,identified','identified,recorded')) THEN 'recorded' END) AS roles
FROM claims c JOIN taxon_occurrences t ON t.occurrence_id = c.occurrence_id
WHERE c.visible AND c.action IS NOT NULL GROUP BY t.family, c.user_id
""")
def k19(m):
    return K.person_list_by_taxon(m.claims, m.taxon_occurrences)


@query("K20_orphan_report", f"""
WITH orphans AS (SELECT c.user_id, c.created_by FROM claims c
                 WHERE c.visible AND NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id)),
per AS (SELECT o.user_id, count(*) AS n,
               array_to_string(list_sort(list_distinct(list({_VIEW.format(p='k')}))), '; ') AS claimants
        FROM orphans o LEFT JOIN users k ON k.id = o.created_by GROUP BY o.user_id)
SELECT p.user_id, p.n, p.claimants, coalesce(u.orcid, u.wikidata, CAST(u.id AS VARCHAR)) AS identifier,
       {_VIEW.format(p='u')} AS name
FROM per p JOIN users u ON u.id = p.user_id
""")
def k20(m):
    return K.orphan_report(J.orphans(m.claims, m.occurrences), m.users)


@query("K21_new_identifiers", """
SELECT identifier FROM (SELECT orcid AS identifier FROM users WHERE is_public UNION ALL SELECT wikidata FROM users WHERE is_public)
WHERE identifier IS NOT NULL
EXCEPT ALL SELECT regexp_extract(recordedByID, '(Q[0-9]+)', 1) FROM occurrences WHERE recordedByID IS NOT NULL
""")
def k21(m):
    known = (m.occurrences.filter(F.col("recordedByID").isNotNull())
             .select(S.extract_id("recordedByID", "wikidata").alias("identifier")))
    return K.new_identifiers(m.users, known)


_CENTURY = "CAST(year({d}) // 100 + 1 AS VARCHAR) || CASE WHEN (year({d}) // 100 + 1) % 100 BETWEEN 11 AND 13 THEN 'th' " \
           "WHEN (year({d}) // 100 + 1) % 10 = 1 THEN 'st' WHEN (year({d}) // 100 + 1) % 10 = 2 THEN 'nd' WHEN (year({d}) // 100 + 1) % 10 = 3 THEN 'rd' ELSE 'th' END || ' century'"
_WHEN = "coalesce(CASE {p} WHEN 'day' THEN strftime({d}, '%B %-d, %Y') WHEN 'month' THEN strftime({d}, '%B %Y') WHEN 'year' THEN strftime({d}, '%Y') " \
        "WHEN 'century' THEN " + _CENTURY + " ELSE '?' END, '?')"
_LIFE = (f"CASE WHEN u.date_born IS NULL THEN '?' ELSE {_WHEN.format(d='u.date_born', p='u.date_born_precision')} END || ' – ' || "
         f"CASE WHEN u.date_died IS NULL THEN '?' ELSE {_WHEN.format(d='u.date_died', p='u.date_died_precision')} END")


@query("P24_lifespan_label", f"SELECT id, {_LIFE} AS lifespan FROM users u")
def p24(m):
    return m.users.select("id", S.lifespan_label().alias("lifespan"))


@query("K22_timeline_dataset", f"""
WITH tl AS (SELECT o.datasetKey, c.user_id, min(o.eventDate_processed) AS lo, max(o.eventDate_processed) AS hi
  FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.visible AND c.action IN {_REC} AND o.eventDate_processed_year BETWEEN 1996 AND 2000 GROUP BY 1, 2)
SELECT t.datasetKey, {_WHO.format(p='u')} AS identifier, {_FULL.format(p='u')} AS name, strftime(t.lo, '%Y-%m-%d') AS min_date,
  strftime(t.hi, '%Y-%m-%d') AS max_date, {_LIFE} AS lifespan
FROM tl t JOIN users u ON u.id = t.user_id
""")
def k22(m):
    tl = aggs.timeline(m.claims, m.occurrences, "datasetKey", "recorded", 1996, 2000)
    return K.timeline_rows(tl, m.users, "datasetKey")


# --- U-series -----------------------------------------------------------------

def _split_parser(values: list[str]) -> list[str]:
    """A stand-in for the external name parser: last word is the family."""
    out = []
    for v in values:
        parts = v.split()
        out.append(json.dumps([{"family": parts[-1], "given": " ".join(parts[:-1])}] if parts else []))
    return out


@query("U1_enrich_in_batches", """
SELECT gbifID, recordedBy, '[{"family": "' || string_split(recordedBy, ' ')[-1] || '", "given": "' ||
  array_to_string(string_split(recordedBy, ' ')[1:-2], ' ') || '"}]' AS parsed FROM occurrences
""")
def u1(m):
    return U.enrich_in_batches(m.occurrences.select("gbifID", "recordedBy"), "recordedBy", _split_parser)


@query("U2_expand_names", """
SELECT id, CASE WHEN is_json AND family <> '' THEN family END AS family, CASE WHEN is_json AND family <> '' THEN given END AS given FROM agent_jobs
""")
def u2(m):
    return U.expand_names(m.agent_jobs).select("id", F.col("name.family").alias("family"),
                                               F.col("name.given").alias("given"))


@query("U3_expand_ids", """
SELECT DISTINCT l_orderkey || '-' || l_suppkey AS id, l_partkey + 1 AS occurrence_id, TRUE AS agent_role FROM lineitem WHERE l_returnflag <> 'A'
""")
def u3(m):
    return U.expand_ids(m.agent_jobs.select("id", "gbifIDs_recordedBy"), "gbifIDs_recordedBy", True).select(
        "id", "occurrence_id", "agent_role")


# --- B-series -------------------------------------------------------------------

_AGENT_KEY_SQL = """
keyed AS (SELECT j.id, j.l_orderkey, j.l_suppkey, CASE WHEN j.is_json AND j.family <> '' THEN j.family ELSE '' END AS family,
    CASE WHEN j.is_json AND j.family <> '' THEN j.given ELSE '' END AS given,
    CASE WHEN j.is_json AND j.family <> '' THEN '' ELSE trim(regexp_replace(j.agents, '\\s+', ' ', 'g')) END AS unparsed FROM agent_jobs j),
named AS (SELECT *, sha256('["' || family || '","' || given || '","","","","","","","' || unparsed || '"]') AS agent_id FROM keyed)
"""


@query("B2_agent_build_agents", "WITH " + _AGENT_KEY_SQL.strip() + """
SELECT DISTINCT agent_id, family, given, '' AS particle, '' AS appellation, '' AS title, '' AS suffix, '' AS nick, '' AS dropping_particle, unparsed FROM named
""")
def b2a(m):
    return B.agent_build(m.agent_jobs)[0]


@query("B2_agent_build_links", "WITH " + _AGENT_KEY_SQL.strip() + """
SELECT DISTINCT n.agent_id, l.l_returnflag <> 'A' AS agent_role, l.l_partkey + 1 AS occurrence_id
FROM named n JOIN lineitem l ON l.l_orderkey = n.l_orderkey AND l.l_suppkey = n.l_suppkey
""")
def b2b(m):
    return B.agent_build(m.agent_jobs)[1]


@query("B3_taxon_build", """
SELECT DISTINCT gbifID AS occurrence_id, sha256(trim(family)) AS taxon_id FROM occurrences
WHERE regexp_full_match(trim(family), '[a-zA-Z]+')
""")
def b3(m):
    groups = (m.occurrences.select("family", F.col("gbifID").alias("g"))
              .groupBy("family", F.floor(F.col("g") / 1000).alias("chunk"))
              .agg(F.collect_list("g").alias("gbifIDs_family")).drop("chunk"))
    return B.taxon_build(groups)[1]


_B5_SQL = """
gone AS (SELECT wikidata AS identifier, CASE WHEN (id - 1) % 70 <> 1 THEN 'Q' || (id - 1 + 1002) END AS redirect_to FROM users WHERE wikidata IS NOT NULL AND (id - 1) % 10 = 1),
src AS (SELECT gbifID, TRUE AS r, CASE WHEN gbifID % 3 = 0 THEN regexp_extract(recordedByID, '(Q[0-9]+)', 1) ELSE regexp_extract(recordedByID, '(Q[0-9]+)', 1) END AS identifier
        FROM occurrences WHERE recordedByID IS NOT NULL
        UNION ALL SELECT gbifID, FALSE, regexp_extract(identifiedByID, 'orcid\\.org/(.*)', 1) FROM occurrences WHERE identifiedByID IS NOT NULL),
final AS (SELECT s.gbifID, s.r, CASE WHEN g.identifier IS NOT NULL THEN g.redirect_to ELSE s.identifier END AS identifier FROM src s LEFT JOIN gone g ON g.identifier = s.identifier),
people AS (SELECT u.id AS user_id, f.gbifID AS occurrence_id, bool_or(f.r) AS r, bool_or(NOT f.r) AS i
  FROM final f JOIN users u ON f.identifier = coalesce(u.orcid, u.wikidata) AND f.identifier NOT IN (SELECT identifier FROM gone)
  WHERE u.id NOT IN (1, 2) GROUP BY 1, 2),
new AS (SELECT user_id, occurrence_id, CASE WHEN r AND i THEN 'recorded,identified' WHEN r THEN 'recorded' ELSE 'identified' END AS action FROM people)
"""


@query("B5_import_source_claims", "WITH " + _B5_SQL.strip() + """
SELECT user_id, occurrence_id, action, created_by FROM claims
UNION ALL SELECT n.user_id, n.occurrence_id, n.action, 2 FROM new n
WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.user_id = n.user_id AND c.occurrence_id = n.occurrence_id)
""")
def b5(m):
    """Source ids of all kinds: Wikidata, ORCID, and numbers of another authority with a table of
    its people; some Wikidata ids were merged into others, some are banned."""
    k = F.col("id") - 1
    gone = m.users.filter(F.col("wikidata").isNotNull() & (k % 10 == 1)).select(
        F.col("wikidata").alias("identifier"), F.when(k % 70 != 1, F.concat(F.lit("Q"), (k + 1002).cast("string"))).alias("redirect_to"))
    number = F.regexp_extract("recordedByID", "Q([0-9]+)", 1)
    other = F.concat(F.lit("https://viaf.org/viaf/"), number)
    occ = m.occurrences.withColumn("recordedByID", F.when(F.col("gbifID") % 3 == 0, other).otherwise(F.col("recordedByID")))
    known = m.occurrences.select(F.lit("viaf").alias("authority"), number.alias("id"), F.concat(F.lit("Q"), number).alias("wikidata"))
    return B.import_source_claims(occ, m.users, m.claims, gone, known.filter("id <> ''").distinct())


@query("B9_orphan_cleanup_claims", """
SELECT user_id, occurrence_id FROM claims c
WHERE EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id)
""")
def b9(m):
    return B.orphan_cleanup(m.claims, m.occurrences, m.users, m.article_occurrences)["claims"].select(
        "user_id", "occurrence_id")


# --- P-series projections ------------------------------------------------------------

@query("P12_user_names", f"""
SELECT id, {_FULL.format(p='u')} AS fullname,
  CASE WHEN u.family IS NULL OR trim(u.family) = '' THEN u.orcid ELSE
    trim(concat_ws(', ', nullif(trim(concat_ws(' ', nullif(trim(u.particle), ''), nullif(trim(u.family), ''))), ''),
                   nullif(trim(u.given), ''))) END AS fullname_reverse,
  coalesce(u.label, {_FULL.format(p='u')}) AS viewname
FROM users u
""")
def p12(m):
    n = S.user_names()
    return m.users.select("id", n["fullname"].alias("fullname"), n["fullname_reverse"].alias("fullname_reverse"),
                          n["viewname"].alias("viewname"))


@query("P13_initials", r"""
SELECT id, regexp_replace(regexp_replace(given, '(\p{Lu})\p{Ll}+', '\1.', 'g'), '\s+', '', 'g') AS initials FROM users
""")
def p13(m):
    return m.users.select("id", S.initials("given").alias("initials"))


@query("P18_person_uri", f"""
SELECT id, {_URI.format(p='u')} AS uri, coalesce(u.orcid, u.wikidata, CAST(u.id AS VARCHAR)) AS identifier FROM users u
""")
def p18(m):
    return m.users.select("id", S.person_uri().alias("uri"), S.identifier().alias("identifier"))


@query("P19_license_uri", """
SELECT gbifID, CASE license WHEN 'CC_BY_4_0' THEN 'https://creativecommons.org/licenses/by/4.0/legalcode'
  WHEN 'CC_BY_NC_4_0' THEN 'https://creativecommons.org/licenses/by-nc/4.0/legalcode'
  WHEN 'CC0_1_0' THEN 'https://creativecommons.org/publicdomain/zero/1.0/legalcode' END AS license_uri
FROM occurrences
""")
def p19(m):
    return m.occurrences.select("gbifID", S.license_uri("license").alias("license_uri"))


@query("P20_coordinates", """
SELECT gbifID, CASE WHEN bad THEN NULL ELSE lo END AS longitude, CASE WHEN bad THEN NULL ELSE la END AS latitude FROM (
  SELECT gbifID, la, lo, (la = 0 OR lo = 0 OR la > 90 OR la < -90 OR lo > 180 OR lo < -180) AS bad FROM (
    SELECT gbifID, coalesce(TRY_CAST(decimalLatitude AS DOUBLE), 0.0) AS la, coalesce(TRY_CAST(decimalLongitude AS DOUBLE), 0.0) AS lo
    FROM occurrences))
""")
def p20(m):
    c = S.coordinates()
    return m.occurrences.select("gbifID", c[0].alias("longitude"), c[1].alias("latitude"))


_RES = """CASE WHEN {d} IS NULL THEN NULL
  WHEN {p} = 'century' THEN make_date(CAST(year({d}) - 100 AS INTEGER), 1, 1)
  WHEN {p} = 'year' THEN make_date(CAST(year({d}) AS INTEGER), 12, 31)
  WHEN {p} = 'month' THEN make_date(CAST(year({d}) AS INTEGER), CAST(month({d}) AS INTEGER), 28)
  ELSE {d} END"""


@query("P21_resolved_dates", f"""
SELECT id, {_RES.format(d='date_born', p='date_born_precision')} AS born,
       {_RES.format(d='date_died', p='date_died_precision')} AS died FROM users
""")
def p21(m):
    return m.users.select("id", S.resolved_date("date_born", "date_born_precision").alias("born"),
                          S.resolved_date("date_died", "date_died_precision").alias("died"))


@query("P22_valid_year", """
SELECT gbifID, CASE WHEN TRY_CAST(substring("year", 1, 4) AS INTEGER) BETWEEN 1756 AND 2002
                    THEN TRY_CAST(substring("year", 1, 4) AS INTEGER) END AS valid_year FROM occurrences
""")
def p22(m):
    return m.occurrences.select("gbifID", S.valid_year("year", AS_OF).alias("valid_year"))


@query("P25_membership_dates", """
SELECT user_id, organization_id,
  CASE WHEN start_year IS NOT NULL THEN make_date(start_year, coalesce(start_month, 1), coalesce(start_day, 1)) END AS start_date,
  CASE WHEN end_year IS NOT NULL THEN make_date(end_year, coalesce(end_month, 1), coalesce(end_day, 1)) END AS end_date
FROM user_organizations
""")
def p25(m):
    return m.user_organizations.select("user_id", "organization_id", S.membership_dates("start").alias("start_date"),
                                       S.membership_dates("end").alias("end_date"))


@query("P26_has_lifespan_evidence", """
SELECT id, family IS NOT NULL AND orcid IS NULL AND (
  (date_died IS NOT NULL AND date_died_precision IS NOT NULL) OR
  (date_born IS NOT NULL AND date_born_precision IS NOT NULL AND 2002 - year(date_born) >= 120)) AS evidence
FROM users
""")
def p26(m):
    return m.users.select("id", S.has_lifespan_evidence(AS_OF).alias("evidence"))


@query("P27_role_flags", """
SELECT user_id, occurrence_id, coalesce(action LIKE '%recorded%', FALSE) AS is_recorded,
  coalesce(action LIKE '%identified%', FALSE) AS is_identified,
  coalesce(action LIKE '%recorded%', FALSE) AND coalesce(action LIKE '%identified%', FALSE) AS is_both
FROM claims
""")
def p27(m):
    f = S.role_flags()
    return m.claims.select("user_id", "occurrence_id", *[v.alias(k) for k, v in f.items()])


@query("P28_preferred_org_id", """
SELECT id, coalesce(wikidata, ror, grid, ringgold, isni) AS preferred FROM organizations
""")
def p28(m):
    return m.organizations.select("id", S.preferred_org_id().alias("preferred"))


_CHECK = ("(12 - list_reduce(list_transform(range(1, 16), lambda i: CAST(substring(replace(orcid, '-', ''), CAST(i AS INTEGER), 1) AS BIGINT)), "
          "lambda t, x: (t * 2 + x) % 11) * 2 % 11) % 11")


@query("P14_identifier_checks", f"""
SELECT id, coalesce(regexp_full_match(orcid, '0000-000(1-[5-9]|2-[0-9]|3-[0-4])[0-9]{{3}}-[0-9]{{3}}[0-9X]|0009-00[01][0-9]-[0-9]{{4}}-[0-9]{{3}}[0-9X]')
    AND right(orcid, 1) = CASE WHEN {_CHECK} = 10 THEN 'X' ELSE CAST({_CHECK} AS VARCHAR) END, FALSE) AS orcid_ok,
  coalesce(regexp_full_match(orcid, '.*'), FALSE) AND right(orcid, 1) <> CASE WHEN {_CHECK} = 10 THEN 'X' ELSE CAST({_CHECK} AS VARCHAR) END AS orcid_bad,
  coalesce(regexp_full_match(wikidata, 'Q[0-9]+'), FALSE) AS wiki_ok
FROM users
""")
def p14(m):
    """ORCID and Wikidata checks on every person's identifiers."""
    return m.users.select("id", S.is_orcid("orcid").alias("orcid_ok"), (F.col("orcid").isNotNull() & ~S.orcid_checksum_ok("orcid")).alias("orcid_bad"),
                          S.is_wiki_id("wikidata").alias("wiki_ok"))


_FOLD = (r"regexp_replace(replace(replace(replace(strip_accents(lower({x})), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), '(^|[^q])ue', '\1u', 'g')")


@query("P30_name_keys", f"""
SELECT id, {_FOLD.format(x='family')} AS folded,
  list_filter(string_split_regex({_FOLD.format(x="given || ' ' || family")}, '[., ]'), lambda t: t <> '') AS tokens,
  strip_accents(lower(regexp_replace(given || ' ' || family, '[a-z.\\s]', '', 'g'))) AS ikey
FROM users
""")
def p30(m):
    return m.users.select("id", S.fold_name("family").alias("folded"), S.name_tokens(
        F.concat_ws(" ", "given", "family")).alias("tokens"), S.initials_key(F.concat_ws(" ", "given", "family"))
        .alias("ikey"))
