"""Registered aggregation queries (G-series) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from herbaria.operators import aggs
from herbaria.plans.registry import query

# --- G12 / G13: agent link counts per scope ---------------------------------

_G12_SQL = """
SELECT {key}, oa.agent_id, count(*) AS count_all
FROM {scope} s JOIN occurrence_agents oa ON oa.occurrence_id = s.occurrence_id
JOIN agents a ON a.id = oa.agent_id
WHERE a.family <> '' {extra}
GROUP BY {key}, oa.agent_id
"""
_UNCLAIMED = "AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = s.occurrence_id)"
_SCOPES = {
    "dataset": ("s.datasetKey", "(SELECT datasetKey, gbifID AS occurrence_id FROM occurrences)"),
    "taxon": ("s.family", "taxon_occurrences"),
    "article": ("s.article_id", "article_occurrences"),
}
#: Every citation under the id of its specimen; ``article_occurrences`` has a tenth under ids that no specimen has.
_CITED = "(SELECT DISTINCT l_orderkey + 1 AS article_id, l_partkey + 1 AS occurrence_id FROM lineitem)"


def _scope(m, kind):
    if kind == "dataset":
        return aggs.scope_of_occurrences(m.occurrences, "datasetKey")
    if kind == "taxon":
        return m.taxon_occurrences
    return m.article_occurrences


def _register_agent_counts():
    for kind, (key, scope_sql) in _SCOPES.items():
        def g12(m, kind=kind):
            scope = m.article_specimens if kind == "article" else _scope(m, kind)
            return aggs.agent_counts(scope, m.occurrence_agents, m.agents, small=kind == "article")

        def g13(m, kind=kind):
            return aggs.agent_counts(_scope(m, kind), m.occurrence_agents, m.agents, claims=m.claims, small=kind == "article")

        query(f"G12_agent_counts_{kind}",
              _G12_SQL.format(key=key, scope=_CITED if kind == "article" else scope_sql, extra=""))(g12)
        query(f"G13_agent_counts_unclaimed_{kind}",
              _G12_SQL.format(key=key, scope=scope_sql, extra=_UNCLAIMED))(g13)


_register_agent_counts()


# --- per-person aggregates -----------------------------------------------------

import datetime as _dt  # noqa: E402

from herbaria.operators import joins as J  # noqa: E402
from herbaria.operators import windows as N  # noqa: E402
from herbaria.sources.testdata import AS_OF  # noqa: E402

REC = "('recorded','recorded,identified','identified,recorded')"
IDN = "('identified','recorded,identified','identified,recorded')"
BOTH = "('recorded,identified','identified,recorded')"
_ROLES = {"recorded": REC, "identified": IDN}

for _kind, _in in _ROLES.items():
    for _helped in (False, True):
        _extra = "AND c.created_by <> c.user_id" if _helped else ""
        query(f"G2_families_{_kind}" + ("_helped" if _helped else ""), f"""
SELECT c.user_id, t.family, count(*) AS n FROM claims c JOIN taxon_occurrences t ON t.occurrence_id = c.occurrence_id
WHERE c.visible AND c.action IN {_in} {_extra} GROUP BY c.user_id, t.family""")(
            lambda m, k=_kind, h=_helped: aggs.families_by_role(m.claims, m.taxon_occurrences, k, h))


@query("G2_top_family_recorded", f"""
SELECT user_id, family, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, family, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, family ASC) AS rank FROM (
    SELECT c.user_id, t.family, count(*) AS n FROM claims c JOIN taxon_occurrences t ON t.occurrence_id = c.occurrence_id
    WHERE c.visible AND c.action IN {REC} GROUP BY c.user_id, t.family) a) b
WHERE rank <= 1
""")
def g2_top(m):
    fams = aggs.families_by_role(m.claims, m.taxon_occurrences, "recorded")
    return N.top_k_per_group(fams, "user_id", "n", 1, "family")


@query("G3_role_counts", f"""
SELECT user_id, count(*) FILTER (WHERE action IN {IDN}) AS identified,
       count(*) FILTER (WHERE action IN {REC}) AS recorded, count(*) AS all_claims,
       count(*) FILTER (WHERE action IN {BOTH}) AS both_roles,
       count(*) FILTER (WHERE action IS NOT NULL) AS either_role
FROM claims WHERE visible GROUP BY user_id
""")
def g3(m):
    return aggs.role_counts(m.claims)


for _helped in (False, True):
    _extra = "AND c.created_by <> c.user_id" if _helped else ""
    query("G4_country_counts" + ("_helped" if _helped else ""), f"""
SELECT c.user_id, CASE WHEN k.code IS NOT NULL THEN o2.code ELSE 'OTHER' END AS country,
       count(*) FILTER (WHERE c.action = 'recorded' OR c.action IN {BOTH}) AS recorded,
       count(*) FILTER (WHERE c.action = 'identified' OR c.action IN {BOTH}) AS identified
FROM claims c
JOIN (SELECT gbifID, coalesce(countryCode, 'ZZ') AS code FROM occurrences) o2 ON o2.gbifID = c.occurrence_id
LEFT JOIN countries k ON k.code = o2.code
WHERE c.visible AND c.action IS NOT NULL {_extra}
GROUP BY 1, 2""")(lambda m, h=_helped: aggs.country_counts(m.claims, m.occurrences, m.countries, h))


@query("G5_distinct_countries", f"""
SELECT c.user_id, count(DISTINCT o.countryCode) AS countries
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN {REC} GROUP BY c.user_id
""")
def g5(m):
    return aggs.distinct_countries(m.claims, m.occurrences)


@query("G6_families_countries", """
SELECT DISTINCT c.user_id,
  CASE WHEN c.action LIKE '%recorded%' THEN 'recorded' WHEN c.action LIKE '%identified%' THEN 'identified' END AS role,
  o.family, o.countryCode
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IS NOT NULL AND o.family IS NOT NULL
""")
def g6(m):
    return aggs.families_countries(m.claims, m.occurrences)


_BINS_SQL = """
WITH counts AS (
  SELECT c.user_id, CAST(floor(o.{f}_year / {w}) * {w} AS INTEGER) AS bin, count(*) AS n
  FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.visible AND c.action IN {roles} {extra} AND o.{f}_year IS NOT NULL AND o.{f} <= DATE '2002-01-01'
  GROUP BY 1, 2),
spans AS (SELECT user_id, min(bin) AS lo, max(bin) AS hi FROM counts GROUP BY user_id),
grid AS (SELECT user_id, CAST(unnest(range(lo, hi + 1, {w})) AS INTEGER) AS bin FROM spans)
SELECT g.user_id, g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN counts c USING (user_id, bin)
"""
for _kind, _in in _ROLES.items():
    _f = "eventDate_processed" if _kind == "recorded" else "dateIdentified_processed"
    for _w in (1, 5):
        query(f"G7_year_bins_{_kind}_{_w}", _BINS_SQL.format(f=_f, w=_w, roles=_in, extra=""))(
            lambda m, k=_kind, w=_w: aggs.year_bins(m.claims, m.occurrences, k, w, as_of=AS_OF))
    query(f"G7_year_bins_{_kind}_helped", _BINS_SQL.format(
        f=_f, w=2, roles=_in, extra="AND c.created_by <> c.user_id"))(
        lambda m, k=_kind: aggs.year_bins(m.claims, m.occurrences, k, 2, helped=True, as_of=AS_OF))

for _kind, _in in _ROLES.items():
    query(f"G8_deposited_at_{_kind}", f"""
SELECT c.user_id, o.institutionCode, count(*) AS n FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN {_in} AND o.institutionCode IS NOT NULL GROUP BY 1, 2""")(
        lambda m, k=_kind: aggs.deposited_at(m.claims, m.occurrences, k))


@query("G9_collector_strings", f"""
SELECT c.user_id, o.recordedBy, count(*) AS n FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN {REC} GROUP BY 1, 2
""")
def g9(m):
    return aggs.collector_strings(m.claims, m.occurrences)


@query("G18_helped_counts", """
SELECT created_by AS claimant_id, user_id, count(*) AS n, max(created) AS latest
FROM claims WHERE visible AND created_by <> user_id GROUP BY 1, 2
""")
def g18(m):
    return aggs.helped_counts(m.claims)


@query("G20_latest_attribution", """
SELECT user_id, greatest(max(created), coalesce(max(updated), max(created))) AS latest
FROM claims WHERE visible GROUP BY user_id
""")
def g20(m):
    return aggs.latest_attribution(m.claims)


@query("G38_lifelist_rank", f"""
SELECT c.user_id, count(DISTINCT t.family) AS rank FROM claims c JOIN taxon_occurrences t ON t.occurrence_id = c.occurrence_id
WHERE c.visible AND c.action IN {REC} GROUP BY c.user_id
""")
def g38(m):
    return aggs.lifelist_rank(m.claims, m.taxon_occurrences)


# --- per-scope aggregates ------------------------------------------------------

@query("G1_source_counts", """
SELECT datasetKey, count(*) AS n FROM occurrences WHERE recordedByID IS NOT NULL OR identifiedByID IS NOT NULL
GROUP BY datasetKey
""")
def g1(m):
    return aggs.source_counts(m.occurrences)


_TL_SQL = """
SELECT o.{scope}, c.user_id, min(o.{f}) AS min_date, max(o.{f}) AS max_date
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN {roles} AND o.{f}_year BETWEEN {a} AND {b} AND o.{f} IS NOT NULL
GROUP BY 1, 2
"""
for _scope_name, _scope_col in (("dataset", "datasetKey"), ("taxon", "family")):
    for _kind, _in in _ROLES.items():
        _f = "eventDate_processed" if _kind == "recorded" else "dateIdentified_processed"
        _gid = "G10" if _scope_name == "dataset" else "G11"
        query(f"{_gid}_timeline_{_scope_name}_{_kind}", _TL_SQL.format(
            scope=_scope_col, f=_f, roles=_in, a=1996, b=2000))(
            lambda m, s=_scope_col, k=_kind: aggs.timeline(m.claims, m.occurrences, s, k, 1996, 2000))


@query("G14_dataset_progress", """
WITH occ AS (SELECT datasetKey, gbifID FROM occurrences),
claimed AS (SELECT o.datasetKey, count(*) AS claimed FROM occ o
            WHERE EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID AND c.visible) GROUP BY 1),
total AS (SELECT datasetKey, count(*) AS total FROM occ GROUP BY 1)
SELECT t.datasetKey, t.total, CAST(coalesce(c.claimed, 0) AS BIGINT) AS claimed,
       CAST(greatest(t.total - coalesce(c.claimed, 0), 0) AS BIGINT) AS unclaimed
FROM total t LEFT JOIN claimed c USING (datasetKey)
""")
def g14(m):
    return aggs.dataset_progress(m.occurrences, m.claims)


for _code in ("institutionCode", "collectionCode"):
    query(f"G15_top_{_code}s", f"""
SELECT datasetKey, {_code}, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT datasetKey, {_code}, n, row_number() OVER (PARTITION BY datasetKey ORDER BY n DESC, {_code} ASC) AS rank
  FROM (SELECT datasetKey, {_code}, count(*) AS n FROM occurrences WHERE {_code} IS NOT NULL GROUP BY 1, 2) a) b
WHERE rank <= 4""")(lambda m, c=_code: N.top_k_per_group(aggs.code_counts(m.occurrences, c), "datasetKey", "n", 4, c))
    query(f"G16_{_code}_lists", f"""
SELECT datasetKey, string_agg({_code}, '|' ORDER BY {_code}) AS codes
FROM (SELECT DISTINCT datasetKey, {_code} FROM occurrences WHERE {_code} IS NOT NULL) GROUP BY datasetKey""")(
        lambda m, c=_code: aggs.code_lists(m.occurrences, c))


@query("G17_scribes", """
SELECT DISTINCT o.datasetKey, c.created_by AS scribe_id
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.created_by <> c.user_id AND c.created_by NOT IN (1, 2)
""")
def g17(m):
    return aggs.scribes(m.occurrences, m.claims)


@query("G21_article_stats", """
WITH claimed AS (SELECT a.article_id, count(*) AS claimed FROM article_occurrences a
                 WHERE EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = a.occurrence_id AND c.visible) GROUP BY 1),
total AS (SELECT article_id, count(*) AS total FROM article_occurrences GROUP BY 1)
SELECT t.article_id, t.total, CAST(coalesce(c.claimed, 0) AS BIGINT) AS claimed FROM total t LEFT JOIN claimed c USING (article_id)
""")
def g21(m):
    return aggs.article_stats(m.article_occurrences, m.claims)


@query("G21_article_user_counts", """
SELECT a.article_id, c.user_id, count(*) AS n FROM article_occurrences a
JOIN claims c ON c.occurrence_id = a.occurrence_id WHERE c.visible GROUP BY 1, 2
""")
def g21b(m):
    return aggs.article_user_counts(m.article_occurrences, m.claims)


@query("G23_occurrence_counts", """
WITH u AS (SELECT occurrence_id, count(*) AS user_count FROM claims WHERE action LIKE '%recorded%'
           GROUP BY occurrence_id HAVING count(*) > 1),
a AS (SELECT occurrence_id, count(DISTINCT agent_id) AS agent_count FROM occurrence_agents WHERE agent_role GROUP BY 1)
SELECT u.occurrence_id, u.user_count, a.agent_count FROM u LEFT JOIN a USING (occurrence_id)
WHERE a.agent_count IS NOT NULL AND a.agent_count NOT IN (1, 2)
""")
def g23(m):
    return aggs.occurrence_counts(m.claims, m.occurrence_agents)


@query("G25_recorder_report", """
SELECT oa.agent_id, count(*) AS n, concat_ws('–', min(o."year"), max(o."year")) AS event_range,
  min(CASE WHEN CAST(substring(o."year", 1, 4) AS INTEGER) BETWEEN 1756 AND 2002 THEN CAST(substring(o."year", 1, 4) AS INTEGER) END) AS min_year,
  max(CASE WHEN CAST(substring(o."year", 1, 4) AS INTEGER) BETWEEN 1756 AND 2002 THEN CAST(substring(o."year", 1, 4) AS INTEGER) END) AS max_year,
  array_to_string(list_sort(list_distinct(list(o.family))), ' | ') AS families,
  array_to_string(list_sort(list_distinct(list(o.institutionCode))), ' | ') AS institutions
FROM occurrence_agents oa JOIN occurrences o ON o.gbifID = oa.occurrence_id
WHERE oa.agent_role GROUP BY oa.agent_id
""")
def g25(m):
    return aggs.recorder_report(m.occurrence_agents, m.occurrences, AS_OF)


@query("G27_orphan_counts", """
SELECT user_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(created_by AS VARCHAR)))), ',') AS claimants
FROM claims c WHERE c.visible AND NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id)
GROUP BY user_id
""")
def g27(m):
    return aggs.orphan_counts(J.orphans(m.claims, m.occurrences))


@query("G28_dataset_counters", """
WITH total AS (SELECT datasetKey, count(*) AS occurrences_count FROM occurrences GROUP BY 1),
src AS (SELECT o.datasetKey, count(*) AS n FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
        WHERE c.created_by = 2 GROUP BY 1)
SELECT t.datasetKey, t.occurrences_count, CAST(coalesce(s.n, 0) AS BIGINT) AS source_attribution_count
FROM total t LEFT JOIN src s USING (datasetKey)
""")
def g28(m):
    return aggs.dataset_counters(m.occurrences, m.claims)


@query("G29_duplicate_institution_codes", """
WITH codes AS (SELECT id, unnest(institution_codes) AS code FROM organization_records)
SELECT c.id, c.code FROM codes c WHERE c.code IN (SELECT code FROM codes GROUP BY code HAVING count(*) > 1)
""")
def g29(m):
    codes = m.organization_records.select("id", F.explode("institution_codes").alias("code"))
    return aggs.duplicate_values(codes, "code").select("id", "code")


@query("G29_duplicate_wikidata", """
SELECT o.id, o.wikidata FROM organization_records o
WHERE o.wikidata IN (SELECT wikidata FROM organization_records WHERE wikidata IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
""")
def g29b(m):
    return aggs.duplicate_values(m.organization_records, "wikidata").select("id", "wikidata")


@query("G30_country_people", """
SELECT code, count(*) AS n FROM (SELECT unnest(string_split(country_code, '|')) AS code FROM users) WHERE code <> ''
GROUP BY code
""")
def g30(m):
    return aggs.country_people(m.users)


@query("G31_scribe_stats", """
SELECT count(*) AS attribution_count, count(DISTINCT created_by) AS scribe_count, count(DISTINCT user_id) AS recipient_count
FROM claims WHERE action IS NOT NULL AND created_by NOT IN (1, 2) AND user_id <> created_by
""")
def g31(m):
    return aggs.scribe_stats(m.claims)


_MONTHLY_SQL = """
SELECT year, month, n, CAST(sum(n) OVER (ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
FROM (SELECT CAST(year(created) AS INTEGER) AS year, CAST(month(created) AS INTEGER) AS month, count(*) AS n
      FROM claims WHERE created_by NOT IN (1, 2) AND {cond} AND created < TIMESTAMP '2001-07-01'
      GROUP BY 1, 2)
"""
for _kind, _cond in {"claims": "visible AND created_by = user_id",
                     "attributions": "visible AND created_by <> user_id",
                     "rejected": "NOT visible"}.items():
    query(f"G32_monthly_{_kind}", _MONTHLY_SQL.format(cond=_cond))(
        lambda m, k=_kind: aggs.monthly(m.claims, k, _dt.date(2001, 7, 15)))


@query("G33_monthly_profiles", """
SELECT year, month, wikidata_n, orcid_n,
  CAST(sum(wikidata_n) OVER (ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS wikidata_total,
  CAST(sum(orcid_n) OVER (ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS orcid_total
FROM (SELECT CAST(year(created) AS INTEGER) AS year, CAST(month(created) AS INTEGER) AS month,
             count(wikidata) AS wikidata_n, count(orcid) AS orcid_n
      FROM users WHERE created < TIMESTAMP '2000-01-01' GROUP BY 1, 2)
""")
def g33(m):
    return aggs.monthly_profiles(m.users, _dt.date(2000, 1, 20))


@query("G34_profile_totals", """
SELECT 'orcid' AS kind, count(*) AS total, count(*) FILTER (WHERE visited) AS visited,
       count(*) FILTER (WHERE is_public) AS public, count(zenodo_doi) AS doi FROM users WHERE orcid IS NOT NULL
UNION ALL
SELECT 'wikidata', count(*), count(*) FILTER (WHERE visited), count(*) FILTER (WHERE is_public), count(zenodo_doi)
FROM users WHERE wikidata IS NOT NULL
""")
def g34(m):
    return aggs.profile_totals(m.users)


@query("G34_site_totals", """
SELECT 'datasets' AS name, count(*) AS n FROM datasets
UNION ALL SELECT 'datasets_with_identifiers', count(DISTINCT o.datasetKey) FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.created_by = 2
UNION ALL SELECT 'wikidata_merged', count(*) FROM destroyed_users d JOIN users u ON CAST(u.id AS VARCHAR) = d.identifier
  WHERE u.wikidata IS NOT NULL
UNION ALL SELECT 'source_claims', count(*) FROM claims WHERE created_by = 2
""")
def g34b(m):
    gone = m.destroyed_users.join(m.users.select(F.col("id").cast("string").alias("identifier"), "wikidata"), "identifier")
    gone = gone.select(F.col("wikidata").alias("identifier"))
    return aggs.site_totals(m.datasets, aggs.dataset_counters(m.occurrences, m.claims), gone, m.claims)


@query("G35_org_user_counts", "SELECT organization_id, count(user_id) AS user_count FROM user_organizations GROUP BY 1")
def g35(m):
    return aggs.org_user_counts(m.user_organizations)


@query("G36_others_tally", """
WITH first_start AS (SELECT organization_id, coalesce(min(start_year), 1600) AS s FROM user_organizations GROUP BY 1)
SELECT uo.organization_id, o.institutionCode, count(*) AS n
FROM user_organizations uo JOIN first_start f ON f.organization_id = uo.organization_id
JOIN claims c ON c.user_id = uo.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
JOIN organizations g ON g.id = uo.organization_id
WHERE c.action LIKE '%recorded%' AND o.institutionCode IS NOT NULL
  AND NOT list_contains(g.institution_codes, o.institutionCode) AND o.eventDate_processed_year >= f.s
  AND ((uo.end_year IS NULL AND o.eventDate_processed_year >= uo.start_year)
       OR (uo.end_year IS NOT NULL AND uo.start_year IS NOT NULL
           AND o.eventDate_processed_year BETWEEN uo.start_year AND uo.end_year))
GROUP BY 1, 2
""")
def g36(m):
    return aggs.others_tally(J.employment_specimens(m.organizations, m.user_organizations, m.claims, m.occurrences))


@query("G39_download_totals", """
SELECT a.id AS article_id, CAST(sum(d.total_records) AS BIGINT) AS total_records
FROM (SELECT id, unnest(gbif_downloadkeys) AS key FROM articles) a JOIN downloads d ON d.key = a.key GROUP BY 1
""")
def g39(m):
    return aggs.download_totals(m.articles, m.downloads)


# --- windows -------------------------------------------------------------------

@query("N2_latest_claim_per_person", """
SELECT c.user_id, c.occurrence_id, c.created FROM claims c
JOIN (SELECT user_id, max(created) AS mx FROM claims WHERE created_by <> user_id GROUP BY 1) l
  ON l.user_id = c.user_id AND l.mx = c.created
WHERE c.created_by <> c.user_id
""")
def n2(m):
    others = m.claims.filter(F.col("created_by") != F.col("user_id"))
    return N.latest_per_group(others, "user_id", "created").select("user_id", "occurrence_id", "created")


@query("N7_random_sample", "SELECT id FROM users WHERE is_public ORDER BY md5(id || ':42'), id LIMIT 25")
def n7(m):
    """Seeded sample of 25 public people (the sample is the feature)."""
    return N.random_sample(m.users.filter(F.col("is_public")), "id", 25, 42).select("id")


@query("N9_newest_orcid", """
SELECT id, created FROM users WHERE orcid IS NOT NULL ORDER BY created DESC, id DESC LIMIT 25
""")
def n9(m):
    return N.newest(m.users, "orcid", 25).select("id", "created")
