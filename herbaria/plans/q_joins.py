"""Registered join queries (J-series) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from herbaria.operators import aggs
from herbaria.operators import joins as J
from herbaria.plans.registry import query

REC = "('recorded','recorded,identified','identified,recorded')"
IDN = "('identified','recorded,identified','identified,recorded')"


@query("J1_missing_claims", """
SELECT DISTINCT c.occurrence_id FROM claims c
WHERE c.visible AND NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id)
""")
def j1(m):
    return J.missing_claims(m.claims, m.occurrences)


@query("J5_orphans", """
SELECT c.occurrence_id, c.user_id, c.created_by FROM claims c
WHERE c.visible AND NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id)
""")
def j5(m):
    return J.orphans(m.claims, m.occurrences)


@query("J6_purge_orphan_article_links", """
SELECT a.article_id, a.occurrence_id FROM article_occurrences a
WHERE EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = a.occurrence_id)
""")
def j6(m):
    return J.purge_orphans(m.article_occurrences, m.occurrences)


@query("J6_purge_hidden_orphan_claims", """
SELECT c.user_id, c.occurrence_id, c.visible FROM claims c
WHERE EXISTS (SELECT 1 FROM occurrences o WHERE o.gbifID = c.occurrence_id) OR c.visible
""")
def j6b(m):
    return J.purge_orphans(m.claims, m.occurrences, only_hidden=True).select("user_id", "occurrence_id", "visible")


@query("J7_unresolved_source_people", """
SELECT o.gbifID, o.datasetKey, o.recordedByID FROM occurrences o
WHERE o.recordedByID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID)
""")
def j7(m):
    return J.unresolved_source_people(m.occurrences, m.claims).select("gbifID", "datasetKey", "recordedByID")


_PEOPLE_SCOPES = {
    "dataset": ("datasetKey", "(SELECT datasetKey, gbifID AS occurrence_id FROM occurrences)"),
    "taxon": ("family", "taxon_occurrences"),
    "article": ("article_id", "article_occurrences"),
}


def _scope(m, kind):
    if kind == "dataset":
        return aggs.scope_of_occurrences(m.occurrences, "datasetKey")
    if kind == "taxon":
        return m.taxon_occurrences
    return m.article_occurrences


for _kind, (_key, _scope_sql) in _PEOPLE_SCOPES.items():
    query(f"J8_people_of_{_kind}", f"""
SELECT DISTINCT s.{_key}, c.user_id FROM claims c JOIN {_scope_sql} s ON s.occurrence_id = c.occurrence_id
WHERE c.visible""")(lambda m, k=_kind: J.people_of(_scope(m, k), m.claims, small=k == "article"))
    for _role, _flag in [("recorded", "TRUE"), ("identified", "FALSE")]:
        query(f"J21_agents_of_{_kind}_{_role}", f"""
SELECT DISTINCT s.{_key}, oa.agent_id FROM {_scope_sql} s
JOIN occurrence_agents oa ON oa.occurrence_id = s.occurrence_id
JOIN agents a ON a.id = oa.agent_id
WHERE oa.agent_role = {_flag} AND a.family <> ''""")(
            lambda m, k=_kind, r=(_role == "recorded"): J.agents_of(_scope(m, k), m.occurrence_agents, m.agents, r, small=k == "article"))


_NET_SQL = """
WITH a AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN {left}),
     b AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN {right})
SELECT a.user_id, b.user_id AS other_id, count(*) AS shared
FROM a JOIN b ON a.occurrence_id = b.occurrence_id
WHERE a.user_id <> b.user_id
GROUP BY a.user_id, b.user_id
"""

query("J9_recorded_with", _NET_SQL.format(left=REC, right=REC))(lambda m: J.recorded_with(m.claims))
query("J10_identified_for", _NET_SQL.format(left=IDN, right=REC))(lambda m: J.identified_for(m.claims))
query("J11_identified_by", _NET_SQL.format(left=REC, right=IDN))(lambda m: J.identified_by(m.claims))


@query("J12_recordings_with", f"""
WITH b AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN {REC})
SELECT a.user_id, b.user_id AS other_id, a.occurrence_id
FROM claims a JOIN b ON a.occurrence_id = b.occurrence_id
WHERE a.visible AND a.action IN {REC} AND a.user_id <> b.user_id
""")
def j12(m):
    return J.specimens_of_pair(m.claims, "recorded", "recorded")


for _name, _left, _right in (("identifications_for", "identified", "recorded"), ("identifications_by", "recorded", "identified")):
    query(f"J12_{_name}", f"""
WITH b AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN {REC if _right == "recorded" else IDN})
SELECT a.user_id, b.user_id AS other_id, a.occurrence_id
FROM claims a JOIN b ON a.occurrence_id = b.occurrence_id
WHERE a.visible AND a.action IN {REC if _left == "recorded" else IDN} AND a.user_id <> b.user_id""")(
        lambda m, left=_left, right=_right: J.specimens_of_pair(m.claims, left, right))


@query("J13_agents_recorded_with", """
SELECT DISTINCT a.agent_id, b.agent_id AS other_agent_id
FROM occurrence_agents a JOIN occurrence_agents b ON a.occurrence_id = b.occurrence_id
WHERE a.agent_role AND a.agent_id <> b.agent_id
""")
def j13(m):
    return J.agents_recorded_with(m.occurrence_agents)


@query("J14_same_family_first_initial", """
WITH people AS (SELECT id, family, given FROM agents UNION ALL SELECT id + 1000000000, family, given FROM users)
SELECT a.id AS agent_id, b.id AS other_agent_id, a.family
FROM people a JOIN people b ON a.family = b.family
WHERE a.id <> b.id AND a.family <> '' AND a.given <> ''
  AND lower(substring(a.given, 1, 1)) = lower(substring(b.given, 1, 1))
""")
def j14(m):
    """Namesakes among agents and people: the few agents of a small scale alone have none."""
    people = m.users.select((F.col("id") + 1_000_000_000).alias("id"), "family", "given")
    return J.same_family(m.agents.select("id", "family", "given").unionByName(people), first_initial=True)


@query("J14_same_family", """
SELECT a.id AS agent_id, b.id AS other_agent_id, a.family
FROM agents a JOIN agents b ON a.family = b.family WHERE a.id <> b.id AND a.family <> ''
""")
def j14b(m):
    return J.same_family(m.agents)


_EMP_SQL = """
WITH first_start AS (
  SELECT organization_id, coalesce(min(start_year), 1600) AS org_first_start
  FROM user_organizations GROUP BY organization_id)
SELECT uo.organization_id, uo.user_id, o.gbifID AS occurrence_id, o.institutionCode, o.{year} AS y
FROM user_organizations uo
JOIN first_start f ON f.organization_id = uo.organization_id
JOIN claims c ON c.user_id = uo.user_id
JOIN occurrences o ON o.gbifID = c.occurrence_id
JOIN organizations g ON g.id = uo.organization_id
WHERE c.action LIKE '%{kind}%' AND o.institutionCode IS NOT NULL
  AND NOT list_contains(g.institution_codes, o.institutionCode)
  AND o.{year} >= f.org_first_start
  AND ((uo.end_year IS NULL AND o.{year} >= uo.start_year)
       OR (uo.end_year IS NOT NULL AND uo.start_year IS NOT NULL
           AND o.{year} >= uo.start_year AND o.{year} <= uo.end_year))
"""

query("J15_employment_specimens_recorded",
      _EMP_SQL.format(year="eventDate_processed_year", kind="recorded"))(
    lambda m: J.employment_specimens(m.organizations, m.user_organizations, m.claims, m.occurrences, "recorded"))
query("J15_employment_specimens_identified",
      _EMP_SQL.format(year="dateIdentified_processed_year", kind="identified"))(
    lambda m: J.employment_specimens(m.organizations, m.user_organizations, m.claims, m.occurrences,
                                     "identified"))


@query("J16_employment_specimens_in_year", """
SELECT uo.organization_id, uo.user_id, o.gbifID AS occurrence_id, o.institutionCode
FROM user_organizations uo
JOIN claims c ON c.user_id = uo.user_id
JOIN occurrences o ON o.gbifID = c.occurrence_id
JOIN organizations g ON g.id = uo.organization_id
WHERE c.action LIKE '%recorded%' AND o.institutionCode IS NOT NULL
  AND o.eventDate_processed_year = 1997
  AND NOT list_contains(g.institution_codes, o.institutionCode)
  AND ((uo.end_year IS NULL AND uo.start_year <= 1997) OR (uo.start_year <= 1997 AND uo.end_year >= 1997))
""")
def j16(m):
    return J.employment_specimens_in_year(m.organizations, m.user_organizations, m.claims, m.occurrences, 1997)


@query("J17_org_articles", """
SELECT DISTINCT uo.organization_id, ao.article_id, uo.user_id
FROM user_organizations uo
JOIN claims c ON c.user_id = uo.user_id
JOIN occurrences o ON o.gbifID = c.occurrence_id
JOIN article_occurrences ao ON ao.occurrence_id = o.gbifID
WHERE c.visible AND (
  (uo.end_year IS NULL AND o.eventDate_processed_year > 1900 AND uo.start_year > 1900
   AND (o.eventDate_processed_year >= uo.start_year OR o.dateIdentified_processed_year >= uo.start_year))
  OR (uo.end_year IS NOT NULL AND uo.start_year IS NOT NULL
   AND ((o.eventDate_processed_year >= uo.start_year AND o.eventDate_processed_year <= uo.end_year)
     OR (o.dateIdentified_processed_year >= uo.start_year AND o.dateIdentified_processed_year <= uo.end_year))))
""")
def j17(m):
    return J.org_articles(m.user_organizations, m.claims, m.occurrences, m.article_occurrences)


_LIFE_SQL = """
SELECT c.user_id, c.occurrence_id, c.created_by, c.created, o.{field} AS d
FROM claims c JOIN users u ON u.id = c.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.created_by <> c.user_id AND c.action IN {roles} AND {cond}
"""
query("J18_claims_before_birth_recorded", _LIFE_SQL.format(
    field="eventDate_processed", roles=REC, cond="o.eventDate_processed <= u.date_born"))(
    lambda m: J.claims_outside_life(m.users, m.claims, m.occurrences, "recorded", "before_birth"))
query("J18_claims_after_death_identified", _LIFE_SQL.format(
    field="dateIdentified_processed", roles=IDN,
    cond="o.dateIdentified_processed >= u.date_died AND o.dateIdentified_processed <= DATE '2002-01-01'"))(
    lambda m: J.claims_outside_life(m.users, m.claims, m.occurrences, "identified", "after_death",
                                    as_of="2002-01-01"))


@query("J19_lifespan_violations", f"""
SELECT o.datasetKey, c.user_id, c.occurrence_id
FROM claims c JOIN users u ON u.id = c.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.action IN {REC} AND (u.date_born >= o.eventDate_processed OR u.date_died <= o.eventDate_processed)
""")
def j19(m):
    return J.lifespan_violations(m.users, m.claims, m.occurrences)


_RESOLVE = """CASE WHEN {d} IS NULL THEN NULL
  WHEN {p} = 'century' THEN make_date(CAST(year({d}) - 100 AS INTEGER), 1, 1)
  WHEN {p} = 'year' THEN make_date(CAST(year({d}) AS INTEGER), 12, 31)
  WHEN {p} = 'month' THEN make_date(CAST(year({d}) AS INTEGER), CAST(month({d}) AS INTEGER), 28)
  ELSE {d} END"""


@query("J20_date_warnings", f"""
WITH u AS (
  SELECT id AS user_id, {_RESOLVE.format(d='date_born', p='date_born_precision')} AS born,
         {_RESOLVE.format(d='date_died', p='date_died_precision')} AS died
  FROM users WHERE date_born IS NOT NULL),
j AS (
  SELECT c.user_id, c.occurrence_id,
    coalesce(c.action IN {REC} AND o.recordedBy IS NOT NULL AND (o.eventDate_processed <= u.born OR o.eventDate_processed >= u.died), FALSE) AS collected_warning,
    coalesce(c.action IN {IDN} AND o.identifiedBy IS NOT NULL AND (o.dateIdentified_processed <= u.born OR o.dateIdentified_processed >= u.died), FALSE) AS identified_warning
  FROM claims c JOIN u ON u.user_id = c.user_id JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.visible)
SELECT * FROM j WHERE collected_warning OR identified_warning
""")
def j20(m):
    return J.date_warnings(m.users, m.claims, m.occurrences)


@query("J23_cited_specimens", """
SELECT c.user_id, c.occurrence_id, ao.article_id
FROM claims c JOIN article_occurrences ao ON ao.occurrence_id = c.occurrence_id WHERE c.visible
""")
def j23(m):
    return J.cited_specimens(m.claims, m.article_occurrences)


@query("J24_articles_citing", """
SELECT DISTINCT c.user_id, a.id, a.doi
FROM claims c JOIN article_occurrences ao ON ao.occurrence_id = c.occurrence_id
JOIN articles a ON a.id = ao.article_id WHERE c.visible
""")
def j24(m):
    return J.articles_citing(m.articles, m.claims, m.article_occurrences).select("user_id", "id", "doi")


@query("J27_collector_network", f"""
WITH rec AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN {REC}),
edges AS (SELECT DISTINCT a.user_id AS collector, b.user_id AS other
          FROM rec a JOIN rec b ON a.occurrence_id = b.occurrence_id WHERE a.user_id <> b.user_id),
hop AS (SELECT DISTINCT r.occurrence_id, e.other AS user_id FROM rec r JOIN edges e ON e.collector = r.user_id)
SELECT h.occurrence_id, h.user_id FROM hop h
WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.occurrence_id = h.occurrence_id AND r.user_id = h.user_id)
""")
def j27(m):
    return J.collector_network(m.claims)


@query("J28_dataset_flags", """
SELECT d.datasetKey,
  EXISTS (SELECT 1 FROM occurrences o JOIN claims c ON c.occurrence_id = o.gbifID
          WHERE o.datasetKey = d.datasetKey AND c.visible) AS has_claim,
  EXISTS (SELECT 1 FROM occurrences o JOIN occurrence_agents oa ON oa.occurrence_id = o.gbifID
          WHERE o.datasetKey = d.datasetKey) AS has_agent
FROM datasets d
""")
def j28(m):
    return J.dataset_flags(m.datasets, m.occurrences, m.claims, m.occurrence_agents)


@query("J29_shared_claims", """
SELECT c.user_id, c.occurrence_id FROM claims c
WHERE EXISTS (SELECT 1 FROM claims o WHERE o.occurrence_id = c.occurrence_id AND o.visible AND o.user_id <> c.user_id)
""")
def j29(m):
    return J.shared_claims(m.claims).select("user_id", "occurrence_id")


@query("J30_helped", """
SELECT DISTINCT created_by AS claimant_id, user_id FROM claims WHERE visible AND created_by <> user_id
""")
def j30(m):
    return J.helped(m.claims)


@query("J31_same_organization_people", """
SELECT DISTINCT a.user_id, b.user_id AS other_id FROM user_organizations a
JOIN user_organizations b ON a.organization_id = b.organization_id WHERE a.user_id <> b.user_id
""")
def j31(m):
    return J.same_organization_people(m.user_organizations)


for _kind, _sql in {
    "active": "uo.end_year IS NULL AND u.wikidata IS NULL",
    "public": "uo.end_year IS NULL AND u.is_public",
    "inactive": "uo.end_year IS NOT NULL OR u.wikidata IS NOT NULL",
}.items():
    query(f"J32_members_{_kind}", f"""
SELECT DISTINCT uo.organization_id, uo.user_id FROM user_organizations uo JOIN users u ON u.id = uo.user_id
WHERE {_sql}""")(lambda m, k=_kind: J.members(m.user_organizations, m.users, k))
