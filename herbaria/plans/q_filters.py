"""Registered filter queries (F-series) with their oracle SQL.

Parameters are fixed per query; every query reads whole tables. Operators that
take one key (a month/day, a person) are run for every key at once where the
reference runs them per request.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.operators import filters as FL
from herbaria.plans.registry import query
from herbaria.sources.testdata import AS_OF

CLAIM_COLS = ["user_id", "occurrence_id", "action", "visible", "created_by"]
_CLAIM_SQL_COLS = "user_id, occurrence_id, action, visible, created_by"


@query("F2_visible_claims", f"SELECT {_CLAIM_SQL_COLS} FROM claims WHERE visible")
def f2_visible(m):
    return FL.visible(m.claims).select(*CLAIM_COLS)


@query("F2_hidden_claims", f"SELECT {_CLAIM_SQL_COLS} FROM claims WHERE NOT visible")
def f2_hidden(m):
    return FL.hidden(m.claims).select(*CLAIM_COLS)


@query("F2_hidden_by_others", f"SELECT {_CLAIM_SQL_COLS} FROM claims WHERE NOT visible AND created_by <> user_id")
def f2_hidden_others(m):
    return FL.hidden_by_others(m.claims).select(*CLAIM_COLS)


_ROLE_SQL = {
    "recorded": "action IN ('recorded','recorded,identified','identified,recorded')",
    "identified": "action IN ('identified','recorded,identified','identified,recorded')",
    "both": "action IN ('recorded,identified','identified,recorded')",
    "any": "action IS NOT NULL",
}

for _kind, _cond in _ROLE_SQL.items():
    query(f"F3_claims_{_kind}",
          f"SELECT user_id, occurrence_id, action FROM claims WHERE visible AND {_cond}")(
        lambda m, k=_kind: FL.with_role(m.claims, k).select("user_id", "occurrence_id", "action"))


@query("F4_specimen_filters_collected", """
SELECT c.user_id, c.occurrence_id, o.family, o.eventDate_processed_year
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN ('recorded','recorded,identified','identified,recorded')
  AND o.eventDate_processed_year >= 1996 AND o.eventDate_processed_year <= 2000 AND o.kingdom = 'Plantae'
""")
def f4(m):
    return (FL.specimen_filters(m.claims, m.occurrences, action="collected", start_year=1996, end_year=2000,
                                kingdom="Plantae")
            .select("user_id", "occurrence_id", "family", "eventDate_processed_year"))


@query("F4_specimen_filters_identified", """
SELECT c.user_id, c.occurrence_id, o.institutionCode, o.dateIdentified_processed_year
FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
WHERE c.visible AND c.action IN ('identified','recorded,identified','identified,recorded')
  AND o.dateIdentified_processed_year >= 1998 AND o.family = 'PROMO' AND c.created_by <> 1
""")
def f4b(m):
    df = FL.specimen_filters(m.claims, m.occurrences, action="identified", start_year=1998, family="PROMO")
    return (df.filter(F.col("created_by") != 1)
            .select("user_id", "occurrence_id", "institutionCode", "dateIdentified_processed_year"))


@query("F5_candidate_filters", """
SELECT o.gbifID, o.datasetKey, o.family FROM occurrences o
WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID)
  AND o.family = 'SMALL' AND o.kingdom = 'Animalia'
""")
def f5(m):
    cand = m.occurrences.join(m.claims.select(F.col("occurrence_id").alias("gbifID")), "gbifID", "left_anti")
    return FL.candidate_filters(cand, family="SMALL", kingdom="Animalia").select("gbifID", "datasetKey", "family")


@query("F6_where_conditions", """
SELECT gbifID, recordedBy, family FROM occurrences WHERE family = 'PROMO' AND recordedBy LIKE 'small%'
""")
def f6(m):
    return (FL.where_conditions(m.occurrences, '{"family": "PROMO", "recordedBy LIKE ?": "small%"}')
            .select("gbifID", "recordedBy", "family"))


@query("F7_valid_family", """
SELECT family, count(*) AS n FROM (
  SELECT trim(CASE WHEN p_partkey % 13 = 0 THEN ' ' || p_type WHEN p_partkey % 17 = 0 THEN p_type || '2' ELSE p_type END) AS family
  FROM part) t
WHERE regexp_full_match(family, '[a-zA-Z]+')
GROUP BY family
""")
def f7(m):
    k = F.col("p_partkey")
    fam = (F.when(k % 13 == 0, F.concat(F.lit(" "), F.col("p_type")))
           .when(k % 17 == 0, F.concat(F.col("p_type"), F.lit("2"))).otherwise(F.col("p_type")))
    raw = m.raw("part").select(fam.alias("family"))
    return FL.valid_family(raw).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("F8_valid_kingdom", """
SELECT kingdom, count(*) AS n FROM occurrences
WHERE kingdom IN ('Animalia','Archaea','Bacteria','Chromista','Fungi','Plantae','Protozoa','incertae sedis')
GROUP BY kingdom
""")
def f8(m):
    return m.occurrences.filter(FL.valid_kingdom()).groupBy("kingdom").agg(F.count(F.lit(1)).alias("n"))


@query("F9_born_on_every_day", """
SELECT id, CAST(month(date_born) AS INTEGER) AS month, CAST(day(date_born) AS INTEGER) AS day
FROM users WHERE date_born_precision = 'day'
""")
def f9(m):
    return FL.born_on(m.users).select("id", F.month("date_born").alias("month"), F.dayofmonth("date_born").alias("day"))


@query("F9_born_on_day", """
SELECT id FROM users WHERE date_born_precision = 'day' AND month(date_born) = 3 AND day(date_born) = 15
""")
def f9b(m):
    return FL.born_on(m.users, 3, 15).select("id")


@query("F9_died_on_day", """
SELECT id FROM users WHERE date_died_precision = 'day' AND month(date_died) = 6 AND day(date_died) = 1
""")
def f9c(m):
    return FL.born_on(m.users, 6, 1, kind="died").select("id")


@query("F10_collected_on_every_day", """
SELECT o.gbifID, o.eventDate_processed_month AS month, o.eventDate_processed_day AS day
FROM occurrences o
WHERE lower(o.typeStatus) = 'holotype' AND o.hasImage = 1 AND o.eventDate_processed_year > 1800
  AND EXISTS (SELECT 1 FROM claims c WHERE c.occurrence_id = o.gbifID AND c.visible
              AND c.action IN ('recorded','recorded,identified','identified,recorded'))
""")
def f10(m):
    return FL.collected_on(m.occurrences, m.claims).select(
        "gbifID", F.col("eventDate_processed_month").alias("month"), F.col("eventDate_processed_day").alias("day"))


_ROSTER_SQL = {
    "public": "is_public",
    "gallery": "is_public AND image_url IS NOT NULL",
    "signatures": "is_public AND signature_url IS NOT NULL",
    "help": "id NOT IN (1, 2) AND family IS NOT NULL AND label IS NOT NULL",
}
for _kind, _cond in _ROSTER_SQL.items():
    query(f"F11_roster_{_kind}", f"SELECT id, family, given FROM users WHERE {_cond}")(
        lambda m, k=_kind: FL.public_roster(m.users, k).select("id", "family", "given"))


@query("F12_users_in_country", "SELECT id, country_code FROM users WHERE country_code LIKE '%AA%'")
def f12(m):
    return FL.users_in_country(m.users, "AA").select("id", "country_code")


@query("F12_users_in_country_exact",
       "SELECT id, country_code FROM users WHERE list_contains(string_split(country_code, '|'), 'BH')")
def f12b(m):
    return FL.users_in_country(m.users, "BH", exact=True).select("id", "country_code")


@query("F14_citable_articles", "SELECT id, doi, created FROM articles WHERE processed AND citation IS NOT NULL")
def f14(m):
    return FL.citable_articles(m.articles).select("id", "doi", "created")


@query("F15_changed_since", """
SELECT user_id FROM claims WHERE created >= TIMESTAMP '2001-06-01'
UNION SELECT created_by FROM claims WHERE created >= TIMESTAMP '2001-06-01'
""")
def f15(m):
    return FL.changed_since(m.claims, dt.datetime(2001, 6, 1))


@query("F16_exact_lookup", "SELECT gbifID, datasetKey, occurrenceID FROM occurrences "
                           "WHERE datasetKey = 'Brand#2' AND occurrenceID = 'occ-0'")
def f16(m):
    return FL.exact_lookup(m.occurrences, "Brand#2", "occ-0").select("gbifID", "datasetKey", "occurrenceID")


@query("F17_notify_due", """
SELECT id, email FROM users WHERE wants_mail AND email IS NOT NULL
  AND (mail_last_sent IS NULL OR mail_last_sent < TIMESTAMP '2002-01-01' - INTERVAL 6 DAY)
""")
def f17(m):
    return FL.notify_due(m.users, dt.datetime(2002, 1, 1)).select("id", "email")


@query("F18_current_membership", """
SELECT user_id, organization_id, start_year FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_year, organization_id) AS rn
  FROM user_organizations WHERE start_year IS NOT NULL AND (end_year IS NULL OR end_year > 2002)) t
WHERE rn = 1
""")
def f18(m):
    return FL.current_membership(m.user_organizations, AS_OF).select("user_id", "organization_id", "start_year")


@query("F19_wikidata_to_publish", """
SELECT id FROM users u WHERE wikidata IS NOT NULL AND NOT is_public
  AND EXISTS (SELECT 1 FROM claims c WHERE c.user_id = u.id AND c.created >= TIMESTAMP '2001-01-01')
""")
def f19(m):
    return FL.wikidata_to_publish(m.users, m.claims, dt.datetime(2001, 1, 1)).select("id")


@query("F20_claims_received", "SELECT user_id, occurrence_id, created_by, created FROM claims "
                              "WHERE visible AND created_by <> user_id")
def f20(m):
    return FL.claims_received(m.claims).select("user_id", "occurrence_id", "created_by", "created")


@query("F20_claims_received_by_bot", "SELECT user_id, occurrence_id FROM claims "
                                     "WHERE visible AND created_by <> user_id AND created_by = 2")
def f20b(m):
    return FL.claims_received(m.claims).filter(F.col("created_by") == P.SOURCE_AGENT_ID).select(
        "user_id", "occurrence_id")


@query("F21_deposits_due", """
WITH latest AS (
  SELECT user_id, max(created) AS latest_created, arg_max(created_by, (created, created_by)) AS latest_by
  FROM claims WHERE visible GROUP BY user_id)
SELECT u.id AS user_id, l.latest_created, l.latest_by
FROM users u JOIN latest l ON l.user_id = u.id
WHERE u.zenodo_doi IS NOT NULL
  AND EXISTS (SELECT 1 FROM claims c WHERE c.user_id = u.id AND c.created >= TIMESTAMP '2001-06-01')
  AND l.latest_by NOT IN (1, 2)
""")
def f21(m):
    return FL.deposits_due(m.users, m.claims, dt.datetime(2001, 6, 1)).select(
        "user_id", "latest_created", "latest_by")
