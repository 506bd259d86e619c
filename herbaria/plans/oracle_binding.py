"""The model binding written as DuckDB SQL (an independent second copy).

``BINDING_SQL`` is a list of common table expressions over the driver's raw
views; ``with_binding(body)`` prefixes a query with them. The Spark side of
the same rules is ``herbaria.sources.testdata``.
"""

from __future__ import annotations

# Fixed values of the binding, same order as herbaria.sources.testdata.
_FAMILY = ("['Smith','Jones','Brown','Taylor','Wilson','Davies','Evans','Thomas','Johnson',"
           "'Roberts','Müller','Schäfer','García','Núñez','Dubois','Lefèvre','Rossi','Bianchi',"
           "'Andersson','Kowalski']")
_GIVEN = ("['John','Mary','Anna','Peter','Carl','Emma','Louis','Olga','Henri','Sofia','Jakob',"
          "'Ingrid','Pablo','Marta','Ivan']")
_PREC = "['day','month','year','century']"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _code(k: str) -> str:
    return f"(substring({_AZ}, CAST(({k}) % 26 + 1 AS INTEGER), 1) || substring({_AZ}, CAST((({k}) * 7) % 26 + 1 AS INTEGER), 1))"


def _orcid(k: str) -> str:
    n = f"(CASE WHEN ({k}) < 20000000 THEN ({k}) + 15000000 ELSE 900000000000 + (({k}) - 20000000) % 200000000 END)"
    d = f"lpad(CAST({n} AS VARCHAR), 15, '0')"
    # ISO 7064 mod 11-2: fold the digits from the left
    rest = (f"(12 - list_reduce(list_transform(range(1, 16), lambda i: CAST(substring({d}, CAST(i AS INTEGER), 1) AS BIGINT)), "
            f"lambda t, x: (t * 2 + x) % 11) * 2 % 11) % 11")
    return (f"(substring({d}, 1, 4) || '-' || substring({d}, 5, 4) || '-' || substring({d}, 9, 4) || '-' || substring({d}, 13, 3) || "
            f"CASE WHEN {rest} = 10 THEN 'X' ELSE CAST({rest} AS VARCHAR) END)")


_LINKED = "CASE WHEN l_partkey % 10 = 5 THEN -(l_partkey + 1) ELSE l_partkey + 1 END"


def _day(start: str, n: str) -> str:
    return f"CAST(DATE '{start}' + CAST({n} AS INTEGER) AS DATE)"


_EVENT = _day("1995-01-01", "p_partkey * 13 % 2400")
_IDENT = f"CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST({_EVENT} + CAST(p_partkey * 7 % 900 AS INTEGER) AS DATE) END"

_OCC = f"""
occ_base AS (
  SELECT p.*, n.n_name, CAST(p_partkey % 25 AS INTEGER) AS nk,
         {_EVENT} AS ev, {_IDENT} AS idt
  FROM part p LEFT JOIN nation n ON CAST(p.p_partkey % 25 AS INTEGER) = n.n_nationkey
),
occurrences AS (
  SELECT p_partkey + 1 AS gbifID,
         p_brand AS datasetKey,
         CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE (['CC0_1_0','CC_BY_4_0','CC_BY_NC_4_0'])[p_partkey % 4 + 1] END AS license,
         'occ-' || CAST(p_partkey AS VARCHAR) AS occurrenceID,
         CASE WHEN p_partkey % 9 = 0 THEN 'HUMAN_OBSERVATION' ELSE 'PRESERVED_SPECIMEN' END AS basisOfRecord,
         CAST(idt AS VARCHAR) AS dateIdentified,
         CAST((p_partkey % 181) - 90 AS VARCHAR) AS decimalLatitude,
         CAST((p_partkey % 361) - 180 AS VARCHAR) AS decimalLongitude,
         n_name AS country,
         CASE WHEN nk = 24 THEN NULL WHEN nk = 23 THEN 'ZZ' ELSE {_code('nk')} END AS countryCode,
         CAST(ev AS VARCHAR) AS eventDate,
         CAST(year(ev) AS VARCHAR) AS "year",
         (['Plantae','Animalia','Fungi'])[p_size % 3 + 1] AS kingdom,
         p_type AS family,
         'Det. ' || p_name AS identifiedBy,
         CAST(p_size AS VARCHAR) AS institutionCode,
         split_part(p_name, ' ', 1) AS collectionCode,
         'C' || CAST(p_partkey AS VARCHAR) AS catalogNumber,
         p_name AS recordedBy,
         concat_ws(' ', p_type, split_part(p_name, ' ', 2)) AS scientificName,
         CASE WHEN p_partkey % 20 = 0 THEN 'Holotype' WHEN p_partkey % 20 = 1 THEN 'isotype' END AS typeStatus,
         idt AS dateIdentified_processed,
         ev AS eventDate_processed,
         CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS hasImage,
         CASE WHEN p_partkey % 5 = 0 THEN 'http://www.wikidata.org/entity/Q' || CAST(p_partkey * 3 // 4 + 1000 AS VARCHAR) END AS recordedByID,
         CASE WHEN p_partkey % 7 = 0 THEN 'https://orcid.org/' || {_orcid('p_partkey * 3 // 4')} END AS identifiedByID,
         CAST(year(ev) AS INTEGER) AS eventDate_processed_year,
         CAST(month(ev) AS INTEGER) AS eventDate_processed_month,
         CAST(day(ev) AS INTEGER) AS eventDate_processed_day,
         CAST(year(idt) AS INTEGER) AS dateIdentified_processed_year,
         CAST(month(idt) AS INTEGER) AS dateIdentified_processed_month,
         CAST(day(idt) AS INTEGER) AS dateIdentified_processed_day
  FROM occ_base
)"""

_RAW = """
raw_download AS (
  SELECT l_partkey + 1 AS gbifID, p_brand AS datasetKey,
         CASE WHEN l_linenumber = 7 THEN 'HUMAN_OBSERVATION' WHEN l_linenumber = 6 THEN 'FOSSIL_SPECIMEN'
              ELSE 'PRESERVED_SPECIMEN' END AS basisOfRecord,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'ABSENT' ELSE 'PRESENT' END AS occurrenceStatus,
         'occ-' || CAST(l_partkey AS VARCHAR) AS v_occurrenceID,
         CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 9 = 1 THEN 'BOLD:' || p_type
              ELSE concat_ws(' ', p_type, split_part(p_name, ' ', 2)) END AS v_scientificName,
         p_type AS scientificName,
         CASE WHEN l_linenumber = 5 THEN '2099-01-01 00:00:00'
              WHEN l_linenumber = 4 AND l_quantity > 40 THEN 'n/a'
              ELSE CAST(l_shipdate AS VARCHAR) END AS eventDate,
         CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_shipdate AS VARCHAR) END AS dateIdentified,
         CAST(l_shipdate AS VARCHAR) AS v_eventDate,
         upper(p_name) AS recordedBy,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE p_name END AS v_recordedBy,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE 'Det. ' || p_name END AS v_identifiedBy,
         CASE WHEN l_suppkey % 5 = 0 THEN 'http://www.wikidata.org/entity/Q' || CAST(l_suppkey + 1000 AS VARCHAR) END AS v_recordedByID,
         CAST(p_size AS VARCHAR) AS v_institutionCode,
         'C' || CAST(l_partkey AS VARCHAR) AS v_catalogNumber,
         CASE WHEN l_partkey % 20 = 0 THEN 'HoloType' END AS v_typeStatus,
         l_discount > 0.05 AS hasImage,
         l_orderkey AS source_row,
         l_linenumber AS source_line
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

_BORN = f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_day('1990-01-01', 'c_custkey * 41 % 3000')} END"
_DIED = f"CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {_day('1990-01-01', 'c_custkey * 41 % 3000 + c_custkey * 37 % 4000')} END"
_CREATED = f"CAST({_day('1995-06-01', 'c_custkey * 17 % 2000')} AS TIMESTAMP)"

_USERS = f"""
users_base AS (
  SELECT c.*, {_FAMILY}[c_custkey % 20 + 1] AS fam, {_GIVEN}[(c_custkey // 20) % 15 + 1] AS giv,
         {_BORN} AS born, {_DIED} AS died, {_CREATED} AS cr
  FROM customer c
),
users AS (
  SELECT c_custkey + 1 AS id,
         fam AS family,
         giv AS given,
         CASE WHEN c_custkey % 17 = 0 THEN 'van' END AS particle,
         CASE WHEN c_custkey % 2 = 0 THEN {_orcid('c_custkey')} END AS orcid,
         CASE WHEN c_custkey % 2 = 1 THEN 'Q' || CAST(c_custkey + 1000 AS VARCHAR) END AS wikidata,
         CASE WHEN c_custkey % 3 = 0 THEN giv || ' ' || fam || '|' || substring(giv, 1, 1) || '. ' || fam END AS other_names,
         CASE WHEN c_custkey % 7 = 0 THEN {_code('c_nationkey')} || '|' || {_code('c_nationkey + 1')} ELSE {_code('c_nationkey')} END AS country_code,
         c_mktsegment AS keywords,
         CASE WHEN c_custkey % 13 = 0 THEN 'Dr. ' || giv || ' ' || fam END AS label,
         born AS date_born,
         CASE WHEN born IS NULL THEN NULL ELSE {_PREC}[c_custkey % 4 + 1] END AS date_born_precision,
         died AS date_died,
         CASE WHEN died IS NULL THEN NULL ELSE {_PREC}[(c_custkey + 1) % 4 + 1] END AS date_died_precision,
         c_custkey % 2 = 0 AS is_public,
         cr AS created,
         CASE WHEN c_custkey % 2 = 0 THEN cr + INTERVAL 30 DAY END AS made_public,
         CASE WHEN c_custkey % 4 = 0 THEN 'img/' || CAST(c_custkey AS VARCHAR) || '.jpg' END AS image_url,
         CASE WHEN c_custkey % 8 = 0 THEN 'sig/' || CAST(c_custkey AS VARCHAR) || '.png' END AS signature_url,
         CASE WHEN c_custkey % 9 = 0 THEN '10.5281/zenodo.' || CAST(c_custkey AS VARCHAR) END AS zenodo_doi,
         CASE WHEN c_custkey % 5 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
         c_custkey % 10 < 6 AS wants_mail,
         CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE CAST({_day('2001-12-15', 'c_custkey % 20')} AS TIMESTAMP) END AS mail_last_sent,
         c_custkey % 3 = 0 AS visited
  FROM users_base
)"""

_CLAIMS = f"""
claims_g AS (
  SELECT o_custkey, l_partkey, min(l_returnflag) AS rf, max(l_linestatus) AS ls,
         min(l_shipdate) AS created, max(l_shipdate) AS updated,
         min(l_linenumber) AS ln_min, max(l_linenumber) AS ln_max, min(l_suppkey) AS sk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey
),
claims AS (
  SELECT o_custkey + 1 AS user_id,
         {_LINKED} AS occurrence_id,
         CASE WHEN ls <> 'O' AND ln_min % 2 = 0 THEN NULL
              WHEN rf = 'R' THEN 'recorded'
              WHEN rf = 'A' THEN 'identified'
              WHEN ln_max = 7 THEN 'identified,recorded'
              ELSE 'recorded,identified' END AS action,
         ls = 'O' AS visible,
         created, updated,
         CASE WHEN ln_min <= 3 THEN o_custkey + 1 ELSE sk + 1 END AS created_by
  FROM claims_g
)"""

_AGENTS = f"""
agents AS (
  SELECT s_suppkey + 1 AS id,
         CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE {_FAMILY}[s_suppkey % 20 + 1] END AS family,
         CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE {_GIVEN}[(s_suppkey // 20) % 15 + 1] || ' ' ||
              substring({_AZ}, CAST((s_suppkey // 300) % 26 + 1 AS INTEGER), 1) || '.' END AS given,
         CAST(NULL AS VARCHAR) AS particle, CAST(NULL AS VARCHAR) AS appellation,
         CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS suffix,
         CAST(NULL AS VARCHAR) AS nick, CAST(NULL AS VARCHAR) AS dropping_particle,
         CASE WHEN s_suppkey % 10 = 0 THEN s_name ELSE '' END AS unparsed
  FROM supplier
),
occurrence_agents AS (
  SELECT DISTINCT l_partkey + 1 AS occurrence_id, l_suppkey + 1 AS agent_id, l_returnflag <> 'A' AS agent_role
  FROM lineitem
)"""

_JOBS = """
agent_jobs AS (
  SELECT l_orderkey || '-' || l_suppkey AS id, l_orderkey, l_suppkey, a.family, a.given, l_suppkey % 13 <> 0 AS is_json,
         CASE WHEN a.family = '' THEN a.unparsed ELSE a.given || ' ' || a.family END AS agents
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN agents a ON a.id = l_suppkey + 1
)"""

_OTHER = f"""
taxon_occurrences AS (SELECT gbifID AS occurrence_id, family FROM occurrences),
datasets AS (
  SELECT DISTINCT p_brand AS datasetKey, 'Dataset ' || p_brand AS title,
         'http://creativecommons.org/' || CASE right(p_brand, 1) WHEN '1' THEN 'publicdomain/zero/1.0/' WHEN '2' THEN 'licenses/by-nc/4.0/'
           ELSE 'licenses/by/4.0/' END || 'legalcode' AS license,
         'occurrence' AS dataset_type FROM part
),
articles AS (
  SELECT o_orderkey + 1 AS id,
         '10.5555/art.' || CAST(o_orderkey AS VARCHAR) AS doi,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Article number ' || CAST(o_orderkey AS VARCHAR) END AS citation,
         o_orderstatus <> 'P' AS processed,
         o_orderstatus = 'O' AS mail_sent,
         o_orderdate AS created,
         ['10.15468/dl.' || CAST(o_orderkey AS VARCHAR)] AS gbif_dois,
         ['0000' || CAST(o_orderkey AS VARCHAR)] AS gbif_downloadkeys
  FROM orders
),
article_occurrences AS (
  SELECT DISTINCT l_orderkey + 1 AS article_id, {_LINKED} AS occurrence_id FROM lineitem
),
organizations AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id,
         n_name || ' Museum' AS name,
         'Q' || CAST(n_nationkey + 5000 AS VARCHAR) AS wikidata,
         CASE WHEN n_nationkey % 2 = 0 THEN 'ror' || CAST(n_nationkey AS VARCHAR) END AS ror,
         CASE WHEN n_nationkey % 3 = 0 THEN 'grid.' || CAST(n_nationkey AS VARCHAR) END AS grid,
         CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey * 100 AS VARCHAR) END AS ringgold,
         CASE WHEN n_nationkey % 7 = 0 THEN '0000 0001 ' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || ' 0000' END AS isni,
         [CAST(n_nationkey + 1 AS VARCHAR), CAST(n_nationkey + 26 AS VARCHAR)] AS institution_codes
  FROM nation
),
organization_records AS (
  SELECT s_suppkey + 1 AS id, s_name AS name,
         CASE WHEN s_suppkey % 4 = 0 THEN 'Q7' || s_suppkey // 8 END AS wikidata, CASE WHEN s_suppkey % 3 = 0 THEN 'ror' || s_suppkey // 6 END AS ror,
         CASE WHEN s_suppkey % 5 = 0 THEN 'grid.' || s_suppkey // 10 END AS grid, CASE WHEN s_suppkey % 7 = 0 THEN '' || s_suppkey // 14 END AS ringgold,
         CASE WHEN s_suppkey % 11 = 0 THEN 'isni' || s_suppkey // 11 END AS isni, [CAST(s_suppkey * 2 // 3 AS VARCHAR)] AS institution_codes
  FROM supplier
),
record_members AS (SELECT c_custkey + 1 AS user_id, c_custkey // 15 + 1 AS organization_id FROM customer),
user_organizations AS (
  SELECT c_custkey + 1 AS user_id,
         CAST(c_nationkey + 1 AS BIGINT) AS organization_id,
         CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1995 AS INTEGER) END AS start_year,
         CAST(c_custkey % 12 + 1 AS INTEGER) AS start_month,
         CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE CAST(c_custkey % 28 + 1 AS INTEGER) END AS start_day,
         CASE WHEN c_custkey % 2 = 0 OR c_custkey % 19 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1997 AS INTEGER) END AS end_year,
         CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_custkey % 12 + 1 AS INTEGER) END AS end_month,
         CAST(NULL AS INTEGER) AS end_day
  FROM customer
),
countries AS (SELECT {_code('n_nationkey')} AS code, n_name AS name FROM nation),
downloads AS (SELECT '0000' || CAST(l_orderkey AS VARCHAR) AS key, count(*) AS total_records
              FROM lineitem GROUP BY l_orderkey),
destroyed_users AS (
  SELECT CAST(c_custkey + 1 AS VARCHAR) AS identifier,
         CASE WHEN c_custkey % 70 = 0 THEN NULL ELSE CAST(c_custkey + 11 AS VARCHAR) END AS redirect_to,
         CASE WHEN c_custkey % 70 = 0 THEN 'banned' ELSE 'merged' END AS reason
  FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 50 <> 40
)"""

BINDING_SQL = ",".join([_OCC, _RAW, _USERS, _CLAIMS, _AGENTS, _JOBS, _OTHER])


def with_binding(body: str) -> str:
    """Prefix ``body`` (a SELECT, or further CTEs starting with a comma) with the binding."""
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + BINDING_SQL + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        body = ", " + body[5:]
    if body.startswith(","):
        return "WITH " + BINDING_SQL + body
    return "WITH " + BINDING_SQL + "\n" + body
