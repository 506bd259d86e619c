"""Registered queries of readers, writers, key joins and text functions (S, K, J, X, N, P series).

Files are written from the given tables into the shared folder and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herbaria.functions import scalars as S
from herbaria.operators import joins as J
from herbaria.operators import mutate as M
from herbaria.operators import sets as X
from herbaria.operators import windows as N
from herbaria.plans.registry import query
from herbaria.session import checkpoint_dir
from herbaria.sources import readers as R
from herbaria.sources import writers as WR


def _folder(m, name: str) -> str:
    return f"{checkpoint_dir(m.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- S2, S3, S8-S11, K1, K4 --------------------------------------------------------------

def _id_lists(m):
    """Families with the ids of their occurrences, a list per thousand ids."""
    return (m.occurrences.groupBy("family", F.floor(F.col("gbifID") / 1000).alias("chunk"))
            .agg(F.collect_list("gbifID").alias("gbifIDs_family")))


@query("K4_id_list_csv", "SELECT family, gbifID // 1000 AS chunk, gbifID FROM occurrences")
def k4(m):
    """Id lists written as CSV text and read back as lists."""
    path = _folder(m, "id-lists")
    WR.write_id_list_csv(_id_lists(m), path, ["gbifIDs_family"])
    back = R.scan_id_lists(m.spark, path, "csv", ["gbifIDs_family"])
    return back.select("family", F.col("chunk").cast("long").alias("chunk"), F.explode("gbifIDs_family").alias("gbifID"))


@query("S3_scan_family_groups", "SELECT family, gbifID FROM occurrences")
def s3(m):
    """The same lists as Parquet (K1), partitioned by chunk."""
    path = _folder(m, "family-groups")
    WR.write_table(_id_lists(m), path, partition_by=["chunk"])
    return R.scan_id_lists(m.spark, path).select("family", F.explode("gbifIDs_family").alias("gbifID"))


@query("S8_scan_claim_upload", """
WITH up AS (SELECT gbifID, CASE gbifID % 5 WHEN 0 THEN 'recorded' WHEN 1 THEN 'identified,recorded' WHEN 2 THEN 'Recorded' WHEN 3 THEN 'identified' END AS action,
  gbifID % 4 = 2 OR gbifID % 5 = 4 AND gbifID % 3 = 0 AS not_me FROM occurrences)
SELECT CAST(7 AS BIGINT) AS user_id, gbifID AS occurrence_id, CASE WHEN gbifID % 5 = 1 THEN 'recorded,identified' WHEN gbifID % 5 IN (0, 3) THEN action END AS action,
  gbifID % 5 IN (0, 1, 3) AS visible, CAST(9 AS BIGINT) AS created_by
FROM up WHERE gbifID % 5 IN (0, 1, 3) OR not_me
""")
def s8(m):
    """An uploaded file of claims: roles with blanks, a role in capitals (which is none), ticks at "not me"."""
    g = F.col("gbifID")
    action = (F.when(g % 5 == 0, " recorded").when(g % 5 == 1, "identified, recorded").when(g % 5 == 2, "Recorded").when(g % 5 == 3, "identified "))
    rows = m.occurrences.select(g, action.alias("action"), ((g % 4 == 2) | (g % 5 == 4) & (g % 3 == 0)).cast("string").alias("not_me"))
    path = _folder(m, "upload")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.scan_claim_upload(m.spark, path, 7, 9)


@query("S9_scan_claim_pivot", """
SELECT u.id AS user_id, c.occurrence_id, CASE WHEN c.action = 'identified,recorded' THEN 'recorded,identified' ELSE c.action END AS action
FROM claims c JOIN users u ON u.id = c.user_id WHERE c.created_by = 2 AND c.action IS NOT NULL AND c.occurrence_id > 0
""")
def s9(m):
    """The claim pivot (K7) written as CSV and read back to claims; ids of orphans are not positive and drop out."""
    from herbaria.operators import exports as K
    path = _folder(m, "pivot")
    K.claim_pivot(m.claims, m.users).write.options(header=True, quote='"', escape='"').csv(path)
    back = m.spark.read.options(header=True, quote='"', escape='"').csv(path)
    known = m.users.select(S.identifier().alias("identifier"), F.col("id").alias("user_id"))
    return R.claim_pivot_rows(back, known)


@query("S10_scan_source_ids", """
WITH s AS (SELECT gbifID, unnest(list_distinct([recordedByID, identifiedByID])) AS identifier, hasImage FROM occurrences)
SELECT identifier, gbifID AS occurrence_id, 'recorded' AS role FROM s WHERE identifier IS NOT NULL
UNION ALL SELECT identifier, gbifID, 'identified' FROM s WHERE identifier IS NOT NULL AND hasImage = 1
""")
def s10(m):
    """Ids of several agents in one cell, with blanks, repeats and both separators."""
    ids = F.concat_ws("|", F.concat(F.col("recordedByID"), F.lit(" , "), F.col("recordedByID")), F.lit(" "), F.col("identifiedByID"))
    rows = m.occurrences.select(ids.alias("agentIDs"), F.array("gbifID").alias("gbifIDs_recordedByID"),
                                F.when(F.col("hasImage") == 1, F.array("gbifID")).otherwise(F.array().cast("array<bigint>")).alias("gbifIDs_identifiedByID"))
    return R.source_id_rows(rows)


@query("S11_identifier_list", """
SELECT coalesce(orcid, wikidata) AS identifier FROM users WHERE (id - 1) % 6 <> 1
""")
def s11(m):
    """Valid identifiers, of people and broken ones, without the destroyed."""
    k = F.col("id") - 1
    good = m.users.select(F.coalesce("orcid", "wikidata").alias("identifier"))
    bad = m.users.select(F.explode(F.array(F.concat(F.lit("x"), "wikidata"), F.concat("orcid", F.lit("1")), F.concat(F.lit("Q"), "family"))).alias("identifier"))
    gone = m.users.filter(k % 6 == 1).select(F.coalesce("orcid", "wikidata").alias("identifier"))
    return R.identifier_list(good.unionByName(bad.filter("identifier is not null")), gone)


# --- J3, J4, J26, X9, N5, N11, M17 ---------------------------------------------------------------

def _keyed(df):
    return df.select(*[c for c in df.columns if c not in S.AGENT_KEY], *[F.coalesce(c, F.lit("")).alias(c) for c in S.AGENT_KEY])


@query("J3_attach_agent_id", """
WITH names AS (SELECT DISTINCT family, given, unparsed FROM agents UNION SELECT DISTINCT family, given, '' FROM users)
SELECT n.family, n.given, n.unparsed, a.id AS agent_id FROM names n
LEFT JOIN agents a ON a.family = n.family AND a.given = n.given AND a.unparsed = n.unparsed
""")
def j3(m):
    """Names of agents and of people: only the former have an agent id."""
    agents = _keyed(m.agents)
    blank = [F.lit("").alias(c) for c in S.AGENT_KEY if c not in ("family", "given")]
    names = agents.select(*S.AGENT_KEY).unionByName(m.users.select("family", "given", *blank)).distinct()
    return J.attach_agent_id(names, agents).select("family", "given", "unparsed", "agent_id")


@query("J4_attach_taxon_id", """
SELECT o.gbifID, CASE WHEN o.family LIKE 'S%' THEN sha256(o.family) END AS taxon_id FROM occurrences o
""")
def j4(m):
    """Occurrences with the id of their family, which only some families have."""
    taxa = m.occurrences.filter(F.col("family").startswith("S")).select("family").distinct().withColumn("id", F.sha2("family", 256))
    return J.attach_taxon_id(m.occurrences.select("gbifID", "family"), taxa).select("gbifID", "taxon_id")


@query("J26_merge_by_id", """
WITH s AS (SELECT id, CAST(length(family || given) * 1.5 AS DOUBLE) AS score FROM agents WHERE family <> ''),
n AS (SELECT agent_id AS id, count(*) AS n FROM occurrence_agents WHERE agent_role GROUP BY 1)
SELECT n.id, n.n, s.score FROM n LEFT JOIN s USING (id)
""")
def j26(m):
    scores = m.agents.filter("family <> ''").select("id", (F.length(F.concat("family", "given")) * 1.5).alias("score"))
    counts = m.occurrence_agents.filter("agent_role").groupBy(F.col("agent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return J.merge_by_id(scores, counts)


@query("X9_helpers_except", """
SELECT DISTINCT c.created_by AS viewer, o.created_by AS user_id FROM claims c JOIN claims o ON o.user_id = c.user_id
WHERE c.visible AND o.visible AND c.created_by <> c.user_id AND o.created_by <> o.user_id AND o.created_by <> c.created_by
""")
def x9(m):
    """For each helper the other helpers of the people they helped."""
    given = J.helped(m.claims)
    pairs = J.join_in_blocks(given.withColumnRenamed("claimant_id", "viewer").withColumnRenamed("user_id", "person"),
                             given.select(F.col("claimant_id").alias("user_id"), F.col("user_id").alias("person")), "person")
    return X.except_person(pairs.select("viewer", "user_id").distinct(), "viewer")


@query("N5_sort_by_column", "SELECT gbifID, eventDate, typeStatus FROM occurrences")
def n5(m):
    """All rows in the order of a column (a distributed range sort)."""
    return N.sort_by_column(m.occurrences, "eventDate", "desc").select("gbifID", "eventDate", "typeStatus")


@query("N11_best_statement", """
SELECT entity, property, statement_id FROM (
  SELECT l_partkey AS entity, l_returnflag AS property, l_orderkey * 10 + l_linenumber AS statement_id,
    CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END AS score FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY entity, property ORDER BY score DESC, statement_id) = 1
""")
def n11(m):
    li = m.raw("lineitem")
    rank = F.when(F.col("l_linenumber") % 3 == 0, "preferred").when(F.col("l_linenumber") % 3 == 1, "normal").otherwise("deprecated")
    rows = li.select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("property"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("statement_id"), rank.alias("rank"))
    return N.best_statement(rows).select("entity", "property", "statement_id")


@query("M17_add_articles", """
SELECT id, doi, array_to_string(gbif_dois, ' ') AS dois FROM articles
UNION ALL
SELECT min(o_custkey) + 5000000000, '10.7777/new.' || o_custkey, '10.15468/dl.' || o_custkey || ' ' FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey
""")
def m17(m):
    """Found articles: some known by DOI, some without a download, the rest are added once each."""
    o = m.raw("orders")
    k = F.col("o_custkey")
    tags = F.array(F.concat(F.lit("gbifDOI:10.15468/dl."), k), F.concat(F.lit("topic:x"), k), F.lit("gbifDOI:"))
    keys = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("key"), k)))
    new = o.select((k + 5_000_000_000).alias("id"), F.concat(F.lit("10.7777/new."), k).alias("doi"), keys.alias("gbif_downloadkeys"), tags.alias("tags"))
    known = o.select((k + 6_000_000_000).alias("id"), F.concat(F.lit("10.5555/art."), F.col("o_orderkey")).alias("doi"),
                     F.array(F.lit("key")).alias("gbif_downloadkeys"), tags.alias("tags"))
    return M.add_articles(new.unionByName(known), m.articles).select("id", "doi", F.array_join("gbif_dois", " ").alias("dois"))


# --- P23, P29, P31, P33-P36 -------------------------------------------------------------------------

@query("P23_valid_date", """
SELECT source_row, source_line, CASE WHEN year(d) BETWEEN 1756 AND 2002 THEN d END AS valid FROM (
  SELECT source_row, source_line, TRY_CAST(nullif(regexp_extract(eventDate, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS DATE) AS d FROM raw_download)
""")
def p23(m):
    from herbaria.sources.testdata import AS_OF
    return m.raw_download.select("source_row", "source_line", S.valid_date("eventDate", AS_OF).alias("valid"))


@query("P29_strip_markup", """
SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_md5 FROM pages
""")
def p29(m):
    return m.raw("pages").select("page_id", F.md5(S.strip_markup("html")).alias("text_md5"))


@query("P33_is_valid_json", "SELECT id, is_json AS valid FROM agent_jobs")
def p33(m):
    return m.agent_jobs.select("id", S.is_valid_json("parsed").alias("valid"))


@query("P34_primary_contact", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN c_name END AS contact FROM customer
""")
def p34(m):
    k = F.col("c_custkey")
    contact = lambda kind, primary, name: F.struct(F.lit(kind).alias("type"), primary.alias("primary"), F.col(name).alias("name"))
    people = F.array(contact("TECHNICAL_POINT_OF_CONTACT", F.lit(True), "c_name"),
                     contact("ADMINISTRATIVE_POINT_OF_CONTACT", k % 4 == 0, "c_mktsegment"),
                     contact("ADMINISTRATIVE_POINT_OF_CONTACT", k % 4 < 2, "c_name"))
    return m.raw("customer").select(k.alias("id"), S.primary_contact(people)["name"].alias("contact"))


@query("P35_prefixed_tags", """
SELECT o_orderkey AS id, '10.15468/dl.' || repeat('x', CAST(o_orderkey % 50 AS INTEGER)) || '|' AS tags FROM orders
""")
def p35(m):
    k = F.col("o_orderkey")
    doi = F.concat(F.lit("gbifDOI:10.15468/dl."), F.repeat(F.lit("x"), (k % 50).cast("int")))
    return m.raw("orders").select(k.alias("id"), F.array_join(S.extract_prefixed_tags(F.array(doi, F.lit("a gbifDOI:"), F.lit("gbifDOI:"))), "|").alias("tags"))


@query("P36_authority_date", """
SELECT o_orderkey AS id, CASE WHEN p > 8 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN p > 9 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE WHEN p > 10 THEN CAST(day(o_orderdate) AS INTEGER) END AS day,
  CASE p WHEN 11 THEN CAST(o_orderdate AS DATE) WHEN 10 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 8 THEN NULL ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS date,
  CASE p WHEN 11 THEN 'day' WHEN 10 THEN 'month' WHEN 9 THEN 'year' WHEN 7 THEN 'century' END AS precision_label
FROM (SELECT *, 7 + o_orderkey % 5 AS p FROM orders)
""")
def p36(m):
    o = m.raw("orders")
    time = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    rows = o.select(F.col("o_orderkey").alias("id"), time.alias("time"), (7 + F.col("o_orderkey") % 5).alias("p"))
    return rows.select("id", *[c.alias(n) for n, c in S.authority_date("time", "p").items()])


# --- P6, P11, P16, P17, P19, P32, F13, F21 -----------------------------------------------------------

@query("P11_agent_names", """
WITH a AS (SELECT id, nullif(trim(given), '') AS g, nullif(trim(family), '') AS f, CASE WHEN id % 3 = 0 THEN 'Dr.' END AS t,
             CASE WHEN id % 4 = 0 THEN 'von' END AS p, CASE WHEN id % 5 = 0 THEN 'Jr.' END AS s FROM agents)
SELECT id, concat_ws(' ', t, g, p, f, s) AS fullname,
  concat_ws(', ', nullif(concat_ws(' ', p, f), ''), nullif(concat_ws(' ', t, g), '')) AS fullname_reverse FROM a
""")
def p11(m):
    """Agents with titles, particles and suffixes."""
    k = F.col("id")
    a = m.agents.withColumns({"title": F.when(k % 3 == 0, "Dr."), "particle": F.when(k % 4 == 0, "von"), "suffix": F.when(k % 5 == 0, "Jr.")})
    n = S.agent_names()
    return a.select("id", n["fullname"].alias("fullname"), n["fullname_reverse"].alias("fullname_reverse"))


_SITES = [("orcid", "https://orcid.org/"), ("wikidata", "http://www.wikidata.org/entity/"), ("viaf", "http://viaf.org/viaf/"),
          ("isni", "https://isni.org/"), ("ipni", "https://ipni.org/a?id="), ("bhl", "https://www.biodiversitylibrary.org/creator/"),
          ("zoobank", "http://zoobank.org/Authors/"), ("loc", "http://id.loc.gov/authorities/names/")]
_IDS = {"orcid": "u.orcid", "wikidata": "'Q' || u.id", "viaf": "'' || u.id", "isni": "'0000' || u.id || ' X'", "ipni": "u.id || '-1'", "bhl": "'' || u.id",
        "zoobank": "'AB-' || u.id", "loc": "'n' || u.id"}


@query("P16_source_ids", " UNION ALL ".join(
    f"SELECT u.id, '{k}' AS authority, {_IDS[k]} AS number FROM users u WHERE {_IDS[k]} IS NOT NULL" for k, _ in _SITES))
def p16(m):
    """Every kind of person identifier in an address (one with an escaped blank), classified (P17) and taken out."""
    k = F.col("id").cast("string")
    ids = {"orcid": F.col("orcid"), "wikidata": F.concat(F.lit("Q"), k), "viaf": k, "isni": F.concat(F.lit("0000"), k, F.lit("%20X")),
           "ipni": F.concat(k, F.lit("-1")), "bhl": k, "zoobank": F.concat(F.lit("AB-"), k), "loc": F.concat(F.lit("n"), k)}
    addresses = F.filter(F.array(*[F.concat(F.lit(site), ids[kind]) for kind, site in _SITES]), lambda a: a.isNotNull())
    rows = m.users.select("id", F.explode(addresses).alias("address"))
    return rows.select("id", S.classify_source_id("address").alias("c")).select("id", "c.authority", F.col("c.id").alias("number"))


@query("P19_license_names", """
SELECT gbifID, CASE license WHEN 'CC0_1_0' THEN 'CC0' WHEN 'CC_BY_4_0' THEN 'CC BY' WHEN 'CC_BY_NC_4_0' THEN 'CC BY-NC' END AS name,
  CASE license WHEN 'CC0_1_0' THEN 'https://i.creativecommons.org/p/zero/1.0/88x31.png' WHEN 'CC_BY_4_0' THEN 'https://i.creativecommons.org/l/by/4.0/88x31.png'
    WHEN 'CC_BY_NC_4_0' THEN 'https://i.creativecommons.org/l/by-nc/4.0/88x31.png' END AS icon FROM occurrences
""")
def p19n(m):
    uri = S.license_uri("license")
    return m.occurrences.select("gbifID", uri.alias("u")).select("gbifID", S.license_name("u").alias("name"), S.license_icon("u").alias("icon"))


@query("P32_transliterate", "SELECT id, strip_accents(given || ' ' || family) AS plain FROM users")
def p32(m):
    return m.users.select("id", S.transliterate(F.concat_ws(" ", "given", "family")).alias("plain"))


@query("F13_large_datasets", """
SELECT datasetKey, count(*) AS occurrences_count, count(*) > 8 AS large FROM occurrences GROUP BY 1
""")
def f13l(m):
    from herbaria.operators import filters as FL
    counts = m.occurrences.groupBy("datasetKey").agg(F.count(F.lit(1)).alias("occurrences_count"))
    return counts.withColumn("large", FL.is_large(counts, 8))


@query("F21_datasets_due", """
SELECT d.datasetKey FROM datasets d WHERE d.datasetKey LIKE '%1'
  AND EXISTS (SELECT 1 FROM occurrences o JOIN claims c ON c.occurrence_id = o.gbifID WHERE o.datasetKey = d.datasetKey AND c.visible)
""")
def f21d(m):
    from herbaria.operators import filters as FL
    packaged = m.datasets.withColumn("packaged", F.when(F.col("datasetKey").endswith("1"), F.lit("2001-01-01").cast("date")))
    flags = J.dataset_flags(m.datasets, m.occurrences, m.claims, m.occurrence_agents)
    return FL.deposits_due_datasets(packaged, flags).select("datasetKey")
