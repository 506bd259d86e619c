"""Binding of the driver's TPC-H-style tables to the attribution model.

Every model table is derived from the given parquet tables by fixed
arithmetic, so the amount of work grows with the input. The same rules are
written independently as SQL for the DuckDB oracle in
``herbaria.plans.oracle.BINDING_SQL``; the two must stay in step.

Reference date: ``AS_OF`` (2002-01-01) replaces "now" everywhere.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = _dt.date(2002, 1, 1)

# Fixed values of the binding (invented name lists; positions are used by the
# arithmetic below and by the SQL binding, so keep them in this order).
FAMILY_NAMES = [
    "Smith", "Jones", "Brown", "Taylor", "Wilson", "Davies", "Evans", "Thomas",
    "Johnson", "Roberts", "Müller", "Schäfer", "García", "Núñez", "Dubois",
    "Lefèvre", "Rossi", "Bianchi", "Andersson", "Kowalski",
]
GIVEN_NAMES = [
    "John", "Mary", "Anna", "Peter", "Carl", "Emma", "Louis", "Olga", "Henri",
    "Sofia", "Jakob", "Ingrid", "Pablo", "Marta", "Ivan",
]
PRECISIONS = ["day", "month", "year", "century"]
LICENSES = ["CC0_1_0", "CC_BY_4_0", "CC_BY_NC_4_0"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a non-negative integer column (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _code(k_sql: str) -> Column:
    """Two-letter country code for nation number ``k`` (unique for k < 26)."""
    return F.expr(
        f"concat(substring('{ALPHABET}', cast(({k_sql}) % 26 + 1 as int), 1),"
        f" substring('{ALPHABET}', cast((({k_sql}) * 7) % 26 + 1 as int), 1))")


def _days(start: str, n: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), n.cast("int"))


class Model:
    """Lazily built model tables over one scale-factor folder.

    Each attribute is a lazy DataFrame; nothing is computed until an action
    runs, and only the tables a query touches are planned.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- occurrences -------------------------------------------------------
    @cached_property
    def occurrences(self) -> DataFrame:
        p = self.raw("part")
        nation = self.raw("nation").select("n_nationkey", "n_name")
        k = F.col("p_partkey")
        event = _days("1995-01-01", k * 13 % 2400)
        ident = F.when(k % 11 == 0, F.lit(None).cast("date")).otherwise(
            F.date_add(event, (k * 7 % 900).cast("int")))
        nk = (k % 25).cast("int")
        occ = (p.withColumn("nk", nk)
               .join(nation, F.col("nk") == F.col("n_nationkey"), "left")
               .select(
                   (k + 1).alias("gbifID"),
                   F.col("p_brand").alias("datasetKey"),
                   F.when(k % 4 == 3, F.lit(None).cast("string"))
                    .otherwise(_pick(LICENSES, k % 4)).alias("license"),
                   F.concat(F.lit("occ-"), k.cast("string")).alias("occurrenceID"),
                   F.when(k % 9 == 0, F.lit("HUMAN_OBSERVATION"))
                    .otherwise(F.lit("PRESERVED_SPECIMEN")).alias("basisOfRecord"),
                   ident.cast("string").alias("dateIdentified"),
                   ((k % 181) - 90).cast("string").alias("decimalLatitude"),
                   ((k % 361) - 180).cast("string").alias("decimalLongitude"),
                   F.col("n_name").alias("country"),
                   F.when(F.col("nk") == 24, F.lit(None).cast("string"))
                    .when(F.col("nk") == 23, F.lit("ZZ"))
                    .otherwise(_code("nk")).alias("countryCode"),
                   event.cast("string").alias("eventDate"),
                   F.year(event).cast("string").alias("year"),
                   _pick(["Plantae", "Animalia", "Fungi"], F.col("p_size") % 3).alias("kingdom"),
                   F.col("p_type").alias("family"),
                   F.concat(F.lit("Det. "), F.col("p_name")).alias("identifiedBy"),
                   F.col("p_size").cast("string").alias("institutionCode"),
                   F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("collectionCode"),
                   F.concat(F.lit("C"), k.cast("string")).alias("catalogNumber"),
                   F.col("p_name").alias("recordedBy"),
                   F.concat_ws(" ", F.col("p_type"),
                               F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("scientificName"),
                   F.when(k % 20 == 0, F.lit("Holotype")).when(k % 20 == 1, F.lit("isotype"))
                    .otherwise(F.lit(None).cast("string")).alias("typeStatus"),
                   ident.alias("dateIdentified_processed"),
                   event.alias("eventDate_processed"),
                   F.when(k % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("hasImage"),
                   F.when(k % 5 == 0, F.concat(F.lit("http://www.wikidata.org/entity/Q"),
                                               (_source_person(k) + 1000).cast("string")))
                    .otherwise(F.lit(None).cast("string")).alias("recordedByID"),
                   F.when(k % 7 == 0, F.concat(F.lit("https://orcid.org/"), _orcid(_source_person(k))))
                    .otherwise(F.lit(None).cast("string")).alias("identifiedByID"),
               ))
        return (occ
                .withColumn("eventDate_processed_year", F.year("eventDate_processed"))
                .withColumn("eventDate_processed_month", F.month("eventDate_processed"))
                .withColumn("eventDate_processed_day", F.dayofmonth("eventDate_processed"))
                .withColumn("dateIdentified_processed_year", F.year("dateIdentified_processed"))
                .withColumn("dateIdentified_processed_month", F.month("dateIdentified_processed"))
                .withColumn("dateIdentified_processed_day", F.dayofmonth("dateIdentified_processed")))

    @cached_property
    def raw_download(self) -> DataFrame:
        """Bulk download before cleaning: one row per line item, so every
        gbifID comes in several copies (input of X1 and the refresh job B1)."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        p = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        ln, sk = F.col("l_linenumber"), F.col("l_suppkey")
        ship = F.col("l_shipdate").cast("string")
        none = F.lit(None).cast("string")
        return j.select(
            (F.col("l_partkey") + 1).alias("gbifID"),
            F.col("p_brand").alias("datasetKey"),
            F.when(ln == 7, F.lit("HUMAN_OBSERVATION")).when(ln == 6, F.lit("FOSSIL_SPECIMEN"))
             .otherwise(F.lit("PRESERVED_SPECIMEN")).alias("basisOfRecord"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit("ABSENT"))
             .otherwise(F.lit("PRESENT")).alias("occurrenceStatus"),
            F.concat(F.lit("occ-"), F.col("l_partkey").cast("string")).alias("v_occurrenceID"),
            F.when(sk % 9 == 0, none).when(sk % 9 == 1, F.concat(F.lit("BOLD:"), F.col("p_type")))
             .otherwise(F.concat_ws(" ", F.col("p_type"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))))
             .alias("v_scientificName"),
            F.col("p_type").alias("scientificName"),
            F.when(ln == 5, F.lit("2099-01-01 00:00:00")).when((ln == 4) & (F.col("l_quantity") > 40), F.lit("n/a"))
             .otherwise(ship).alias("eventDate"),
            F.when(F.col("l_tax") == 0, none).otherwise(ship).alias("dateIdentified"),
            ship.alias("v_eventDate"),
            F.upper(F.col("p_name")).alias("recordedBy"),
            F.when(ln == 3, none).otherwise(F.col("p_name")).alias("v_recordedBy"),
            F.when(ln == 2, none).otherwise(F.concat(F.lit("Det. "), F.col("p_name"))).alias("v_identifiedBy"),
            F.when(sk % 5 == 0, F.concat(F.lit("http://www.wikidata.org/entity/Q"), (sk + 1000).cast("string")))
             .otherwise(none).alias("v_recordedByID"),
            F.col("p_size").cast("string").alias("v_institutionCode"),
            F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("v_catalogNumber"),
            F.when(F.col("l_partkey") % 20 == 0, F.lit("HoloType")).otherwise(none).alias("v_typeStatus"),
            (F.col("l_discount") > 0.05).alias("hasImage"),
            F.col("l_orderkey").alias("source_row"),
            ln.alias("source_line"),
        )

    # -- people --------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        family = _pick(FAMILY_NAMES, k % 20)
        given = _pick(GIVEN_NAMES, ((k - k % 20) / 20).cast("bigint") % 15)
        born = F.when(k % 11 == 0, F.lit(None).cast("date")).otherwise(_days("1990-01-01", k * 41 % 3000))
        died = F.when(k % 6 == 0, F.lit(None).cast("date")).otherwise(
            _days("1990-01-01", k * 41 % 3000 + k * 37 % 4000))
        created = _days("1995-06-01", k * 17 % 2000).cast("timestamp_ntz")
        code1 = _code("c_nationkey")
        code2 = _code("c_nationkey + 1")
        return c.select(
            (k + 1).alias("id"),
            family.alias("family"),
            given.alias("given"),
            F.when(k % 17 == 0, F.lit("van")).otherwise(F.lit(None).cast("string")).alias("particle"),
            F.when(k % 2 == 0, _orcid(k)).otherwise(F.lit(None).cast("string")).alias("orcid"),
            F.when(k % 2 == 1, F.concat(F.lit("Q"), (k + 1000).cast("string")))
             .otherwise(F.lit(None).cast("string")).alias("wikidata"),
            F.when(k % 3 == 0, F.concat(given, F.lit(" "), family, F.lit("|"),
                                        F.substring(given, 1, 1), F.lit(". "), family))
             .otherwise(F.lit(None).cast("string")).alias("other_names"),
            F.when(k % 7 == 0, F.concat(code1, F.lit("|"), code2)).otherwise(code1).alias("country_code"),
            F.col("c_mktsegment").alias("keywords"),
            F.when(k % 13 == 0, F.concat(F.lit("Dr. "), given, F.lit(" "), family))
             .otherwise(F.lit(None).cast("string")).alias("label"),
            born.alias("date_born"),
            F.when(born.isNull(), F.lit(None).cast("string"))
             .otherwise(_pick(PRECISIONS, k % 4)).alias("date_born_precision"),
            died.alias("date_died"),
            F.when(died.isNull(), F.lit(None).cast("string"))
             .otherwise(_pick(PRECISIONS, (k + 1) % 4)).alias("date_died_precision"),
            (k % 2 == 0).alias("is_public"),
            created.alias("created"),
            F.when(k % 2 == 0, created + F.expr("INTERVAL 30 DAYS"))
             .otherwise(F.lit(None).cast("timestamp_ntz")).alias("made_public"),
            F.when(k % 4 == 0, F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")))
             .otherwise(F.lit(None).cast("string")).alias("image_url"),
            F.when(k % 8 == 0, F.concat(F.lit("sig/"), k.cast("string"), F.lit(".png")))
             .otherwise(F.lit(None).cast("string")).alias("signature_url"),
            F.when(k % 9 == 0, F.concat(F.lit("10.5281/zenodo."), k.cast("string")))
             .otherwise(F.lit(None).cast("string")).alias("zenodo_doi"),
            F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.org")))
             .otherwise(F.lit(None).cast("string")).alias("email"),
            (k % 10 < 6).alias("wants_mail"),
            F.when(k % 4 == 1, F.lit(None).cast("timestamp_ntz"))
             .otherwise(_days("2001-12-15", k % 20).cast("timestamp_ntz")).alias("mail_last_sent"),
            (k % 3 == 0).alias("visited"),
        )

    # -- claims --------------------------------------------------------------
    @cached_property
    def claims(self) -> DataFrame:
        """user_occurrences: one row per (user, occurrence), from every line item.

        Flags are aggregated as character codes, so the aggregate can hash."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                         "l_returnflag", "l_linestatus", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        g = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy("o_custkey", "l_partkey")
             .agg(F.min(F.ascii("l_returnflag")).alias("rf"), F.max(F.ascii("l_linestatus")).alias("ls"),
                  F.min("l_shipdate").alias("created"), F.max("l_shipdate").alias("updated"),
                  F.min("l_linenumber").alias("ln_min"), F.max("l_linenumber").alias("ln_max"),
                  F.min("l_suppkey").alias("sk")))
        user_id = F.col("o_custkey") + 1
        visible = F.col("ls") == ord("O")
        base = (F.when(F.col("rf") == ord("R"), F.lit("recorded"))
                .when(F.col("rf") == ord("A"), F.lit("identified"))
                .when(F.col("ln_max") == 7, F.lit("identified,recorded"))
                .otherwise(F.lit("recorded,identified")))
        return g.select(
            user_id.alias("user_id"),
            _linked_id(F.col("l_partkey")).alias("occurrence_id"),
            F.when(~visible & (F.col("ln_min") % 2 == 0), F.lit(None).cast("string"))
             .otherwise(base).alias("action"),
            visible.alias("visible"),
            F.col("created"),
            F.col("updated"),
            F.when(F.col("ln_min") <= 3, user_id).otherwise(F.col("sk") + 1).alias("created_by"),
        )

    # -- agents --------------------------------------------------------------
    @cached_property
    def agents(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        unparsed = k % 10 == 0
        family = _pick(FAMILY_NAMES, k % 20)
        given = F.concat(_pick(GIVEN_NAMES, ((k - k % 20) / 20).cast("bigint") % 15), F.lit(" "),
                         F.substring(F.lit(ALPHABET), (((k - k % 300) / 300).cast("bigint") % 26 + 1).cast("int"), 1),
                         F.lit("."))
        none = F.lit(None).cast("string")
        return s.select(
            (k + 1).alias("id"),
            F.when(unparsed, F.lit("")).otherwise(family).alias("family"),
            F.when(unparsed, F.lit("")).otherwise(given).alias("given"),
            none.alias("particle"), none.alias("appellation"), none.alias("title"),
            none.alias("suffix"), none.alias("nick"), none.alias("dropping_particle"),
            F.when(unparsed, F.col("s_name")).otherwise(F.lit("")).alias("unparsed"),
        )

    @cached_property
    def occurrence_agents(self) -> DataFrame:
        li = self.raw("lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
        return (li.select((F.col("l_partkey") + 1).alias("occurrence_id"),
                          (F.col("l_suppkey") + 1).alias("agent_id"),
                          (F.col("l_returnflag") != "A").alias("agent_role"))
                .distinct())

    @cached_property
    def agent_jobs(self) -> DataFrame:
        """Parsed collector strings with their id lists (input of B2): one job
        per (supplier, order); each list holds at most one order's line items."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        g = (li.groupBy("l_suppkey", "l_orderkey")
             .agg(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_partkey") + 1)).alias("gbifIDs_recordedBy"),
                  F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey") + 1)).alias("gbifIDs_identifiedBy")))
        a = self.agents.select(F.col("id").alias("aid"), "family", "given", "unparsed")
        k = F.col("l_suppkey")
        parsed = (F.when(k % 13 == 0, F.lit("not json"))
                  .when(F.col("family") == "", F.lit("[]"))
                  .otherwise(F.to_json(F.array(F.struct(F.col("family"), F.col("given"))))))
        return (g.join(a, (k + 1) == F.col("aid"))
                .select(F.concat_ws("-", F.col("l_orderkey"), k).alias("id"),
                        F.when(F.col("family") == "", F.col("unparsed"))
                         .otherwise(F.concat_ws(" ", "given", "family")).alias("agents"),
                        "gbifIDs_recordedBy", "gbifIDs_identifiedBy", parsed.alias("parsed")))

    # -- taxa and datasets ---------------------------------------------------
    @cached_property
    def taxon_occurrences(self) -> DataFrame:
        """(occurrence_id, family): the taxon of each occurrence."""
        return self.occurrences.select(F.col("gbifID").alias("occurrence_id"), "family")

    @cached_property
    def datasets(self) -> DataFrame:
        p = self.raw("part").select("p_brand").distinct()
        return p.select(F.col("p_brand").alias("datasetKey"),
                        F.concat(F.lit("Dataset "), F.col("p_brand")).alias("title"),
                        F.concat(F.lit("http://creativecommons.org/"),
                                 F.when(F.col("p_brand").endswith("1"), F.lit("publicdomain/zero/1.0/"))
                                 .when(F.col("p_brand").endswith("2"), F.lit("licenses/by-nc/4.0/"))
                                 .otherwise(F.lit("licenses/by/4.0/")), F.lit("legalcode")).alias("license"),
                        F.lit("occurrence").alias("dataset_type"))

    @cached_property
    def messages(self) -> DataFrame:
        """Messages: the customer of an order writes to the person of each of its suppliers."""
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("o_custkey") + 1).alias("user_id"), (F.col("l_suppkey") + 1).alias("recipient_id"),
            F.col("l_shipdate").alias("created_at"))

    # -- articles ------------------------------------------------------------
    @cached_property
    def articles(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
        k = F.col("o_orderkey")
        return o.select(
            (k + 1).alias("id"),
            F.concat(F.lit("10.5555/art."), k.cast("string")).alias("doi"),
            F.when(k % 10 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Article number "), k.cast("string"))).alias("citation"),
            F.when(F.col("o_orderstatus") == "P", F.lit(False)).otherwise(F.lit(True)).alias("processed"),
            (F.col("o_orderstatus") == "O").alias("mail_sent"),
            F.col("o_orderdate").alias("created"),
            F.array(F.concat(F.lit("10.15468/dl."), k.cast("string"))).alias("gbif_dois"),
            F.array(F.concat(F.lit("0000"), k.cast("string"))).alias("gbif_downloadkeys"),
        )

    @cached_property
    def article_occurrences(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        return li.select((F.col("l_orderkey") + 1).alias("article_id"),
                         _linked_id(F.col("l_partkey")).alias("occurrence_id")).distinct()

    @cached_property
    def article_specimens(self) -> DataFrame:
        """(article_id, occurrence_id): citations, each under the id of its specimen."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        return li.select((F.col("l_orderkey") + 1).alias("article_id"), (F.col("l_partkey") + 1).alias("occurrence_id")).distinct()

    # -- organisations -------------------------------------------------------
    @cached_property
    def organizations(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        none = F.lit(None).cast("string")
        return n.select(
            (k + 1).cast("bigint").alias("id"),
            F.concat(F.col("n_name"), F.lit(" Museum")).alias("name"),
            F.concat(F.lit("Q"), (k + 5000).cast("string")).alias("wikidata"),
            F.when(k % 2 == 0, F.concat(F.lit("ror"), k.cast("string"))).otherwise(none).alias("ror"),
            F.when(k % 3 == 0, F.concat(F.lit("grid."), k.cast("string"))).otherwise(none).alias("grid"),
            F.when(k % 5 == 0, (k * 100).cast("string")).otherwise(none).alias("ringgold"),
            F.when(k % 7 == 0, F.concat(F.lit("0000 0001 "), F.lpad(k.cast("string"), 4, "0"), F.lit(" 0000")))
             .otherwise(none).alias("isni"),
            F.array((k + 1).cast("string"), (k + 26).cast("string")).alias("institution_codes"),
        )

    @cached_property
    def organization_records(self) -> DataFrame:
        """Organisations as they come in from several sources, one per supplier: some share identifiers."""
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        none = F.lit(None).cast("string")
        some = lambda step, text, of: F.when(k % step == 0, F.concat(F.lit(text), F.floor(k / of).cast("string"))).otherwise(none)
        return s.select((k + 1).alias("id"), F.col("s_name").alias("name"), some(4, "Q7", 8).alias("wikidata"), some(3, "ror", 6).alias("ror"),
                        some(5, "grid.", 10).alias("grid"), some(7, "", 14).alias("ringgold"), some(11, "isni", 11).alias("isni"),
                        F.array(F.floor(k * 2 / 3).cast("string")).alias("institution_codes"))

    @cached_property
    def record_members(self) -> DataFrame:
        """(user_id, organization_id) members of the organisation records."""
        k = F.col("c_custkey")
        return self.raw("customer").select((k + 1).alias("user_id"), (F.floor(k / 15) + 1).alias("organization_id"))

    @cached_property
    def download_rows(self) -> DataFrame:
        """(key, gbifID, basisOfRecord) rows of the downloads behind articles that are not processed yet."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        o = self.raw("orders").filter(F.col("o_orderstatus") == "P").select("o_orderkey")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("0000"), F.col("l_orderkey").cast("string")).alias("key"), _linked_id(F.col("l_partkey")).alias("gbifID"),
            F.when(F.col("l_linenumber") == 7, F.lit("HUMAN_OBSERVATION")).otherwise(F.lit("PRESERVED_SPECIMEN")).alias("basisOfRecord"))

    @cached_property
    def user_organizations(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        k = F.col("c_custkey")
        start = F.when(k % 19 == 0, F.lit(None).cast("int")).otherwise((k % 3 + 1995).cast("int"))
        return c.select(
            (k + 1).alias("user_id"),
            (F.col("c_nationkey") + 1).cast("bigint").alias("organization_id"),
            start.alias("start_year"),
            (k % 12 + 1).cast("int").alias("start_month"),
            F.when(k % 4 == 1, F.lit(None).cast("int")).otherwise((k % 28 + 1).cast("int")).alias("start_day"),
            F.when(k % 2 == 0, F.lit(None).cast("int")).otherwise(start + 2).alias("end_year"),
            F.when(k % 2 == 0, F.lit(None).cast("int")).otherwise((k % 12 + 1).cast("int")).alias("end_month"),
            F.lit(None).cast("int").alias("end_day"),
        )

    @cached_property
    def countries(self) -> DataFrame:
        """(code, name) of known countries: one per nation."""
        return self.raw("nation").select(_code("n_nationkey").alias("code"), F.col("n_name").alias("name"))

    @cached_property
    def downloads(self) -> DataFrame:
        """(key, total_records) of the download behind each article."""
        li = self.raw("lineitem").select("l_orderkey")
        return (li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total_records"))
                .select(F.concat(F.lit("0000"), F.col("l_orderkey").cast("string")).alias("key"),
                        "total_records"))

    # -- redirects -----------------------------------------------------------
    @cached_property
    def destroyed_users(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey")
        k = F.col("c_custkey")
        return (c.filter((k % 10 == 0) & (k % 50 != 40))
                .select((k + 1).cast("string").alias("identifier"),
                        F.when(k % 70 == 0, F.lit(None).cast("string"))
                         .otherwise((k + 11).cast("string")).alias("redirect_to"),
                        F.when(k % 70 == 0, F.lit("banned")).otherwise(F.lit("merged")).alias("reason")))


def _orcid(k: Column) -> Column:
    """ORCID of person ``k``, with its check digit: unique for the first 220 million people."""
    n = F.when(k < 20_000_000, k + 15_000_000).otherwise(900_000_000_000 + (k - 20_000_000) % 200_000_000)
    digits = F.lpad(n.cast("string"), 15, "0")

    def written(d: Column) -> Column:
        total = F.aggregate(F.split(d, ""), F.lit(0), lambda t, c: (t + c.cast("int")) * 2 % 11)
        last = F.element_at(F.split(F.lit("0 1 2 3 4 5 6 7 8 9 X"), " "), (12 - total) % 11 + 1)
        return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4), F.concat(F.substring(d, 13, 3), last))

    return F.transform(F.array(digits), written)[0]  # one lambda variable holds the digits, so the expression stays small


def _source_person(k: Column) -> Column:
    """The person that the source record of part ``k`` names: three of four parts name another one."""
    return F.floor(k * 3 / 4)


def _linked_id(partkey: Column) -> Column:
    """Occurrence id of a claim or citation: a tenth of the parts is linked by an id that no
    occurrence has (a negative one), which makes orphans and leaves those occurrences unclaimed."""
    return F.when(partkey % 10 == 5, -(partkey + 1)).otherwise(partkey + 1)


def load(spark: SparkSession, sf_dir: str) -> Model:
    return Model(spark, sf_dir)
