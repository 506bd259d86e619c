"""Filters over whole tables (F-series).

Each returns a lazily filtered DataFrame; predicates on scan columns reach the
Parquet reader as pushed filters.
"""

from __future__ import annotations

import datetime as _dt
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S

# Record admission rule of the bulk download request (F1).
ADMITTED_BASIS = ["OCCURRENCE", "LIVING_SPECIMEN", "FOSSIL_SPECIMEN", "PRESERVED_SPECIMEN",
                  "MATERIAL_SAMPLE", "MATERIAL_CITATION"]
BARCODE_NAME_MARKERS = ["BOLD:", "BOLD-", "BIOUG"]
# Columns that may not be used for filtering or export.
INTERNAL_OCCURRENCE_COLUMNS = [
    "gbifID", "dateIdentified_processed", "eventDate_processed", "hasImage",
    "eventDate_processed_year", "eventDate_processed_month", "eventDate_processed_day",
    "dateIdentified_processed_year", "dateIdentified_processed_month", "dateIdentified_processed_day",
]
PAGE_SIZES = [25, 50, 100, 250]
LARGE_DATASET = 1_500_000


def admit_records(raw: DataFrame, basis="basisOfRecord", identified_by="identifiedBy",
                  recorded_by="recordedBy", status="occurrenceStatus",
                  verbatim_name="v_scientificName") -> DataFrame:
    """admitted basis of record, a collector or determiner, not ABSENT,
    and no barcode-style verbatim name."""
    cond = F.col(basis).isin(ADMITTED_BASIS)
    cond = cond & (F.col(identified_by).isNotNull() | F.col(recorded_by).isNotNull())
    if status in raw.columns:
        cond = cond & ~F.coalesce(F.col(status) == "ABSENT", F.lit(False))
    if verbatim_name in raw.columns:
        bad = None
        for m in BARCODE_NAME_MARKERS:
            c = F.col(verbatim_name).contains(m)
            bad = c if bad is None else bad | c
        cond = cond & (F.col(verbatim_name).isNull() | ~bad)
    return raw.filter(cond)


# -- F2 / F3: claim visibility and roles ----------------------------------------

def visible(claims: DataFrame) -> DataFrame:
    return claims.filter(P.vis())


def hidden(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("visible") == F.lit(False))


def hidden_by_others(claims: DataFrame) -> DataFrame:
    """Rejections made by someone other than the person."""
    return hidden(claims).filter(F.col("created_by") != F.col("user_id"))


def with_role(claims: DataFrame, kind: str) -> DataFrame:
    """visible claims whose action matches ``kind`` (recorded/identified/both/any)."""
    return claims.filter(P.vis() & P.role(kind))


# -- F4 / F5: faceted filters ---------------------------------------------------------

def specimen_filters(claims: DataFrame, occurrences: DataFrame, action: str | None = None,
                     start_year: int | None = None, end_year: int | None = None,
                     country_code: str | None = None, family: str | None = None,
                     kingdom: str | None = None, institution_code: str | None = None,
                     dataset_key: str | None = None, attributor: int | None = None,
                     recorded_by: str | None = None) -> DataFrame:
    """visible claims joined to occurrences, narrowed by facets.

    ``action`` = ``collected`` uses recordings and the event year;
    ``identified`` uses identifications and the identification year.
    """
    c = visible(claims)
    year_col = None
    if action == "collected":
        c, year_col = c.filter(P.rec()), "eventDate_processed_year"
    elif action == "identified":
        c, year_col = c.filter(P.idn()), "dateIdentified_processed_year"
    elif action is not None:
        raise ValueError(f"unknown action {action!r}")
    occ = occurrences
    conds: list[Column] = []
    if year_col and start_year is not None:
        conds.append(F.col(year_col) >= start_year)
    if year_col and end_year is not None:
        conds.append(F.col(year_col) <= end_year)
    for col, val in [("countryCode", country_code), ("family", family),
                     ("institutionCode", institution_code), ("datasetKey", dataset_key),
                     ("recordedBy", recorded_by)]:
        if val:
            conds.append(F.col(col) == val)
    if kingdom and kingdom in S.KINGDOMS:
        conds.append(F.col("kingdom") == kingdom)
    for cond in conds:
        occ = occ.filter(cond)
    if attributor is not None:
        c = c.filter(F.col("created_by") == attributor)
    return c.join(occ, c["occurrence_id"] == occ["gbifID"])


def candidate_filters(candidates: DataFrame, dataset_key: str | None = None, family: str | None = None,
                      kingdom: str | None = None, country_code: str | None = None) -> DataFrame:
    """facets on candidate occurrences (rows carrying occurrence columns)."""
    out = candidates
    if dataset_key:
        out = out.filter(F.col("datasetKey") == dataset_key)
    if family:
        out = out.filter(F.col("family") == family)
    if kingdom and kingdom in S.KINGDOMS:
        out = out.filter(F.col("kingdom") == kingdom)
    if country_code:
        out = out.filter(F.col("countryCode") == country_code)
    return out


def where_conditions(occurrences: DataFrame, conditions: str) -> DataFrame:
    """JSON object of conditions (``=>`` counts as ``:``).

    A key ``field LIKE ?`` takes its value as a pattern; a plain field must equal
    its value, be one of a list, or be missing for ``null``. Unknown or internal
    fields, the record id and bad JSON raise ValueError."""
    try:
        conds = json.loads(conditions.replace("=>", ":"))
    except json.JSONDecodeError as e:
        raise ValueError(f"conditions are not valid JSON: {e}") from e
    if not isinstance(conds, dict):
        raise ValueError("conditions must be a JSON object")
    allowed = [c for c in occurrences.columns if c not in INTERNAL_OCCURRENCE_COLUMNS]
    out = occurrences
    for key, value in conds.items():
        field, is_pattern = re.subn(r"\s+LIKE\s+\?\s*$", "", key, flags=re.IGNORECASE)
        if field not in allowed:
            raise ValueError(f"field {field!r} is not filterable")
        col = F.col(field)
        if is_pattern:
            out = out.filter(col.like(str(value)))
        elif value is None:
            out = out.filter(col.isNull())
        else:
            out = out.filter(col.isin(value) if isinstance(value, list) else col == value)
    return out


def valid_family(df: DataFrame, col: str = "family") -> DataFrame:
    """trimmed family is non-blank letters only (trim first; see README)."""
    fam = F.trim(F.col(col))
    return df.withColumn(col, fam).filter(fam.rlike(r"^[a-zA-Z]+\z"))


def valid_kingdom(col: str | Column = "kingdom") -> Column:
    """F8."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(S.KINGDOMS), F.lit(False))


def _is_day(month_of: Column, day_of: Column, month: int | None, day: int | None) -> Column:
    return (F.lit(True) if month is None else month_of == month) & (F.lit(True) if day is None else day_of == day)


def born_on(users: DataFrame, month: int | None = None, day: int | None = None, kind: str = "born") -> DataFrame:
    """people with a day-precise birth (or death), on month/day if given."""
    d = "date_born" if kind == "born" else "date_died"
    return users.filter((F.col(f"{d}_precision") == "day") & _is_day(F.month(d), F.dayofmonth(d), month, day))


def collected_on(occurrences: DataFrame, claims: DataFrame, month: int | None = None, day: int | None = None) -> DataFrame:
    """holotypes with an image, collected after 1800, on month/day if given, with a
    visible recorded claim."""
    occ = occurrences.filter((F.lower("typeStatus") == "holotype") & (F.col("hasImage") == 1)
                             & (F.col("eventDate_processed_year") > 1800)
                             & _is_day(F.col("eventDate_processed_month"), F.col("eventDate_processed_day"), month, day))
    rec = with_role(claims, "recorded").select(F.col("occurrence_id").alias("gbifID"))
    return occ.join(rec, "gbifID", "left_semi")


def public_roster(users: DataFrame, kind: str = "public") -> DataFrame:
    """public people; ``gallery`` with image; ``signatures`` with signature;
    ``help`` non-bot people with a family name and a label."""
    if kind == "public":
        return users.filter(F.col("is_public"))
    if kind == "gallery":
        return users.filter(F.col("is_public") & F.col("image_url").isNotNull())
    if kind == "signatures":
        return users.filter(F.col("is_public") & F.col("signature_url").isNotNull())
    if kind == "help":
        return users.filter(~P.is_bot("id") & F.col("family").isNotNull() & F.col("label").isNotNull())
    raise ValueError(kind)


def users_in_country(users: DataFrame, code: str, exact: bool = False) -> DataFrame:
    """substring match on the pipe list (parity), or exact list membership."""
    if exact:
        return users.filter(F.array_contains(F.split("country_code", r"\|"), code))
    return users.filter(F.col("country_code").contains(code))


def datasets_with_source_ids(counts: DataFrame) -> DataFrame:
    """F13."""
    return counts.filter(F.col("source_attribution_count") > 0)


def is_large(counts: DataFrame, most: int = LARGE_DATASET) -> Column:
    """a dataset with more occurrences than ``most`` (the source's pages leave such out)."""
    return counts["occurrences_count"] > most


def citable_articles(articles: DataFrame) -> DataFrame:
    """processed with a citation, newest first."""
    return (articles.filter(F.col("processed") & F.col("citation").isNotNull())
            .orderBy(F.col("created").desc(), "id"))


def changed_since(claims: DataFrame, since) -> DataFrame:
    """people touched since ``since``: claim holders and claimants."""
    recent = claims.filter(F.col("created") >= F.lit(since))
    return (recent.select(F.col("user_id").alias("user_id"))
            .unionByName(recent.select(F.col("created_by").alias("user_id")))
            .distinct())


def deposits_due_datasets(datasets: DataFrame, flags: DataFrame) -> DataFrame:
    """F21 for datasets: packaged ones (``packaged`` set) that hold a visible claim."""
    return datasets.filter(F.col("packaged").isNotNull()).join(flags.filter("has_claim").select("datasetKey"), "datasetKey", "left_semi")


def exact_lookup(occurrences: DataFrame, dataset_key: str, occurrence_id: str) -> DataFrame:
    """F16."""
    return occurrences.filter((F.col("datasetKey") == dataset_key) & (F.col("occurrenceID") == occurrence_id))


def notify_due(users: DataFrame, now) -> DataFrame:
    """wants mail, has e-mail, never mailed or last mail more than 6 days ago."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 6 DAYS")
    return users.filter(F.col("wants_mail") & F.col("email").isNotNull()
                        & (F.col("mail_last_sent").isNull() | (F.col("mail_last_sent") < limit)))


def current_membership(user_organizations: DataFrame, as_of: _dt.date) -> DataFrame:
    """memberships with a start year and no end or an end after ``as_of``;
    the first per person by (start, organisation)."""
    cur = user_organizations.filter(F.col("start_year").isNotNull()
                                    & (F.col("end_year").isNull() | (F.col("end_year") > as_of.year)))
    w = W.partitionBy("user_id").orderBy("start_year", "organization_id")
    return cur.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def wikidata_to_publish(users: DataFrame, claims: DataFrame, since) -> DataFrame:
    """private Wikidata people with a claim created since ``since``."""
    recent = claims.filter(F.col("created") >= F.lit(since)).select(F.col("user_id").alias("id"))
    return (users.filter(F.col("wikidata").isNotNull() & ~F.col("is_public"))
            .join(recent, "id", "left_semi"))


def claims_received(claims: DataFrame) -> DataFrame:
    """visible claims made by someone else than the person."""
    return visible(claims).filter(F.col("created_by") != F.col("user_id"))


def claims_given(claims: DataFrame) -> DataFrame:
    """visible claims a claimant made for other people (keyed by created_by)."""
    return visible(claims).filter(F.col("created_by") != F.col("user_id"))


def deposits_due(users: DataFrame, claims: DataFrame, since) -> DataFrame:
    """people with a deposit and a claim since ``since`` whose newest visible
    claim (ties: highest claimant id) is not by a bot."""
    vis = visible(claims)
    latest = (vis.groupBy("user_id")
              .agg(F.max("created").alias("latest_created"),
                   F.max_by("created_by", F.struct("created", "created_by")).alias("latest_by")))
    recent = claims.filter(F.col("created") >= F.lit(since)).select("user_id").distinct()
    return (users.filter(F.col("zenodo_doi").isNotNull()).withColumnRenamed("id", "user_id")
            .join(recent, "user_id", "left_semi")
            .join(latest, "user_id")
            .filter(~P.is_bot("latest_by")))
