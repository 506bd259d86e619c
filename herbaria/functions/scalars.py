"""Scalar column functions (P-series).

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
code generation; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's for equal results.
# ---------------------------------------------------------------------------

# Verbatim-to-model column renames of the bulk download.
DOWNLOAD_RENAMES = {
    "eventDate": "eventDate_processed",
    "dateIdentified": "dateIdentified_processed",
    "v_occurrenceID": "occurrenceID",
    "v_dateIdentified": "dateIdentified",
    "v_decimalLatitude": "decimalLatitude",
    "v_decimalLongitude": "decimalLongitude",
    "v_country": "country",
    "v_eventDate": "eventDate",
    "v_year": "year",
    "v_identifiedBy": "identifiedBy",
    "v_identifiedByID": "identifiedByID",
    "v_institutionCode": "institutionCode",
    "v_collectionCode": "collectionCode",
    "v_catalogNumber": "catalogNumber",
    "v_recordedBy": "recordedBy",
    "v_recordedByID": "recordedByID",
    "v_typeStatus": "typeStatus",
}

# Identifier patterns (P14, P16). Look-behinds of the source are expressed as
# a prefix plus capture group 1.
ORCID_PATTERN = r"^(?:0000-000(?:1-[5-9]|2-[0-9]|3-[0-4])\d{3}-\d{3}[\dX]|0009-00[01]\d-\d{4}-\d{3}[\dX])\z"
WIKI_PATTERN = r"^Q[0-9]{1,}\z"
DOI_PATTERN = r"(?i)^10.\d{4,9}/[-._;()/:<>A-Z0-9]+\z"
VIDEO_ID_PATTERN = r"(?i)^[A-Z0-9_\-]{11}\z"
EXTRACT_PATTERNS = {
    "orcid": r"orcid\.org/((?:\d{4}-){3}\d{3}[0-9X]{1})",
    "wikidata": r"wikidata\.org/(?:entity|wiki)/(Q[0-9]{1,})",
    "ipni": r"ipni.org/(?:.*)\?id\=(.*)",
    "viaf": r"viaf.org/viaf/([0-9]{1,})",
    "bhl": r"biodiversitylibrary.org/creator/([0-9]{1,})",
    "isni": r"isni.org/(.*)",
    "zoobank": r"zoobank.org/Authors/(.*)",
    "loc": r"id.loc.gov/authorities/names/(.*)",
}
# Order in which a source identifier URL is tried.
SOURCE_ID_ORDER = ["wikidata", "orcid", "viaf", "isni", "ipni", "bhl", "zoobank", "loc"]

# License codes, URLs and icons.
LICENSE_URIS = {
    "CC_BY_4_0": "https://creativecommons.org/licenses/by/4.0/legalcode",
    "CC_BY_NC_4_0": "https://creativecommons.org/licenses/by-nc/4.0/legalcode",
    "CC0_1_0": "https://creativecommons.org/publicdomain/zero/1.0/legalcode",
}
LICENSE_ICONS = [
    ("/zero/", "https://i.creativecommons.org/p/zero/1.0/{size}.png"),
    ("/by/", "https://i.creativecommons.org/l/by/4.0/{size}.png"),
    ("/by-nc/", "https://i.creativecommons.org/l/by-nc/4.0/{size}.png"),
]
LICENSE_ICON_DEFAULT = "/images/Clear1x1.gif"
LICENSE_NAMES = [
    ("/zero/", "CC0"),
    ("/by/", "CC BY"),
    ("/by-nc/", "CC BY-NC"),
]

# Kingdom whitelist (F8).
KINGDOMS = ["Animalia", "Archaea", "Bacteria", "Chromista", "Fungi", "Plantae", "Protozoa", "incertae sedis"]

# Earliest accepted year for free-text years and dates.
MIN_YEAR = 1756

# Accent folding table (P30, P32), built by rule: every lower-case Latin letter
# with marks (U+00E0 to U+024F, U+1E00 to U+1EFF) maps to the ASCII base letter of
# its canonical decomposition; a few letters without one map by the table below.
_NO_DECOMPOSITION = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t", "æ": "a", "œ": "o"}


def _fold_tables() -> tuple[str, str]:
    import unicodedata
    src, dst = [], []
    for cp in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        if not ch.islower():
            continue
        base = _NO_DECOMPOSITION.get(ch) or unicodedata.normalize("NFKD", ch)[0]
        if base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_tables()
# Capitals of the same letters; a few have none of one character.
_CAPITALS = [(a.upper(), b.upper()) for a, b in zip(FOLD_FROM, FOLD_TO) if len(a.upper()) == 1]

# Name tokeniser and the initials filter of the search index.
NAME_SPLIT = r"\.|,| "
INITIALS_STRIP = r"[a-z.\s]"

# Wikidata statement ranks (N11) and date precisions.
RANK_SCORES = {"preferred": 2, "normal": 1, "deprecated": -1}



def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of)))


def blank_to_null(col: str | Column) -> Column:
    """Leading spaces stripped; empty text becomes NULL (S1 reader options, done in columns)."""
    c = F.ltrim(_c(col))
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


# -- P1-P5: occurrence cleaning ---------------------------------------------

def clean_occurrences(raw: DataFrame, as_of=None) -> DataFrame:
    """P1-P5 applied to a raw download: renames, verbatim name, image flag, past dates."""
    df = raw.drop("recordedBy", "identifiedBy")
    if "v_scientificName" in df.columns:
        df = df.withColumn("scientificName", F.coalesce(F.col("v_scientificName"), F.col("scientificName")))
        df = df.drop("v_scientificName")
    for old, new in DOWNLOAD_RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    df = (df.withColumn("hasImage", flag_image("hasImage"))
          .withColumn("eventDate_processed", past_date("eventDate_processed", as_of))
          .withColumn("dateIdentified_processed", past_date("dateIdentified_processed", as_of))
          .withColumn("typeStatus", lower_type("typeStatus")))
    return date_parts(date_parts(df, "eventDate_processed"), "dateIdentified_processed")


def flag_image(col: str | Column) -> Column:
    """True -> 1, anything else (false, NULL) -> 0."""
    return F.when(_c(col) == F.lit(True), F.lit(1)).otherwise(F.lit(0))


def past_date(col: str | Column, as_of=None) -> Column:
    """Parse to a date; NULL if unparsable or not strictly before ``as_of``."""
    ts = F.try_to_timestamp(_c(col).cast("string"))
    limit = _as_of(as_of).cast("timestamp")
    return F.when(ts < limit, F.to_date(ts))


def lower_type(col: str | Column) -> Column:
    """P4."""
    return F.lower(_c(col))


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """P5: generated ``<col>_year/_month/_day`` integer columns."""
    return (df.withColumn(f"{col}_year", F.year(col))
            .withColumn(f"{col}_month", F.month(col))
            .withColumn(f"{col}_day", F.dayofmonth(col)))


# -- P6: id lists --------------------------------------------------------------

def stringify_ids(col: str | Column) -> Column:
    """Array -> ``[1,2]``; NULL and empty both give ``[]``."""
    return F.concat(F.lit("["), F.concat_ws(",", F.coalesce(_c(col), F.array().cast("array<bigint>"))), F.lit("]"))


def parse_ids(col: str | Column) -> Column:
    """``[1, 2]`` text -> array<bigint>; non-numbers and values <= 0 dropped."""
    stripped = F.regexp_replace(_c(col), r"[\[\]\s]", "")
    parts = F.split(stripped, ",")
    ids = F.transform(parts, lambda x: x.try_cast("bigint"))
    return F.filter(ids, lambda x: x.isNotNull() & (x > 0))


# -- P7-P10: parsed agent names -------------------------------------------------

NAME_FIELDS = ["family", "given", "particle", "appellation", "title", "suffix", "nick", "dropping_particle"]
NAME_SCHEMA = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in NAME_FIELDS]))
AGENT_KEY = NAME_FIELDS + ["unparsed"]


def parse_names(col: str | Column) -> Column:
    """JSON array of name structs; malformed text gives NULL."""
    return F.from_json(_c(col), NAME_SCHEMA, {"mode": "PERMISSIVE"})


#: Most characters, dots and spaces of a usable name part.
NAME_LIMITS = {"family": {"length": 40, "dots": 4, "spaces": 2}, "given": {"length": 40, "dots": 5}}


def is_unparsed(family: str | Column = "family", given: str | Column = "given",
                check_spaces: bool = True) -> Column:
    """The parse is unusable: no family name, or a part over one of ``NAME_LIMITS``.

    The limit on spaces holds for single names only; the bulk job has none."""
    measure = {"length": F.length, "dots": lambda c: F.regexp_count(c, F.lit("[.]")),
               "spaces": lambda c: F.regexp_count(c, F.lit(" "))}
    parts = {"family": _c(family), "given": _c(given)}
    over = [F.coalesce(measure[kind](parts[part]) > most, F.lit(False))
            for part, limits in NAME_LIMITS.items() for kind, most in limits.items()
            if check_spaces or kind != "spaces"]
    return F.array_contains(F.array(_nonblank(parts["family"]).isNull(), *over), True)


def _nonblank(col: Column) -> Column:
    return F.when(F.trim(col) != "", F.trim(col))


def display_order(given="given", dropping_particle="dropping_particle", particle="particle",
                  family="family", suffix="suffix") -> Column:
    """The parts of a name as they are written, blank ones left out, one space between them."""
    written = F.transform(F.array(*map(_c, (given, dropping_particle, particle, family, suffix))), F.trim)
    return F.array_join(F.filter(written, lambda part: part != ""), " ")


def squeeze(col: str | Column) -> Column:
    """Collapse whitespace runs to one space and trim (regex trim, not only spaces)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s+", " "), r"^ | $", "")


def agent_key(df: DataFrame, raw: str | None = None) -> DataFrame:
    """P10: the nine agent key columns from parsed name columns.

    Unparsed names blank all parts and keep ``unparsed`` = the display order,
    or the raw string ``raw`` when no name was parsed (the row-by-row rule; see
    README). The whole string is kept, so different strings stay different agents.
    """
    unp = is_unparsed("family", "given", check_spaces=False)
    shown = display_order()
    fallback = F.coalesce(F.when(shown != "", shown), F.col(raw) if raw else F.lit(""))
    out = df.withColumn("_unparsed", unp)
    for f in NAME_FIELDS:
        out = out.withColumn(f, F.when(F.col("_unparsed"), F.lit("")).otherwise(squeeze(f)))
    return (out.withColumn("unparsed", F.when(F.col("_unparsed"), squeeze(fallback))
                           .otherwise(F.lit("")))
            .drop("_unparsed"))


# -- P11-P13: names of agents and people ------------------------------------------

def _join_nonblank(sep: str, *cols: Column) -> Column:
    return F.trim(F.concat_ws(sep, *[_nonblank(c) for c in cols]))


def agent_names(prefix: str = "") -> dict[str, Column]:
    """Fullname, fullname_reverse, family_part, given_part of an agent row."""
    col = lambda n: F.col(prefix + n)
    title_part = _join_nonblank(" ", col("appellation"), col("title"))
    given_part = _join_nonblank(" ", title_part, col("given"), col("dropping_particle"))
    family_part = _join_nonblank(" ", col("particle"), col("family"))
    return {
        "fullname": _join_nonblank(" ", given_part, family_part, col("suffix")),
        "fullname_reverse": _join_nonblank(", ", family_part, given_part),
        "family_part": family_part,
        "given_part": given_part,
    }


def user_names(prefix: str = "") -> dict[str, Column]:
    """Fullname (ORCID when family is blank), reverse and view name of a person."""
    col = lambda n: F.col(prefix + n)
    family_part = _join_nonblank(" ", col("particle"), col("family"))
    blank = col("family").isNull() | (F.trim(col("family")) == "")
    fullname = F.when(blank, col("orcid")).otherwise(_join_nonblank(" ", col("given"), family_part))
    reverse = F.when(blank, col("orcid")).otherwise(_join_nonblank(", ", family_part, col("given")))
    return {"fullname": fullname, "fullname_reverse": reverse,
            "viewname": F.coalesce(col("label"), fullname)}


def initials(col: str | Column) -> Column:
    """``Mary Anne`` -> ``M.A.``."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"(\p{Lu})\p{Ll}+", "$1."), r"\s+", "")


# -- P14-P18: identifiers -----------------------------------------------------------

def orcid_checksum_ok(col: str | Column) -> Column:
    """ISO 7064 mod 11-2 check digit over the digits of the string."""
    chars = F.regexp_extract_all(_c(col), F.lit(r"([0-9X])"), 1)
    body = F.slice(chars, 1, 15)
    total = F.aggregate(body, F.lit(0).cast("bigint"),
                        lambda acc, d: (acc + F.coalesce(d.try_cast("bigint"), F.lit(0))) * 2)
    result = (F.lit(12) - total % 11) % 11
    check = F.when(result == 10, F.lit("X")).otherwise(result.cast("string"))
    return F.coalesce((F.size(chars) >= 16) & (F.element_at(chars, -1) == check), F.lit(False))


def is_orcid(col: str | Column) -> Column:
    """ORCID pattern (grouped and anchored) and a valid checksum."""
    return F.coalesce(_c(col).rlike(ORCID_PATTERN), F.lit(False)) & orcid_checksum_ok(col)


def is_wiki_id(col: str | Column) -> Column:
    return F.coalesce(_c(col).rlike(WIKI_PATTERN), F.lit(False))


def is_doi(col: str | Column) -> Column:
    return F.coalesce(_c(col).rlike(DOI_PATTERN), F.lit(False))


def is_video_id(col: str | Column) -> Column:
    return F.coalesce(_c(col).rlike(VIDEO_ID_PATTERN), F.lit(False))


def is_integer(col: str | Column) -> Column:
    """Text equals the decimal form of its integer value."""
    c = _c(col)
    return F.coalesce(c.try_cast("bigint").cast("string") == c, F.lit(False))


def extract_id(col: str | Column, kind: str) -> Column:
    """Identifier of ``kind`` inside a URL, NULL when absent (ISNI URL-decoded)."""
    got = F.regexp_extract(_c(col), EXTRACT_PATTERNS[kind], 1)
    got = F.when(got != "", got)
    if kind == "isni":
        got = F.try_url_decode(got)
    return got


def classify_source_id(col: str | Column) -> Column:
    """struct(authority, id) of the first authority that matches, in fixed order.

    An ORCID only counts when it passes ``is_orcid``.
    """
    branches = None
    for kind in SOURCE_ID_ORDER:
        val = extract_id(col, kind)
        cond = val.isNotNull() & (is_orcid(val) if kind == "orcid" else F.lit(True))
        branch = F.struct(F.lit(kind).alias("authority"), val.alias("id"))
        branches = F.when(cond, branch) if branches is None else branches.when(cond, branch)
    return branches


def person_uri(orcid="orcid", wikidata="wikidata", wikidata_first: bool = False) -> Column:
    """ORCID URL else Wikidata URL (or the reverse when ``wikidata_first``)."""
    o = F.concat(F.lit("https://orcid.org/"), _c(orcid))
    w = F.concat(F.lit("http://www.wikidata.org/entity/"), _c(wikidata))
    return F.coalesce(w, o) if wikidata_first else F.coalesce(o, w)


def identifier(orcid="orcid", wikidata="wikidata", id_col="id") -> Column:
    """ORCID, else Wikidata id, else the local id as text."""
    return F.coalesce(_c(orcid), _c(wikidata), _c(id_col).cast("string"))


# -- P19-P20 -----------------------------------------------------------------------

def license_uri(col: str | Column) -> Column:
    """License code -> legal-code URL."""
    c = _c(col)
    out = None
    for code, uri in LICENSE_URIS.items():
        out = F.when(c == code, F.lit(uri)) if out is None else out.when(c == code, F.lit(uri))
    return out


def license_icon(col: str | Column, form: str = "button") -> Column:
    """License URL -> icon URL."""
    size = "88x31" if form == "button" else "80x15"
    c = _c(col)
    out = None
    for needle, url in LICENSE_ICONS:
        cond = c.contains(needle)
        val = F.lit(url.format(size=size))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return F.when(c.isNotNull(), out.otherwise(F.lit(LICENSE_ICON_DEFAULT)))


def license_name(col: str | Column) -> Column:
    c = _c(col)
    out = None
    for needle, name in LICENSE_NAMES:
        out = F.when(c.contains(needle), F.lit(name)) if out is None else out.when(c.contains(needle), F.lit(name))
    return out


def signed_coordinate(col: str | Column) -> Column:
    """Text coordinate to double, negative when it names W or S."""
    c = _c(col)
    num = F.regexp_extract(c, r"^\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(c.rlike("(?i)[ws]"), -num).otherwise(num)


def coordinates(lat="decimalLatitude", long="decimalLongitude") -> Column:
    """P20: [long, lat] as doubles; NULL if either is 0/unparsable or out of range."""
    la = F.coalesce(F.regexp_extract(_c(lat), r"^\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    lo = F.coalesce(F.regexp_extract(_c(long), r"^\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    bad = (la == 0) | (lo == 0) | (la > 90) | (la < -90) | (lo > 180) | (lo < -180)
    return F.when(~bad, F.array(lo, la))


# -- P21-P26: dates of people ----------------------------------------------------

def resolved_date(date: str | Column, precision: str | Column) -> Column:
    """Century -> (year-100)-01-01; year -> 12-31; month -> day 28; else as is."""
    d, p = _c(date), _c(precision)
    return (F.when(d.isNull(), F.lit(None).cast("date"))
            .when(p == "century", F.make_date(F.year(d) - 100, F.lit(1), F.lit(1)))
            .when(p == "year", F.make_date(F.year(d), F.lit(12), F.lit(31)))
            .when(p == "month", F.make_date(F.year(d), F.month(d), F.lit(28)))
            .otherwise(d))


def valid_year(col: str | Column, as_of=None) -> Column:
    """Leading four-digit year within MIN_YEAR..year(as_of), else NULL."""
    y = F.regexp_extract(_c(col), r"^\s*(\d{4})", 1).try_cast("int")
    return F.when((y >= MIN_YEAR) & (y <= F.year(_as_of(as_of))), y)


def valid_date(col: str | Column, as_of=None) -> Column:
    """ISO ``yyyy-MM-dd`` date within the same year range, else NULL."""
    text = F.regexp_extract(_c(col), r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    d = F.try_to_date(F.when(text != "", text), "yyyy-MM-dd")
    return F.when((F.year(d) >= MIN_YEAR) & (F.year(d) <= F.year(_as_of(as_of))), d)


def _ordinal(n: Column) -> Column:
    """``21st``, ``22nd``, ``23rd``, ``11th``."""
    teens = (n % 100).between(11, 13)
    ending = (F.when(~teens & (n % 10 == 1), "st").when(~teens & (n % 10 == 2), "nd").when(~teens & (n % 10 == 3), "rd").otherwise("th"))
    return F.concat(n.cast("string"), ending)


def _render_date(d: Column, p: Column) -> Column:
    return (F.when(p == "day", F.date_format(d, "MMMM d, yyyy"))
            .when(p == "month", F.date_format(d, "MMMM yyyy"))
            .when(p == "year", F.date_format(d, "yyyy"))
            .when(p == "century", F.concat(_ordinal(F.floor(F.year(d) / 100) + 1), F.lit(" century")))
            .otherwise(F.lit("?")))


def lifespan_label(born="date_born", born_p="date_born_precision", died="date_died",
                   died_p="date_died_precision") -> Column:
    """``born – died`` rendered by precision (English), ``?`` when unknown."""
    b = F.coalesce(F.when(_c(born).isNotNull(), _render_date(_c(born), _c(born_p))), F.lit("?"))
    d = F.coalesce(F.when(_c(died).isNotNull(), _render_date(_c(died), _c(died_p))), F.lit("?"))
    return F.concat(b, F.lit(" – "), d)


def membership_dates(prefix: str) -> Column:
    """P25: date from ``<prefix>_year/_month/_day`` with missing month/day as 1."""
    y, m, d = F.col(f"{prefix}_year"), F.col(f"{prefix}_month"), F.col(f"{prefix}_day")
    return F.when(y.isNotNull(), F.make_date(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1))))


def has_lifespan_evidence(as_of=None) -> Column:
    """Family set, no ORCID, and a death date, or born at least 120 years ago."""
    born_old = (F.col("date_born").isNotNull() & F.col("date_born_precision").isNotNull()
                & (F.year(_as_of(as_of)) - F.year("date_born") >= 120))
    died = F.col("date_died").isNotNull() & F.col("date_died_precision").isNotNull()
    return F.col("family").isNotNull() & F.col("orcid").isNull() & (died | born_old)


def role_flags(col: str | Column = "action") -> dict[str, Column]:
    """recorded?, identified?, both? from the action text."""
    a = _c(col)
    r = F.coalesce(a.contains("recorded"), F.lit(False))
    i = F.coalesce(a.contains("identified"), F.lit(False))
    return {"is_recorded": r, "is_identified": i, "is_both": r & i}


def occurrence_uri(col: str | Column = "gbifID") -> Column:
    """P28."""
    return F.concat(F.lit("https://gbif.org/occurrence/"), _c(col).cast("string"))


def preferred_org_id() -> Column:
    """First of wikidata, ror, grid, ringgold, isni."""
    return F.coalesce(F.col("wikidata"), F.col("ror"), F.col("grid"), F.col("ringgold").cast("string"),
                      F.col("isni"))


# -- P29-P32: text -------------------------------------------------------------------

def strip_markup(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), r"<[^>]*>", "")


def truncate(col: str | Column, n: int, omission: str = "...") -> Column:
    """Cut to ``n`` characters including the omission marker."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(omission)), F.lit(omission))).otherwise(c)


def split_pipe(col: str | Column) -> Column:
    c = _c(col)
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def transliterate(col: str | Column) -> Column:
    """Accent folding by a fixed character table, case kept."""
    c = F.translate(_c(col), FOLD_FROM, FOLD_TO)
    return F.translate(c, "".join(a for a, _ in _CAPITALS), "".join(b for _, b in _CAPITALS))


def fold_name(col: str | Column) -> Column:
    """Lower case, accent folding, ß -> ss, German ae/oe/ue -> a/o/u."""
    c = F.translate(F.lower(_c(col)), FOLD_FROM, FOLD_TO)
    c = F.replace(c, F.lit("ß"), F.lit("ss"))
    c = F.regexp_replace(c, "ae", "a")
    c = F.regexp_replace(c, "oe", "o")
    return F.regexp_replace(c, "(?<!q)ue", "u")


def name_tokens(col: str | Column) -> Column:
    """Folded tokens split on dot, comma or space, blanks dropped."""
    return F.filter(F.split(fold_name(col), NAME_SPLIT), lambda x: x != "")


def edge_ngrams(col: str | Column, max_gram: int | None = None) -> Column:
    """All prefixes, or those of at most ``max_gram`` characters."""
    c = _c(col)
    n = F.length(c) if max_gram is None else F.least(F.length(c), F.lit(max_gram))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, 1, i))).otherwise(
        F.array().cast("array<string>"))


def initials_key(col: str | Column) -> Column:
    """Strip lower-case letters, dots and spaces, then lower and fold."""
    return F.translate(F.lower(F.regexp_replace(_c(col), INITIALS_STRIP, "")), FOLD_FROM, FOLD_TO)


# -- P33-P36 ---------------------------------------------------------------------------

def is_valid_json(col: str | Column) -> Column:
    """P33."""
    c = _c(col)
    return c.isNotNull() & F.try_parse_json(c).isNotNull()


def primary_contact(col: str | Column) -> Column:
    """First administrative, primary contact of an array of contact structs, null if there is none."""
    picked = F.filter(_c(col), lambda x: (x["type"] == "ADMINISTRATIVE_POINT_OF_CONTACT")
                      & (x["primary"] == F.lit(True)))
    return F.get(picked, F.lit(0))


def extract_prefixed_tags(col: str | Column, prefix: str = "gbifDOI:") -> Column:
    """Tags that start with ``prefix``, prefix removed."""
    return F.transform(F.filter(_c(col), lambda t: t.startswith(prefix)),
                       lambda t: F.substr(t, F.lit(len(prefix) + 1)))


def authority_date(time: str | Column, precision: str | Column) -> dict[str, Column]:
    """Time text ``+YYYY-MM-DDThh:mm:ssZ`` and numeric precision ->
    year/month/day kept by precision, plus (date, label) by precision name.
    """
    t, p = _c(time), _c(precision)
    m = r"(-?\d+)-(\d{2})-(\d{2})T"
    year = F.regexp_extract(t, m, 1).try_cast("int")
    month = F.regexp_extract(t, m, 2).try_cast("int")
    day = F.regexp_extract(t, m, 3).try_cast("int")
    label = (F.when(p == 11, F.lit("day")).when(p == 10, F.lit("month")).when(p == 9, F.lit("year"))
             .when(p == 7, F.lit("century")))
    date = (F.when(p == 11, F.make_date(year, month, day))
            .when(p == 10, F.make_date(year, month, F.lit(1)))
            .when(p.isin(9, 7), F.make_date(year, F.lit(1), F.lit(1))))
    return {
        "year": F.when(p > 8, year), "month": F.when(p > 9, month), "day": F.when(p > 10, day),
        "date": date, "precision_label": label,
    }


def rank_score(col: str | Column) -> Column:
    c = _c(col)
    return (F.when(c == "preferred", F.lit(2)).when(c == "normal", F.lit(1))
            .when(c == "deprecated", F.lit(-1)).otherwise(F.lit(0)))
