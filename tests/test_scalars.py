"""Golden values for the scalar functions (identifier tests of the source system)."""

import datetime as dt

from pyspark.sql import functions as F

from herbaria.functions import scalars as S


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col(F.col("v")).alias("r")).first()["r"]


EXTRACT = [
    ("ipni", "https://www.ipni.org/ipni/idAuthorSearch.do?id=13860-1", "13860-1"),
    ("orcid", "https://orcid.org/0000-0002-7101-9767", "0000-0002-7101-9767"),
    ("viaf", "https://viaf.org/viaf/120062731/", "120062731"),
    ("viaf", "https://viaf.org/viaf/120062739", "120062739"),
    ("wikidata", "http://www.wikidata.org/entity/Q3518898", "Q3518898"),
    ("bhl", "http://www.biodiversitylibrary.org/creator/1368", "1368"),
    ("isni", "http://www.isni.org/0000+0001+2146+438X", "0000 0001 2146 438X"),
    ("zoobank", "http://zoobank.org/Authors/B3C52D0E-E3FF-454B-B342-9235AB7E1545",
     "B3C52D0E-E3FF-454B-B342-9235AB7E1545"),
    ("loc", "http://id.loc.gov/authorities/names/n91033477", "n91033477"),
]


def test_extract_ids(spark):
    rows = spark.createDataFrame([(k, u) for k, u, _ in EXTRACT], "kind string, url string")
    got = {}
    for kind in {k for k, _, _ in EXTRACT}:
        for r in rows.filter(F.col("kind") == kind).select("url", S.extract_id("url", kind).alias("x")).collect():
            got[r.url] = r.x
    for _, url, want in EXTRACT:
        assert got[url] == want, url


def test_is_orcid(spark):
    good = ["0000-0002-4519-8167", "0000-0002-6662-847X", "0009-0006-7586-1763"]
    bad = ["0000-0002-4519-8165", "0000-0002-6662-846X", "x0000-0002-4519-8167", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    res = {r.v: r.ok for r in df.select("v", S.is_orcid("v").alias("ok")).collect()}
    assert all(res[v] for v in good)
    assert not any(res[v] for v in bad)


def test_is_video_id(spark):
    assert one(spark, S.is_video_id, "A_0aadf4h_O") is True
    assert one(spark, S.is_video_id, "A_0aadf4h_OA") is False


def test_wiki_doi_integer(spark):
    assert one(spark, S.is_wiki_id, "Q123") is True
    assert one(spark, S.is_wiki_id, "Q12a") is False
    assert one(spark, S.is_doi, "10.1234/ABC.def") is True
    assert one(spark, S.is_integer, "0012") is False
    assert one(spark, S.is_integer, "12") is True


def test_parse_and_stringify_ids(spark):
    df = spark.createDataFrame([("[1, 2,0,-3,abc, 2]",), ("[]",), (None,)], "t string")
    out = [r.a for r in df.select(S.parse_ids("t").alias("a")).collect()]
    assert out[0] == [1, 2, 2] and out[1] == [] and out[2] is None
    arr = spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<bigint>")
    assert [r.s for r in arr.select(S.stringify_ids("a").alias("s")).collect()] == ["[1,2]", "[]", "[]"]


def test_resolved_dates(spark):
    df = spark.createDataFrame([(dt.date(1850, 5, 6), p) for p in ["day", "month", "year", "century", None]],
                               "d date, p string")
    got = [r.r for r in df.select(S.resolved_date("d", "p").alias("r")).collect()]
    assert got == [dt.date(1850, 5, 6), dt.date(1850, 5, 28), dt.date(1850, 12, 31), dt.date(1750, 1, 1),
                   dt.date(1850, 5, 6)]


def test_initials_and_fold(spark):
    assert one(spark, S.initials, "Mary Anne") == "M.A."
    assert one(spark, S.fold_name, "Müller Straße") == "muller strasse"
    assert one(spark, S.initials_key, "J.R.R. Tolkien") == "jrrt"


def test_agent_unparsed_rules(spark):
    rows = [("", "A"), ("A.B.C.D.E.F", "x"), ("x" * 41, "y"), ("Van der Berg Smith", "J"), ("Smith", "John")]
    df = spark.createDataFrame(rows, "family string, given string")
    got = [r.u for r in df.select(S.is_unparsed().alias("u")).collect()]
    assert got == [True, True, True, True, False]


def test_coordinates(spark):
    df = spark.createDataFrame([("10.5", "20"), ("0", "20"), ("91", "1"), ("x", "1")], "la string, lo string")
    got = [r.c for r in df.select(S.coordinates("la", "lo").alias("c")).collect()]
    assert got == [[20.0, 10.5], None, None, None]


def test_valid_year_and_date(spark):
    df = spark.createDataFrame([("1999-05-01",), ("1700",), ("2030",), ("junk",)], "t string")
    got = [(r.y, r.d) for r in df.select(S.valid_year("t", dt.date(2002, 1, 1)).alias("y"),
                                         S.valid_date("t", dt.date(2002, 1, 1)).alias("d")).collect()]
    assert got == [(1999, dt.date(1999, 5, 1)), (None, None), (None, None), (None, None)]
