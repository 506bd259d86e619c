"""Invariants and hand-made fixtures for operators (the survey's section 7.5)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from herbaria.operators import aggs, joins as J, mutate as M, sets as X, windows as N
from herbaria.sources.testdata import AS_OF, Model


def test_redirect_chains_banned_and_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", None), ("y", "x"), ("p", "q"), ("q", "p"), ("s", " ")]
    d = spark.createDataFrame(rows, "identifier string, redirect_to string")
    got = {r.identifier: (r.resolved, r.banned, r.cycle) for r in M.resolve_redirects(d, max_rounds=8).collect()}
    assert got["a"] == ("d", False, False)
    assert got["b"] == ("d", False, False)
    assert got["x"] == (None, True, False)
    assert got["y"] == (None, True, False)
    assert got["s"] == (None, True, False)
    assert got["p"][2] and got["q"][2]


def test_merge_users_moves_and_drops(spark):
    claims = spark.createDataFrame(
        [(10, 1, "recorded", True, 10), (10, 2, "recorded", True, 5), (20, 2, "identified", True, 20)],
        "user_id long, occurrence_id long, action string, visible boolean, created_by long")
    pairs = spark.createDataFrame([(10, 20)], "src long, dest long")
    got = sorted(tuple(r) for r in M.merge_users(claims, pairs).collect())
    assert got == [(20, 1, "recorded", True, 20), (20, 2, "identified", True, 20)]


def test_insert_ignore_first_wins(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    delta = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k long, v string")
    got = sorted(tuple(r) for r in X.insert_ignore(target, delta, ["k"], order=["v"]).collect())
    assert got == [(1, "a"), (2, "b")]


def test_dedupe_is_order_independent(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 1, "z")], "gbifID long, o long, v string")
    a = sorted(tuple(r) for r in X.dedupe_occurrences(df, ["o"]).collect())
    b = sorted(tuple(r) for r in X.dedupe_occurrences(df.orderBy(F.rand(3)), ["o"]).collect())
    assert a == b == [(1, 2, "y"), (2, 1, "z")]


def test_network_symmetry_and_transpose(spark):
    m = Model(spark, SF_SMALL)
    j9 = J.recorded_with(m.claims)
    assert j9.exceptAll(j9.select(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"),
                                  "shared")).count() == 0
    j10, j11 = J.identified_for(m.claims), J.identified_by(m.claims)
    t = j11.select(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"), "shared")
    assert j10.exceptAll(t).count() == 0 and t.exceptAll(j10).count() == 0


def test_unclaimed_counts_bounded(spark):
    m = Model(spark, SF_SMALL)
    scope = aggs.scope_of_occurrences(m.occurrences, "datasetKey")
    all_ = aggs.agent_counts(scope, m.occurrence_agents, m.agents).withColumnRenamed("count_all", "a")
    un = aggs.agent_counts(scope, m.occurrence_agents, m.agents, claims=m.claims).withColumnRenamed("count_all", "u")
    j = un.join(all_, ["datasetKey", "agent_id"], "left")
    assert j.filter(F.col("a").isNull() | (F.col("u") > F.col("a"))).count() == 0


def test_classify_roles_partitions_union(spark):
    rec = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, occurrence_id long")
    idn = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, occurrence_id long")
    got = {r.occurrence_id: r.action for r in X.classify_roles(rec, idn).collect()}
    assert got == {1: "recorded", 2: "recorded,identified", 3: "identified"}


def test_year_bins_gap_filled(spark):
    m = Model(spark, SF_SMALL)
    bins = aggs.year_bins(m.claims, m.occurrences, "recorded", 2, as_of=AS_OF)
    w = bins.groupBy("user_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.count("*").alias("n"))
    assert w.filter((F.col("hi") - F.col("lo")) / 2 + 1 != F.col("n")).count() == 0


def test_running_total_monotone(spark):
    m = Model(spark, SF_SMALL)
    rows = aggs.monthly(m.claims, "attributions", dt.date(2001, 7, 1)).orderBy("year", "month").collect()
    totals = [r.total for r in rows]
    assert totals == sorted(totals) and totals[-1] == sum(r.n for r in rows)


def test_random_sample_reproducible(spark):
    m = Model(spark, SF_SMALL)
    a = [r.id for r in N.random_sample(m.users, "id", 10, 42).collect()]
    b = [r.id for r in N.random_sample(m.users, "id", 10, 42).collect()]
    assert a == b and len(a) == 10


def test_package_subsets(spark):
    from herbaria.operators import packages as A
    m = Model(spark, SF_SMALL)
    a3 = A.attributions_table(m.occurrences, m.claims, m.users)
    a6 = A.missing_attributions_table(a3, m.occurrences, aggs.dataset_counters(m.occurrences, m.claims))
    assert a6.exceptAll(a3).count() == 0


def test_same_family_skips_blank_names(spark):
    rows = [(1, "Smith", "John"), (2, "Smith", "jane"), (3, "Smith", ""), (4, "Smith", "Mary"), (5, "", ""), (6, "", "")]
    a = spark.createDataFrame(rows, "id long, family string, given string")
    got = {(r.agent_id, r.other_agent_id) for r in J.same_family(a, first_initial=True).collect()}
    assert got == {(1, 2), (2, 1)}
    assert {r.agent_id for r in J.same_family(a).collect()} == {1, 2, 3, 4}


def test_claim_pivot_merges_spellings_and_drops_rejections(spark):
    from herbaria.operators import exports as K
    claims = spark.createDataFrame(
        [(7, 3, "recorded,identified", 2), (7, 1, "identified,recorded", 2), (7, 2, None, 2), (7, 4, "recorded", 2),
         (7, 5, "recorded", 7), (8, 6, "identified", 2)],
        "user_id long, occurrence_id long, action string, created_by long")
    users = spark.createDataFrame([(7, "0000-0001-0000-0007", None), (8, None, "Q8")],
                                  "id long, orcid string, wikidata string")
    got = sorted(tuple(r) for r in K.claim_pivot(claims, users).collect())
    assert got == [("0000-0001-0000-0007", "recorded", "[4]"), ("0000-0001-0000-0007", "recorded,identified", "[1,3]"),
                   ("Q8", "identified", "[6]")]


def test_where_conditions(spark):
    import pytest

    from herbaria.operators import filters as FL
    occ = spark.createDataFrame([(1, "50%", "A"), (2, "50 m", "A"), (3, None, "B")],
                                "gbifID long, recordedBy string, family string")
    ids = lambda c: [r.gbifID for r in FL.where_conditions(occ, c).orderBy("gbifID").collect()]
    assert ids('{"recordedBy": "50%"}') == [1]
    assert ids('{"recordedBy LIKE ?": "50%"}') == [1, 2]
    assert ids('{"recordedBy like ? " => "50%", "family": ["A", "B"]}') == [1, 2]
    assert ids('{"recordedBy": null}') == [3]
    for bad in ('{"gbifID": 1}', '{"nothing": 1}', "[1]", "{"):
        with pytest.raises(ValueError):
            FL.where_conditions(occ, bad)


def test_claim_upload_prefers_the_action(spark):
    from herbaria.sources import readers as R
    rows = [("1", " recorded ", "true"), ("2", "identified, recorded", None), ("3", "Recorded", None),
            ("4", None, "TRUE"), ("5", None, "false"), ("x", "recorded", None), ("6", "Recorded", "true")]
    df = spark.createDataFrame(rows, "gbifid string, action string, not_me string")
    got = sorted((r.occurrence_id, r.action, r.visible) for r in R.claim_upload_rows(df, 9, 5).collect())
    assert got == [(1, "recorded", True), (2, "recorded,identified", True), (4, None, False), (6, None, False)]


def test_name_variants_take_every_alias(spark):
    from herbaria.operators import matching as T
    names = "|".join(f"Alias Number{i}" for i in range(14))
    u = spark.createDataFrame([(1, "Smith", "John", None, None, None, names)],
                              "id long, family string, given string, particle string, label string, orcid string, "
                              "other_names string")
    assert T.name_variants(u).filter("kind = 'other'").count() == 14
    assert T.name_variants(u, max_other_names=10).filter("kind = 'other'").count() == 10


def test_page_size_is_checked(spark):
    import pytest
    df = spark.range(60)
    assert [r.id for r in N.page(df, [F.col("id")], 9, 25).collect()] == list(range(50, 60))
    with pytest.raises(ValueError):
        N.page(df, [F.col("id")], 1, 30)


def test_source_claims_need_the_authority(spark):
    from herbaria.plans import jobs as B
    occ = spark.createDataFrame(
        [(1, "http://www.wikidata.org/entity/Q9", None), (2, "https://viaf.org/viaf/8", None), (3, None, "https://viaf.org/viaf/5")],
        "gbifID long, recordedByID string, identifiedByID string")
    users = spark.createDataFrame([(8, None, "Q8"), (9, None, "Q9")], "id long, orcid string, wikidata string")
    claims = spark.createDataFrame([], "user_id long, occurrence_id long, action string, created_by long")
    destroyed = spark.createDataFrame([], "identifier string, redirect_to string")
    rows = lambda *a: sorted((r.user_id, r.occurrence_id) for r in
                             B.import_source_claims(occ, users, claims, destroyed, *a).collect())
    assert rows() == [(9, 1)]
    known = spark.createDataFrame([("viaf", "5", "Q8")], "authority string, id string, wikidata string")
    assert rows(known) == [(8, 3), (9, 1)]
