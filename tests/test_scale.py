"""Whole results of queries whose plan was changed for size, against plain versions on rows made here."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from herbaria.operators import aggs, joins as J, matching as T, mutate as M, search as SE, sets as X, shared as SH
from herbaria.plans.catalog import QUERIES
from herbaria.sources import downloads as DL
from herbaria.sources import packages as PK


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_g12_article_counts_every_citation(spark, tmp_path):
    """F16: part 5 is claimed under another id, its citations and agent links count all the same."""
    spark.createDataFrame([(1, 5, 2, "N"), (1, 6, 2, "A"), (1, 5, 2, "A")], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(QUERIES["G12_agent_counts_article"](spark, str(tmp_path))) == [(2, 3, 3)]


def test_g25_report_has_the_valid_years(spark):
    """years outside the valid range stand in the range as written, not in the first and last year."""
    links = spark.createDataFrame([(1, i, True) for i in range(4)], "agent_id long, occurrence_id long, agent_role boolean")
    occ = spark.createDataFrame([(0, "f", "c", "1700"), (1, "f", "c", "1950"), (2, "g", "c", "1990-05"), (3, None, None, None)],
                                "gbifID long, family string, institutionCode string, year string")
    got = aggs.recorder_report(links, occ, "2002-01-01").collect()[0]
    assert (got.n, got.event_range, got.min_year, got.max_year, got.families) == (4, "1700–1990-05", 1950, 1990, "f | g")


def test_j31_pairs_come_once(spark):
    """each pair once, though people share several organisations, with none of the pairs compared afterwards."""
    rnd = random.Random(1)
    members = [(rnd.randrange(30), rnd.randrange(8)) for _ in range(90)] * 2 + [(None, 1), (31, None), (32, None)]
    uo = spark.createDataFrame(members, "user_id long, organization_id long")
    want = sorted({(u, v) for u, o in members for v, p in members if o == p and o is not None and None not in (u, v) and u != v}, key=repr)
    out = J.same_organization_people(uo)
    assert rows(out, "user_id", "other_id") == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")


def _candidate_tables(spark):
    rnd = random.Random(2)
    pa = [(rnd.randrange(6), rnd.randrange(5)) for _ in range(20)] + [(None, 1), (7, None)]
    oa = [(rnd.choice([*range(12), None]), rnd.randrange(5), rnd.random() < .5) for _ in range(60)]
    cl = [(rnd.randrange(7), rnd.choice([*range(12), None])) for _ in range(40)]
    return (pa, oa, cl, spark.createDataFrame(pa, "user_id long, agent_id long"),
            spark.createDataFrame(oa, "occurrence_id long, agent_id long, agent_role boolean"),
            spark.createDataFrame(cl, "user_id long, occurrence_id long"))


def test_j25_candidates_are_shuffled_no_more(spark):
    """the rows of the plain anti join, made by the last join; repeats and nulls as there."""
    pa, oa, cl, people, links, claims = _candidate_tables(spark)
    want = sorted(((u, o, a) for u, a in pa for o, b, _ in oa if a == b and (u is None or o is None or (u, o) not in cl)), key=repr)
    out = J.unclaimed_candidates(people, links, claims)
    assert rows(out, "user_id", "occurrence_id", "agent_id") == want
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_t2_scores_equal_names_once(spark):
    """people and agents of one name get the score of the name, repeats of an id add up."""
    users = spark.createDataFrame([(i, "Smith", "John", None, None, None, None) for i in (1, 2, 2)] + [(None, "Smith", "Jane", None, None, None, None)],
                                  "id long, family string, given string, particle string, orcid string, label string, other_names string")
    empty = ["particle", "appellation", "title", "suffix", "nick", "dropping_particle"]
    agents = spark.createDataFrame([(10, "Smith", "J. A.", ""), (11, "Smith", "J. A.", ""), (12, "Smith", "John", "")],
                                   "id long, family string, given string, unparsed string").withColumns({c: F.lit(None).cast("string") for c in empty})
    got = {(r.user_id, r.agent_id): r.score for r in T.match_agents(T.name_variants(users), agents).collect()}
    one = {a: got[1, a] for a in (10, 11, 12)}
    assert one[10] == one[11] < one[12]
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, a): 2 * one[a] for a in one}
    assert len(got) == 9


def test_g37_counts_without_listing_candidates(spark):
    """The counts of the listed candidates, from link counts, claimed candidates and shared agent sets."""
    pa, oa, cl, people, links, claims = _candidate_tables(spark)
    listed = {(u, a, o) for u, a in pa for o, b, _ in oa if a == b and (u is None or o is None or (u, o) not in cl)}
    by_agent, by_person = {}, {}
    for u, a, o in listed:
        by_agent[u, a] = by_agent.get((u, a), 0) + 1
    for u, o in {(u, o) for u, _, o in listed}:
        by_person[u] = by_person.get(u, 0) + 1
    got = aggs.unattributed_by_agent(people, links, claims)
    assert {(r.user_id, r.agent_id): r.n for r in got.collect()} == by_agent
    assert {r.user_id: r.n for r in aggs.unattributed_counts(people, links, claims).collect()} == by_person


def test_t7_equal_queries_are_answered_once(spark, monkeypatch):
    """one answer per text goes to every query of it; a query given twice still scores twice."""
    fields = spark.createDataFrame([("agent", str(i), "family", w, 3.0) for i, w in enumerate(["smith", "smithers", "jones"])],
                                   "entity string, id string, field string, text string, weight double")
    asked = []
    blocks = SE.join_in_blocks
    monkeypatch.setattr(SE, "join_in_blocks", lambda a, b, key: asked.append((a, b)) or blocks(a, b, key))
    queries = [("a", "agent", "smith"), ("b", "agent", "smith"), ("c", "agent", "smith"), ("c", "agent", "smith"), ("d", "agent", None)]
    got = {}
    for r in SE.find(spark.createDataFrame(queries, "query_id string, entity string, text string"), SE.build_index(fields), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(got["a"]) == sorted(got["b"]) and [x[1] for x in sorted(got["a"])] == ["0", "1"]
    assert sorted(got["c"]) == [(n, i, pytest.approx(2 * x, abs=1e-8)) for n, i, x in sorted(got["a"])] and "d" not in got
    assert asked[0][0].select("query_id").distinct().count() == 2
    assert {r.token for r in asked[0][1].select("token").collect()} == {"smith"}


def test_m2_rows_are_dealt_once(spark):
    """the claims of the plain plan, with one exchange by person and occurrence."""
    pa, oa, cl, people, links, claims = _candidate_tables(spark)
    requests = people.withColumn("ignore", F.coalesce(F.col("user_id") % 2 == 0, F.lit(False))).withColumn("created_by", F.lit(1).cast("long"))
    want = {}
    for u, a in pa:
        for o, b, r in oa:
            if a == b and (u is None or o is None or (u, o) not in cl):
                want.setdefault((u, o), set()).add(r)
    action = {(True,): "recorded", (False,): "identified", (False, True): "recorded,identified"}
    out = M.bulk_claim(requests, links, claims)
    got = {(r.user_id, r.occurrence_id): (r.action, r.visible) for r in out.collect()}
    hidden = lambda u: u is not None and u % 2 == 0
    assert got == {k: (None, False) if hidden(k[0]) else (action[tuple(sorted(v))], True) for k, v in want.items()}
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_downloads_are_written_in_bundles(spark, tmp_path):
    """files follow the write tasks, not the downloads; each download keeps its own header."""
    rnd = random.Random(3)
    kept = [(f"k{i % 300}", rnd.randrange(50), "PRESERVED_SPECIMEN") for i in range(900)]
    out = [(f"k{i % 300}", 100 + i, "HUMAN_OBSERVATION") for i in range(300)] + [("k1", None, "PRESERVED_SPECIMEN")]
    DL.write_downloads(spark.createDataFrame(kept + out, "key string, gbifID long, basisOfRecord string"), f"{tmp_path}/d")
    assert len(glob.glob(f"{tmp_path}/d/**/*.txt", recursive=True)) <= 8
    got = DL.scan_downloads(spark, f"{tmp_path}/d", glob="*.txt", bundled=True)
    assert rows(got, "key", "occurrence_id") == sorted({k[:2] for k in kept}, key=repr)


def test_bundled_headers_hold_for_their_download(spark, tmp_path):
    """Headers differ within a bundle and between bundles; a download without an id column gives nothing."""
    (tmp_path / "a.tsv").write_text("1\tbasisOfRecord\tgbifID\n1\tHUMAN_OBSERVATION\t11\n1\tX\t12\n1\tX\t12\n2\tgbifid\n2\t21\n2\t\n\n3\tname\n3\t5\n")
    (tmp_path / "b.tsv").write_text("1\tgbifID\tbasisOfRecord\n1\t13\tX\n1\tX\t14\n")
    assert rows(DL.scan_downloads(spark, str(tmp_path), bundled=True), "key", "occurrence_id") == [("1", 12), ("1", 13), ("2", 21)]


@pytest.mark.parametrize("pack, met", [(256, 250_000), (2, 5)])
def test_j27_co_collectors_travel_in_packs(spark, monkeypatch, pack, met):
    """the rows of the plain plan, nulls and occurrences in parts included; pairs are not shuffled to be made distinct."""
    monkeypatch.setattr(J, "PACK", pack)
    monkeypatch.setattr(J, "MET", met)
    rnd = random.Random(4)
    made = [(rnd.choice([*range(9), None]), rnd.choice([*range(14), None]), rnd.choice(["recorded", "recorded", "identified", None]), rnd.random() < .9)
            for _ in range(50)] * 2
    rec = {(o, u) for o, u, a, v in made if a == "recorded" and v}
    edges = {(u, w) for o, u in rec for p, w in rec if o == p and o is not None and None not in (u, w) and u != w}
    want = {(o, w) for o, u in rec for c, w in edges if c == u and (o is None or (o, w) not in rec)}
    out = J.collector_network(spark.createDataFrame(made, "occurrence_id long, user_id long, action string, visible boolean"))
    assert want and rows(out, "occurrence_id", "user_id") == sorted(want, key=repr)
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_n4_k13_rank_shared_lists_once(spark, monkeypatch):
    """people with equal agents share one ranking; claims taken off leave the positions of the plain ranking."""
    from herbaria.operators import pairs, paging as PG
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rnd = random.Random(5)
    scores = [(u, a, float(a * 7 % 5)) for u in range(6) for a in range(8) if (a + u % 3) % 3] + [(0, 1, 9.0), (1, 1, 0.0), (None, 1, 1.0), (9, None, 1.0), (8, 77, 1.0)]
    links = [(rnd.choice([*range(25), None]), rnd.randrange(8), rnd.random() < .5) for _ in range(80)]
    claims = [(rnd.randrange(6), rnd.choice([*range(25), None])) for _ in range(40)]
    kinds = {o: rnd.choice([None, "a", "b"]) for o in range(22)}
    best = {}
    for u, a, s in scores:
        for o, b, _ in links:
            if a == b and None not in (u, o) and o in kinds and (u, o) not in claims:
                best[u, o] = max(best.get((u, o), s), s)
    want = []
    for u in range(6):
        mine = sorted(((s, kinds[o] or "", o) for (v, o), s in best.items() if v == u), reverse=True)
        want += [(u, o, i + 1) for i, (_, _, o) in enumerate(mine)]
    occ = spark.createDataFrame([(o, t, f"n{o}") for o, t in kinds.items()], "gbifID long, typeStatus string, recordedBy string")
    people, ranking = PG.shared_ranking(spark.createDataFrame(scores, "user_id long, agent_id long, score double"),
                                        spark.createDataFrame(links, "occurrence_id long, agent_id long, agent_role boolean"), occ)
    own = spark.createDataFrame(claims, "user_id long, occurrence_id long")
    assert people.select("list").distinct().count() < people.count()
    assert rows(PG.unclaimed_ranking(people, ranking, own), "user_id", "occurrence_id", "position") == sorted(want, key=repr)
    wide = PG.unclaimed_ranking(people, ranking, own, PG.candidate_rows(ranking, occ, ["recordedBy"]))
    assert rows(wide, "user_id", "gbifID", "position", "recordedBy") == sorted(((u, o, p, f"n{o}") for u, o, p in want), key=repr)


def test_members_meet_in_packs(spark, monkeypatch):
    """Rows of the plain joins with repeats and nulls, hot articles and occurrences in parts."""
    from herbaria.operators import exports as K, pairs
    for name, size in (("PACK", 3), ("GATHERED", 4), ("BLOCK", 3)):
        monkeypatch.setattr(pairs, name, size)
    rnd = random.Random(8)
    cited = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice([*range(9), None])) for _ in range(50)]
    claims = [(rnd.choice([*range(7), None]), rnd.choice([0, 0, 0, *range(12), None]), rnd.random() < .8) for _ in range(70)]
    scope = spark.createDataFrame(cited, "article_id long, occurrence_id long")
    table = spark.createDataFrame(claims, "user_id long, occurrence_id long, visible boolean")
    met = [(a, u) for a, o in cited for u, p, v in claims if v and o is not None and o == p]
    want = sorted({(a, u, met.count((a, u))) for a, u in met}, key=repr)
    assert rows(aggs.article_user_counts(scope, table), "article_id", "user_id", "n") == want
    assert rows(J.people_of(scope, table, small=True), "article_id", "user_id") == [w[:2] for w in want]
    articles = spark.createDataFrame([(1, "a", None), (2, "b", "t"), (2, "c", "t"), (9, "d", "t")], "id long, doi string, citation string")
    dois = sorted(((u, a, d) for a, u, _ in want for b, d in ((1, "a"), (2, "b"), (2, "c")) if a == b), key=repr)
    assert rows(J.articles_citing(articles, table, scope), "user_id", "id", "doi") == dois
    got = rows(K.article_counts(table, scope, articles, "https://x/"), "article_id", "user_id", "num_specimens", "doi")
    assert got == sorted(((a, u, n, d) for a, u, n in want for v, b, d in dois if (v, b) == (u, a)), key=repr)
    links = table.withColumnRenamed("user_id", "agent_id").withColumn("agent_role", F.col("visible"))
    agents = spark.createDataFrame([(i, "f" if i % 3 else "") for i in range(7)], "id long, family string")
    plain, packed = (aggs.agent_counts(scope, links, agents, small=s) for s in (False, True))
    assert rows(plain, *packed.columns) == rows(packed)
    plain, packed = (J.agents_of(scope, links, agents, True, small=s) for s in (False, True))
    assert rows(plain, *packed.columns) == rows(packed)
    shuffles = J.people_of(scope, table, small=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in shuffles and not shuffles.lstrip().startswith("Aggregate")  # no row per article and person is compared


def test_b8_table_is_computed_once(spark, tmp_path):
    """the rows of a package table are made once, not once more to learn its size; files keep the bound."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.createDataFrame([(i, None if i == 7 else f"d{i % 3}") for i in range(70)], "n long, datasetKey string")
    path = str(tmp_path / "t")
    PK.write_table(df.mapInPandas(count, "n long, datasetKey string"), path, 10)
    assert made.value == 70
    back = PK.read_table(spark, path, ["n"])
    assert rows(back, "dataset", "n") == sorted(((f"d{i % 3}", str(i)) for i in range(70) if i != 7), key=repr)
    assert max(r["count"] for r in back.groupBy("file").count().collect()) <= 10


@pytest.mark.parametrize("block", [2, 2048])
def test_j14_pairs_are_unfolded_from_lists(spark, monkeypatch, block):
    """pairs with repeats come out of a list per block, small and large groups alike."""
    from herbaria.operators import pairs
    monkeypatch.setattr(pairs, "BLOCK", block)
    people = [(1, "A", "x"), (2, "A", "X y"), (2, "A", "x"), (None, "A", "x"), (3, "A", "z"), (4, "", "x"), (5, None, "x"), (6, "A", ""), (7, "A", None),
              *[(10 + i, "B", "q") for i in range(9)]]
    df = spark.createDataFrame(people, "id long, family string, given string")
    for first in (True, False):
        same = lambda p, q: p[1] == q[1] and (not first or bool(p[2]) and bool(q[2]) and p[2][0].lower() == q[2][0].lower())
        want = sorted(((p[0], q[0], p[1]) for p in people for q in people if p[1] and same(p, q) and None not in (p[0], q[0]) and p[0] != q[0]), key=repr)
        out = J.same_family(df, first_initial=first)
        assert rows(out) == want
        assert "explode(_list" in out._jdf.queryExecution().optimizedPlan().toString()


def test_k10_wide_columns_come_last(spark):
    """claims meet their articles before the specimen columns, which join last; repeats and nulls as in plain joins."""
    from herbaria.operators import exports as K
    from herbaria.operators.packages import PACKAGE_OCCURRENCE_COLUMNS
    claims = [(1, 5, True), (1, 5, True), (2, 5, False), (3, 6, True), (4, None, True), (5, 9, True)]
    cites = [(70, 5), (71, 5), (71, 6), (72, 6), (70, 9), (70, None)]
    occ = spark.createDataFrame([(5,), (6,), (None,)], "gbifID long").select("gbifID", *[F.concat(F.lit(c), "gbifID").alias(c) for c in PACKAGE_OCCURRENCE_COLUMNS])
    out = K.article_specimens(spark.createDataFrame(claims, "user_id long, occurrence_id long, visible boolean"), spark.createDataFrame(cites, "article_id long, occurrence_id long"),
                              spark.createDataFrame([(70, "x"), (71, "y")], "id long, doi string"), occ)
    want = sorted(((u, {70: "x", 71: "y"}[a], o, f"license{o}") for u, o, v in claims for a, p in cites if v and o == p and o in (5, 6) and a < 72), key=repr)
    assert rows(out, "user_id", "used_in_doi", "gbifID", "license") == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("catalogNumber") > plan.rindex("used_in_doi")


def test_j13_pairs_travel_as_lists(spark, monkeypatch):
    """each pair once, repeats, nulls and cut agents alike, with none of the pairs compared one by one."""
    from herbaria.operators import pairs
    rnd = random.Random(13)
    links = [(rnd.choice([*range(9), None]), rnd.choice([*range(12), None]), rnd.choice([True, False, None])) for _ in range(80)] * 2
    want = sorted({(a, b) for o, a, r in links for p, b, _ in links if r and o == p and o is not None and None not in (a, b) and a != b})
    df = spark.createDataFrame(links, "occurrence_id long, agent_id long, agent_role boolean")
    assert rows(J.agents_recorded_with(df)) == sorted(want, key=repr)
    assert not J.agents_recorded_with(df)._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate")
    monkeypatch.setattr(pairs, "GATHERED", 3)
    monkeypatch.setattr(pairs, "PACK", 2)
    assert rows(J.agents_recorded_with(df)) == sorted(want, key=repr)


def test_m7_log_is_made_from_the_written_claims(spark):
    """the log comes from a claims table as given, so the claims behind it are not derived once per kind of change."""
    from herbaria.plans.q_features import _change_log
    claims = spark.createDataFrame([(u, o, "recorded", True, 1) for u in range(9) for o in (-3, 4, 8)],
                                   "user_id long, occurrence_id long, action string, visible boolean, created_by long")
    log = rows(_change_log(claims), "seq", "op", "user_id", "occurrence_id")
    h = {(u, o): u * 31 + abs(o) for u in range(9) for o in (-3, 4, 8)}
    new = lambda o: abs(o) + 1_000_000_007
    kinds = [(1, "update", 5, 0, 0), (2, "hide", 7, 0, 0), (3, "delete", 11, 0, 0), (4, "insert", 3, 0, 0), (5, "update", 4, 0, 0),
             (1, "insert", 6, 1, 1), (2, "hide", 12, 1, 1), (3, "delete", 18, 1, 1), (4, "update", 24, 1, 1)]
    assert log == sorted(((q, op, u, new(o) if fresh else o) for q, op, n, r, fresh in kinds for (u, o), v in h.items() if v % n == r), key=repr)


def test_b2_names_are_worked_out_once(spark, monkeypatch):
    """jobs with the same names share one parse and key; missing names and lists as before."""
    from herbaria.operators import enrich as U
    from herbaria.plans import jobs as B
    one, two = '[{"family":"A","given":"B"}]', '[{"family":"A","given":"B"},{"family":"C","given":"D"}]'
    data = [("1", "B A", [1, 2, 2], [5], one), ("2", "B A", [2, 0, -1], [], one), ("3", "B A; D C", [7], None, two), ("4", None, [8], [9], None),
            ("5", "x  y", None, [3], "not json"), ("6", "x  y", [3], [3], "not json"), ("7", None, [8], [9], None)]
    asked = []
    plain = U.expand_names
    monkeypatch.setattr(U, "expand_names", lambda jobs: asked.append(jobs) or plain(jobs))
    agents, links = B.agent_build(spark.createDataFrame(
        data, "id string, agents string, gbifIDs_recordedBy array<long>, gbifIDs_identifiedBy array<long>, parsed string"))
    assert asked[0].count() == 4  # of seven jobs
    name = {r.agent_id: (r.family, r.unparsed) for r in agents.collect()}
    a, c, n, x = ("A", ""), ("C", ""), ("", ""), ("", "x y")
    assert sorted(((*name[i], r, o) for i, r, o in rows(links, "agent_id", "agent_role", "occurrence_id"))) == sorted(
        [(*a, True, 1), (*a, True, 2), (*a, False, 5), (*a, True, 7), (*c, True, 7), (*n, True, 8), (*n, False, 9), (*x, False, 3), (*x, True, 3)])


def test_x1_copies_are_dealt_before_they_are_sorted(spark):
    """the wide rows of an input split are not sorted as a whole; the first row per key stays the same one."""
    rnd = random.Random(36)
    raw = [(rnd.choice([*range(5), None]), rnd.choice([1, 2, 3, None]), rnd.randrange(2), rnd.choice("abc")) for _ in range(90)]
    out = X.dedupe_occurrences(spark.createDataFrame(raw, "gbifID long, a long, b long, t string"), ["a", "b"])
    none_first = lambda r: [(v is not None, v) for v in r]
    assert rows(out) == sorted((min((r for r in raw if r[0] == k), key=none_first) for k in {r[0] for r in raw}), key=repr)
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()


def _people_of_one_name(spark):
    """Thirty people, most of them with the same agents; repeats, and missing ids on every side."""
    rnd = random.Random(9)
    pa = [(u, a) for u in [*range(24), None] for a in (0, 1, 1, 2)] + [(u, rnd.randrange(5)) for u in range(24, 30)] + [(7, 4), (8, None)]
    oa = [(rnd.choice([*range(40), None]), rnd.choice([*range(5), None]), rnd.random() < .5) for _ in range(150)]
    cl = [(rnd.choice([*range(30), None]), rnd.choice([*range(44), None])) for _ in range(300)]
    return (pa, oa, cl, spark.createDataFrame(pa, "user_id long, agent_id long"),
            spark.createDataFrame(oa, "occurrence_id long, agent_id long, agent_role boolean"),
            spark.createDataFrame(cl, "user_id long, occurrence_id long"))


def _listed_for(monkeypatch):
    """Lists that the links are met with."""
    found, listed = [], SH.listed_links
    monkeypatch.setattr(SH, "listed_links", lambda lists, links: found.append({bytes(r[0]) for r in lists.select("list").collect()}) or listed(lists, links))
    return found


@pytest.mark.parametrize("stretch", [8192, 3])
def test_j25_lists_are_made_once_for_people_with_the_same_agents(spark, monkeypatch, stretch):
    """the rows of the plain anti join, made from one list per set of agents, in packs."""
    monkeypatch.setattr(SH, "STRETCH", stretch)
    pa, oa, cl, people, links, claims = _people_of_one_name(spark)
    want = sorted(((u, o, a) for u, a in pa for o, b, _ in oa if a is not None and a == b and (u is None or o is None or (u, o) not in cl)), key=repr)
    found = _listed_for(monkeypatch)
    assert rows(J.unclaimed_candidates(people, links, claims), "user_id", "occurrence_id", "agent_id") == want
    sets = {u: tuple(sorted((a for v, a in pa if v == u), key=repr)) for u, _ in pa}
    assert len(found[0]) == len(set(sets.values())) < len(sets)


@pytest.mark.parametrize("stretch", [8192, 3])
def test_m2_claims_are_made_once_for_people_with_the_same_requests(spark, monkeypatch, stretch):
    """F2, F8: the claims of the plain plan, two requests of one occurrence included."""
    monkeypatch.setattr(SH, "STRETCH", stretch)
    pa, oa, cl, people, links, claims = _people_of_one_name(spark)
    asked = [(u, a, bool(u is not None and u % 5 == 0), 1 + (a or 0) % 2) for u, a in pa]
    want = {}
    for u, a, ignore, by in asked:
        for o, b, r in oa:
            if a is not None and a == b and (u is None or o is None or (u, o) not in cl):
                want.setdefault((u, o), {}).setdefault((by, ignore), set()).add(r)
    action = {(True,): "recorded", (False,): "identified", (False, True): "recorded,identified"}
    first = lambda got: min((by, "" if ignore else action[tuple(sorted(r))], not ignore) for (by, ignore), r in got.items())
    found = _listed_for(monkeypatch)
    out = M.bulk_claim(spark.createDataFrame(asked, "user_id long, agent_id long, ignore boolean, created_by long"), links, claims)
    assert rows(out) == sorted(((u, o, first(g)[1] or None, first(g)[2], first(g)[0]) for (u, o), g in want.items()), key=repr)
    assert len(found[0]) < len({u for u, _ in pa})


def test_m2_counts_are_not_made_distinct_again(spark):
    """rows of M2 hold an occurrence of a person once; other rows are still counted distinct."""
    pa, oa, cl, people, links, claims = _people_of_one_name(spark)
    out = M.bulk_claim(people.selectExpr("*", "false as ignore", "1L as created_by"), links, claims)
    counts = M.bulk_claim_counts(out, distinct=False)
    assert rows(counts) == rows(M.bulk_claim_counts(out))
    assert "count(distinct" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()
    twice = out.unionByName(out)
    assert rows(M.bulk_claim_counts(twice)) == rows(counts)


@pytest.mark.parametrize("stretch", [8192, 2])
def test_g37_counts_travel_to_people_with_the_same_agents(spark, monkeypatch, stretch):
    """the counts of the listed candidates; a claim meets the links of one list per set of agents."""
    monkeypatch.setattr(SH, "STRETCH", stretch)
    pa, oa, cl, people, links, claims = _people_of_one_name(spark)
    listed = {(u, a, o) for u, a in pa for o, b, _ in oa if a is not None and a == b and (u is None or o is None or (u, o) not in cl)}
    found = _listed_for(monkeypatch)
    want = sorted(((u, a, len({o for v, b, o in listed if (v, b) == (u, a)})) for u, a in {(u, a) for u, a, _ in listed}), key=repr)
    assert rows(aggs.unattributed_by_agent(people, links, claims)) == want
    want = sorted(((u, len({o for v, _, o in listed if v == u})) for u in {u for u, _, _ in listed}), key=repr)
    assert rows(aggs.unattributed_counts(people, links, claims)) == want
    assert all(len(f) < len({u for u, _ in pa}) for f in found) and found


@pytest.mark.parametrize("pack", [4096, 3])
def test_rankings_travel_in_packs(spark, pack):
    """places between a person's claims keep their order in any pack; repeated and missing wide rows as in a plain join."""
    from herbaria.operators import paging as PG
    rnd = random.Random(11)
    people = [(u, b"a" if u % 3 else b"b") for u in range(9)] + [(9, b"none")]
    order = {b"a": rnd.sample(range(20), 17), b"b": rnd.sample(range(20), 6)}
    claims = [(rnd.choice([*range(10), None]), rnd.choice([*range(24), None])) for _ in range(70)] + [(1, o) for o in order[b"a"]]
    ranking = spark.createDataFrame([(k, o, i + 1) for k, v in order.items() for i, o in enumerate(v)], "user_id binary, occurrence_id long, position long")
    wide = [(o, f"n{o}") for o in range(20) if o != 4] + [(7, "again")]
    table, names = spark.createDataFrame(people, "user_id long, list binary"), spark.createDataFrame(wide, "occurrence_id long, name string")
    own = spark.createDataFrame(claims, "user_id long, occurrence_id long")
    want = [(u, i + 1, o) for u, k in people for i, o in enumerate([o for o in order.get(k, []) if (u, o) not in claims])]
    assert rows(PG.unclaimed_ranking(table, ranking, own, pack=pack), "user_id", "position", "occurrence_id") == sorted(want, key=repr)
    got = PG.unclaimed_ranking(table, ranking, own, ranking.join(names, "occurrence_id"), pack)
    assert rows(got, "user_id", "position", "occurrence_id", "name") == sorted(((u, p, o, n) for u, p, o in want for q, n in wide if o == q), key=repr)


def test_t4_specimens_name_lists_of_people(spark, monkeypatch):
    """the specimens of the plain network; one that its first collector does not settle asks all, and agents bring lists."""
    from herbaria.operators import candidates as C
    rnd = random.Random(13)
    claims = [(rnd.choice([*range(1, 14), None]), rnd.choice([*range(16), None]), rnd.choice(["recorded", "recorded", "identified", None]), rnd.random() < .9) for _ in range(60)]
    links = [(rnd.choice([*range(16), None]), rnd.choice([*range(7), None]), rnd.random() < .8) for _ in range(50)]
    scores = [(u, a, 60.0) for u in (4, 5, 6) for a in (1, 2, 2)] + [(rnd.choice([*range(4, 14), None]), rnd.randrange(7), rnd.choice([60.0, 40.0])) for _ in range(12)]
    rec = {(o, u) for u, o, act, seen in claims if act == "recorded" and seen and None not in (u, o)}
    of = lambda o: {u for p, u in rec if p == o}
    net = {c: {u for o, v in rec if v == c for u in of(o)} - {c} for _, c in rec}
    hit, first = set(), set()
    for o in range(16):
        likely = {u for p, a, r in links if p == o and r for u, b, s in scores if a == b and s > 50} - of(o)
        if likely & set().union(*[net[c] for c in of(o)]):
            hit.add(o)
            first |= {o} if likely & net[min(of(o))] else set()
    want = sorted(((o,) for o in hit if len(set().union(*[net[c] for c in of(o)])) > 1), key=repr)
    assert want and hit - first
    named, hits = [], C._hits
    monkeypatch.setattr(C, "_hits", lambda n, *rest: named.append(n.columns) or hits(n, *rest))
    counts = spark.createDataFrame([(o, 2, 3) for o in range(16)], "occurrence_id long, user_count long, agent_count long")
    got = C.occurrence_has_candidate(counts, spark.createDataFrame(claims, "user_id long, occurrence_id long, action string, visible boolean"),
                                     spark.createDataFrame(links, "occurrence_id long, agent_id long, agent_role boolean"),
                                     spark.createDataFrame(scores, "user_id long, agent_id long, score double"), 50.0)
    assert rows(got, "occurrence_id") == want
    assert named[0] == ["occurrence_id", "list"]


def test_t7_documents_are_read_once(spark, tmp_path):
    """fields and postings are written when the index is made, so a search reads no document again."""
    path = f"{tmp_path}/fields"
    spark.createDataFrame([("agent", str(i), "family", w, 3.0) for i, w in enumerate(["smith", "smithers", None, "jones"])],
                          "entity string, id string, field string, text string, weight double").write.parquet(path)
    index = SE.build_index(spark.read.parquet(path))
    assert not [f for f in index.inputFiles() if "fields" in f]
    got = SE.find(spark.createDataFrame([("a", "agent", "smith")], "query_id string, entity string, text string"), index, 5)
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [("0", 1), ("1", 2)]
