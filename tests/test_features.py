"""Features against plain versions on small tables: pair blocks, change log, pages, counters, identity,
downloads, search, packages, profiles, candidates."""

import datetime as dt
import glob
import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from herbaria.functions import scalars as S
from herbaria.operators import aggs, candidates as C, changes as CH, counters as CO, exports as K, identity as ID
from herbaria.operators import joins as J, matching as T, mutate as M, paging as PG, pairs, profiles as PR, search as SE
from herbaria.sources import downloads as DL, packages as PK
from herbaria.sources.testdata import AS_OF, Model


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# -- pair blocks ----------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 50])
def test_blocks_give_the_plain_join(spark, block):
    rnd = random.Random(block)
    left = [(rnd.choice([1, 1, 1, 2, 3, None]), i) for i in range(60)] + [(9, 1)]
    right = [(rnd.choice([1, 1, 2, 2, 4, None]), -i, "x") for i in range(40)] * 2
    a = spark.createDataFrame(left, "k long, a long")
    b = spark.createDataFrame(right, "k long, b long, t string")
    assert rows(pairs.join_in_blocks(a, b, "k", block), "k", "a", "b", "t") == rows(a.join(b, "k"), "k", "a", "b", "t")
    assert pairs.join_in_blocks(a.limit(0), b, "k", block).count() == 0


def test_hot_occurrence_is_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 100)
    claims = spark.range(1200).select(F.col("id").alias("user_id"), F.lit(5).cast("long").alias("occurrence_id"),
                                      F.lit("recorded").alias("action"), F.lit(True).alias("visible"))
    a = claims.select("occurrence_id", "user_id")
    met = pairs.join_in_blocks(a, a.withColumnRenamed("user_id", "other_id"), "occurrence_id")
    spread = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in spread) == 1200 ** 2
    assert len(spread) > 3 and max(r["count"] for r in spread) < 1200 ** 2 / 2
    assert J.recorded_with(claims).filter("shared = 1").count() == 1200 * 1199


# -- change log -------------------------------------------------------------------

def fold(claims, log):
    state = {c[:2]: c[2:] for c in claims}
    for seq, op, u, o, action, visible, by in sorted(log):
        key = (u, o)
        if op == "delete":
            state.pop(key, None)
        elif op == "hide":
            state[key] = (None, False, by)
        elif (op == "insert") != (key in state):
            state[key] = (action, visible, by)
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


def random_changes(seed, people=range(1, 9)):
    rnd = random.Random(seed)
    claims = [(u, o, rnd.choice(["recorded", "identified"]), True, u) for u in people for o in range(1, 8) if rnd.random() < 0.5]
    log, n = [], 0
    for u in people:
        for o in range(1, 9):
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                n += 1
                op = rnd.choice(CH.OPS)
                log.append((n, op, u, o, None if op in ("hide", "delete") else f"a{n}", op != "hide", rnd.randint(1, 5)))
    rnd.shuffle(log)
    return claims, log


CLAIM = "user_id long, occurrence_id long, action string, visible boolean, created_by long"
LOG = "seq long, op string, " + CLAIM


def test_changes_fold_in_order(spark):
    for seed in range(4):
        claims, log = random_changes(seed)
        got = CH.apply_changes(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(log, LOG))
        assert rows(got) == fold(claims, log)
    claims, _ = random_changes(1)
    assert rows(CH.apply_changes(spark.createDataFrame(claims, CLAIM), spark.createDataFrame([], LOG))) == sorted(claims)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    claims, log = random_changes(7, range(1, 30))
    few = {3, 4}
    log = [c for c in log if c[2] in few] + [(10_000 + i, "delete", 5, o, None, None, None) for i, o in enumerate(range(1, 10))]
    path = str(tmp_path / "claims")
    CH.write_claims(spark.createDataFrame(claims, CLAIM), path, 8)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    touched = CH.apply_to_table(spark, path, spark.createDataFrame(log, LOG), 8)
    assert 0 < len(touched) <= 3
    assert rows(CH.read_claims(spark, path).drop("bucket")) == fold(claims, log)
    for f, t in before.items():
        bucket = int(f.split("bucket=")[1].split("/")[0])
        assert (os.path.exists(f) and os.path.getmtime(f) == t) == (bucket not in touched)


def test_partition_whose_claims_all_go(spark, tmp_path):
    claims = [(u, 1, "recorded", True, u) for u in range(1, 20)]
    path = str(tmp_path / "claims")
    CH.write_claims(spark.createDataFrame(claims, CLAIM), path, 8)
    log = [(1, "delete", u, 1, None, None, None) for u in range(1, 20)]
    CH.apply_to_table(spark, path, spark.createDataFrame(log, LOG), 8)
    assert CH.read_claims(spark, path).count() == 0


def test_reload_keeps_own_claims_and_names_new_people(spark):
    users = spark.createDataFrame([(7, "0000-0002-1825-0097", None, True), (8, None, "Q8", False), (9, None, "Q9", True)],
                                  "id long, orcid string, wikidata string, is_public boolean")
    claims = spark.createDataFrame([(8, 1, "identified", True, 8), (8, 2, "recorded", True, 2), (9, 3, None, False, 9)], CLAIM)
    pivot = spark.createDataFrame([("Q8", "recorded", "[1,3]"), ("Q77", "recorded", "[4]"), ("Q6", "recorded", "[5]"), ("Q5", "recorded", "[6]"),
                                   ("junk", "recorded", "[7]"), ("Q8", "identified", "[3]")], "identifier string, action string, occurrence_ids string")
    destroyed = spark.createDataFrame([("Q6", "Q9"), ("Q5", None)], "identifier string, redirect_to string")
    out = CH.reload_source_claims(claims, pivot, users, destroyed)
    assert rows(out["claims"]) == sorted([(8, 1, "identified", True, 8), (9, 3, None, False, 9), (8, 3, "recorded", True, 2), (9, 5, "recorded", True, 2)], key=repr)
    assert rows(out["new_people"]) == [("Q77",)] and rows(out["made_public"]) == [(8,)]


# -- pages and ranks -----------------------------------------------------------------

def test_pages_and_ranks(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randint(0, 9), rnd.choice(["a", "a", "a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v int, g string").repartition(7)
    order = [F.desc("v"), F.asc("id")]
    want = sorted(data, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in sorted(PG.ranked(df, order).collect(), key=lambda r: r.position)] == [r[0] for r in want]
    page = PG.page(df, order, 7, 50).collect()
    assert sorted((r.position, r.id) for r in page) == [(301 + i, r[0]) for i, r in enumerate(want[300:350])]
    assert sorted(r.id for r in PG.page(df, order, 999, 25).collect()) == sorted(r[0] for r in want[475:])
    assert PG.page(df.limit(0), order, 1, 25).count() == 0
    inside = {(r.g, r.position): r.id for r in PG.rank_within(df.filter("g is not null"), "g", order).collect()}
    for g in "ab":
        mine = [r[0] for r in want if r[2] == g]
        assert [inside[g, i + 1] for i in range(len(mine))] == mine


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 7).alias("v"))
    path = str(tmp_path / "ranked")
    PG.write_ranked(df, [F.asc("v"), F.asc("id")], path)
    assert len(glob.glob(f"{path}/rows/block=*")) > 3
    page = PG.read_page(spark, path, 30, 50, PG._schema(df))
    assert len(page.inputFiles()) >= 1 and page.count() == 50
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan or "block#" in plan
    assert len({f for r in page.select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}) <= 2


# -- counters ------------------------------------------------------------------------------

def test_changed_state_is_the_full_state(spark):
    rnd = random.Random(4)
    occ = "gbifID long, datasetKey string"
    claim = "user_id long, occurrence_id long, created_by long"
    for _ in range(3):
        old_o = [(i, rnd.choice("abc")) for i in range(40)]
        new_o = [(i, rnd.choice("bcd") if rnd.random() < 0.3 else k) for i, k in old_o if rnd.random() < 0.8] + [(100 + i, "e") for i in range(5)]
        old_c = [(u, rnd.randrange(50), rnd.choice([1, 2, 2])) for u in range(30)]
        new_c = [c for c in old_c if rnd.random() < 0.7] + [(u, rnd.randrange(110), 2) for u in range(30, 45)]
        oo, no = spark.createDataFrame(old_o, occ), spark.createDataFrame(new_o, occ)
        oc, nc = spark.createDataFrame(old_c, claim), spark.createDataFrame(new_c, claim)
        got = CO.changed_state(CO.full_state(oo, oc), oo, no, oc, nc)
        assert rows(got) == rows(CO.full_state(no, nc))


# -- identity ---------------------------------------------------------------------------------

def test_components_are_those_of_a_plain_search(spark):
    rnd = random.Random(2)
    for n, m in ((30, 15), (60, 70), (1, 0)):
        edges = [(rnd.randrange(n) * 3 - 20, rnd.randrange(n) * 3 - 20) for _ in range(m)] + [(None, 4), (7, 7)]
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for a, b in edges:
            if a is not None:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
        got = {r.node: r.component for r in ID.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root(x) for x in up}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in ID.components(chain).collect()} == {0}


def test_organizations_chain_and_conflict(spark):
    org = "id long, name string, isni string, grid string, ror string, ringgold string, wikidata string, institution_codes array<string>"
    data = [(1, "a", "i1", None, "r1", None, None, ["x"]), (2, "b", None, "g1", "r1", None, None, ["y"]), (3, "c", None, "g1", None, "5", "Q3", ["x"]),
            (4, "d", None, None, None, "9", "Q4", None), (5, "e", None, None, None, "9", "Q5", None), (6, "f", None, None, None, None, None, [])]
    members = [(10, 2), (11, 2), (12, 3), (10, 3), (13, 4), (14, 6)]
    out = ID.merge_same_organizations(spark.createDataFrame(data, org), spark.createDataFrame(members, "user_id long, organization_id long"))
    assert rows(out["mapping"]) == [(1, 2), (3, 2)]
    assert rows(out["conflicts"]) == [(4, "wikidata", 2)]
    assert rows(out["user_organizations"], "user_id", "organization_id") == [(10, 2), (11, 2), (12, 2), (13, 4), (14, 6)]
    two = [r for r in out["organizations"].collect() if r.id == 2][0]
    assert (two.isni, two.grid, two.ror, two.ringgold, two.wikidata, two.institution_codes) == ("i1", "g1", "r1", "5", "Q3", ["x", "y"])
    assert sorted(r.id for r in out["organizations"].collect()) == [2, 4, 5, 6]


def test_merges_chain_and_circle(spark):
    pairs_ = [(1, 2), (2, 3), (3, 9), (20, 21), (21, 22), (22, 20), (30, 21), (40, 40), (50, 52), (50, 51)]
    got = {r.src: r.dest for r in ID.final_destinations(spark.createDataFrame(pairs_, "src long, dest long")).collect()}
    assert got == {1: 9, 2: 9, 3: 9, 21: 20, 22: 20, 30: 20, 50: 51}


def test_refreshed_profiles_merge(spark):
    users = spark.createDataFrame([(1, "A", None, "Q1", True), (2, "B", None, "Q2", False), (3, "C", None, "Q3", False), (4, "D", "o4", None, True),
                                   (5, "E", "o5", None, True)], "id long, family string, orcid string, wikidata string, is_public boolean")
    claims = spark.createDataFrame([(1, 7, "recorded", True, 1), (3, 7, "identified", True, 3), (1, 8, "recorded", True, 1)], CLAIM)
    authority = spark.createDataFrame([(1, "A", "Q2"), (2, "B", "Q3"), (3, "Cc", "Q3"), (4, "Dd", None)], "user_id long, family string, wikidata string")
    orgs = spark.createDataFrame([(1, 100), (4, 100), (5, 100)], "user_id long, organization_id long")
    out = ID.refresh_profiles(users, claims, authority, spark.createDataFrame([(3, 200)], orgs.schema), orgs)
    assert rows(out["users"], "id", "family", "is_public") == [(3, "Cc", True), (4, "Dd", True)]
    assert rows(out["claims"], "user_id", "occurrence_id", "action", "created_by") == [(3, 7, "identified", 3), (3, 8, "recorded", 3)]
    assert rows(out["redirects"]) == [("Q1", "Q3"), ("Q2", "Q3")]
    assert rows(out["user_organizations"]) == [(3, 200), (5, 100)]


def test_merged_people_carry_the_public_flag(spark):
    users = spark.createDataFrame([(1, "o1", None, True), (2, None, "Q2", False)], "id long, orcid string, wikidata string, is_public boolean")
    claims = spark.createDataFrame([(1, 5, "recorded", True, 1)], CLAIM)
    out = M.merge_people(users, claims, spark.createDataFrame([(1, 2)], "src long, dest long"))
    assert rows(out["users"]) == [(2, None, "Q2", True)]
    assert rows(out["redirects"]) == [("o1", "Q2")] and rows(out["claims"]) == [(2, 5, "recorded", True, 2)]


def test_organization_lookup_order(spark):
    org = spark.createDataFrame([(1, "x", None, None, None, "Q1"), (2, "y", "Q1", "r", None, None), (3, None, None, "r", None, None)],
                                "id long, isni string, grid string, ror string, ringgold string, wikidata string")
    asked = spark.createDataFrame([("Q1",), ("r",), ("y",), ("?",)], "identifier string")
    assert rows(M.resolve_organization(asked, org)) == [("?", None), ("Q1", 1), ("r", 2), ("y", 2)]
    dup = M.attach_organization(spark.createDataFrame([(1, "r", None, None, None)], "row int, ror string, grid string, ringgold string, wikidata string"), org)
    assert rows(dup, "row", "organization_id", "new_org") == [(1, 2, False)]


# -- downloads -----------------------------------------------------------------------------------

def test_download_headers_differ(spark, tmp_path):
    files = {"00001": "basisOfRecord\tgbifID\tx\nPRESERVED_SPECIMEN\t11\ta\nHUMAN_OBSERVATION\t12\tb\nPRESERVED_SPECIMEN\t11\ta\n",
             "00002": "gbifid\tname\n21\tn\nnot a number\tn\n\n22\t\"open\n", "00003": "name\tother\n1\t2\n", "00004": "gbifID\n"}
    for key, text in files.items():
        (tmp_path / f"{key}.tsv").write_text(text)
    assert rows(DL.scan_downloads(spark, str(tmp_path))) == [("00001", 11), ("00002", 21), ("00002", 22)]
    articles = spark.createDataFrame([(1, ["00001", "00002"], None), (2, ["00002"], False), (3, ["00001"], True)],
                                     "id long, gbif_downloadkeys array<string>, processed boolean")
    occ = spark.createDataFrame([(11,), (22,), (30,)], "gbifID long")
    links = spark.createDataFrame([(1, 30), (1, 31), (3, 99)], "article_id long, occurrence_id long")
    out = DL.process_articles(articles, DL.scan_downloads(spark, str(tmp_path)), occ, links)
    assert rows(out["article_occurrences"]) == [(1, 11), (1, 22), (1, 30), (2, 22), (3, 99)]
    assert {r.processed for r in out["articles"].collect()} == {True}


# -- search -----------------------------------------------------------------------------------------

def test_search_scores_prefixes_and_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 5)
    docs = [("d", str(i), "title", f"museum of {w}", 3.0) for i, w in enumerate(["Müller", "mullerson", "quest", "Aue", "x", "y", "z"] * 3)]
    docs += [("d", "0", "code", "muller", 5.0), ("e", "0", "title", "museum", 1.0)]
    fields = spark.createDataFrame(docs, "entity string, id string, field string, text string, weight double")
    asked = spark.createDataFrame([(1, "d", "Museum Mull"), (2, "d", "muller"), (3, "d", " "), (4, "d", "nothing"), (5, "e", "mus")],
                                  "query_id long, entity string, text string")
    tokens = {}
    for e, i, _, text, w in docs:
        for t in text.lower().replace("ü", "u").replace("aue", "au").split():
            tokens.setdefault(e, {}).setdefault(i, {}).setdefault(t, []).append(w)
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in SE.find(asked, SE.build_index(fields), 100).collect()}

    def score(entity, i, words, last):
        total, d = 0.0, tokens[entity]
        for w in dict.fromkeys(words):
            if w in d[i]:
                total += max(d[i][w]) * math.log1p(len(d) / sum(w in x for x in d.values()))
        longer = [max(ws) for t, ws in d[i].items() if t != last and t.startswith(last)]
        if longer:
            total += 0.5 * max(longer) * math.log1p(len(d) / sum(any(t != last and t.startswith(last) for t in x) for x in d.values()))
        return total

    for q, entity, words in ((1, "d", ["museum", "mull"]), (2, "d", ["muller"]), (5, "e", ["mus"])):
        for i in tokens[entity]:
            want = score(entity, i, words, words[-1])
            assert (want > 0) == ((q, i) in got)
            if want:
                assert abs(got[q, i][0] - want) < 1e-6
    assert not [k for k in got if k[0] in (3, 4)]
    assert {i for q, i in got if q == 2 and got[q, i][1] == 1} == {"0"}


def test_fold_reaches_all_latin_letters(spark):
    df = spark.createDataFrame([("Șerban Țepeș ạ Møller",)], "n string")
    assert df.select(S.fold_name("n")).first()[0] == "serban tepes a moller"


# -- packages ------------------------------------------------------------------------------------------

def test_package_files_manifest_and_descriptor(spark, tmp_path):
    m = Model(spark, SF_SMALL)
    counts = aggs.dataset_counters(m.occurrences, m.claims)
    tables = PK.package_tables(m.occurrences, m.claims, m.users, m.article_occurrences, m.articles, counts)
    assert list(tables) == PK.RESOURCES
    root = str(tmp_path / "p")
    files = PK.build_packages(tables, root, rows_per_file=20).collect()
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "datasetKey" or "gbifID" in df.columns]
        back = PK.read_table(spark, f"{root}/{name}", columns)
        want = df.select(F.col("datasetKey").alias("dataset"), *[F.col(c).cast("string") for c in columns])
        assert rows(back, "dataset", *columns) == rows(want)
    for r in files:
        path = r.file.replace("file:", "")
        assert os.path.getsize(path) == r.bytes and hashlib.md5(open(path, "rb").read()).hexdigest() == r.hash
    sizes = [r["count"] for r in PK.read_table(spark, f"{root}/attributions", ["user_id"]).groupBy("file").count().collect()]
    assert max(sizes) < 60 and len(sizes) > 50
    listed = spark.createDataFrame(files)
    out = {r.datasetKey: r for r in PK.descriptors(listed, m.datasets, counts).collect()}
    assert sum(r.files for r in out.values()) == len(files) and sum(r.bytes for r in out.values()) == sum(f.bytes for f in files)
    assert {r.resources for r in out.values()} <= {8, 10}


def test_dataset_keys_of_any_kind(spark, tmp_path):
    keys = ["a b", "x/y", "50%", "1+1", "123", "é=ü", "Brand#2"]
    df = spark.createDataFrame([(k, i, 'say "hi",\nplease' if i % 2 else None) for i, k in enumerate(keys)], "datasetKey string, n int, t string")
    files = PK.build_packages({"users": df}, str(tmp_path / "p"))
    assert sorted(r.datasetKey for r in files.collect()) == sorted(keys)
    back = PK.read_table(spark, str(tmp_path / "p" / "users"), ["n", "t"])
    assert rows(back, "dataset", "n", "t") == sorted(((k, str(i), 'say "hi",\nplease' if i % 2 else None) for i, k in enumerate(keys)), key=repr)


# -- profiles and candidates --------------------------------------------------------------------------------

def test_profile_of_a_person_without_claims_and_of_orphans(spark):
    users = spark.createDataFrame([(3,), (4,), (5,)], "id long")
    claims = spark.createDataFrame([(3, 1, "recorded", True, 4), (3, 2, "recorded,identified", True, 3), (3, 99, "recorded", True, 3), (3, 4, None, True, 3),
                                    (3, 5, "recorded", False, 3)], CLAIM)
    day = dt.date(2001, 5, 1)
    occ = spark.createDataFrame([(1, "AA", day, 2001, None, None), (2, "??", dt.date(2050, 1, 1), 2050, day, 2001), (4, "AA", None, None, None, None),
                                 (5, "AA", day, 2001, None, None)],
                                "gbifID long, countryCode string, eventDate_processed date, eventDate_processed_year int, "
                                "dateIdentified_processed date, dateIdentified_processed_year int")
    taxa = spark.createDataFrame([(1, "Zoo"), (2, "Abe")], "occurrence_id long, family string")
    cites = spark.createDataFrame([(70, 1), (71, 1), (70, 2), (70, 5)], "article_id long, occurrence_id long")
    got = {r.user_id: r for r in PR.user_stats(users, claims, occ, taxa, cites, spark.createDataFrame([("AA",)], "code string"), dt.date(2002, 1, 1)).collect()}
    r = got[3]
    assert (r.specimens, r.recorded, r.identified, r.top_family_recorded, r.top_family_identified) == (4, 3, 1, "Abe", "Abe")
    assert (r.countries_recorded, r.recorded_bins, r.identified_bins) == ({"AA": 1}, {"2000": 1}, {"2000": 1})
    assert (r.specimens_cited, r.articles, got[4].helped, got[4].attributions) == (2, 2, 1, 1)
    assert (got[5].specimens, got[5].recorded_bins, got[5].top_family_recorded) == (0, {}, None)


def test_candidates_need_a_network_of_two(spark):
    claims = spark.createDataFrame([(1, 10, "recorded", True, 1), (2, 10, "recorded", True, 2), (1, 20, "recorded", True, 1),  # 1 and 2 met once
                                    (9, 30, "recorded", True, 9), (8, 31, "recorded", True, 8), (8, 32, "recorded", True, 8), (7, 32, "recorded", True, 7),
                                    (6, 32, "recorded", True, 6)], CLAIM)
    agents = spark.createDataFrame([(o, a, True) for o in (10, 20, 30, 31) for a in (102, 107)], "occurrence_id long, agent_id long, agent_role boolean")
    counts = spark.createDataFrame([(10, 2, 3), (20, 2, 3), (30, 2, 3), (31, 2, 3)], "occurrence_id long, user_count long, agent_count long")
    scores = spark.createDataFrame([(2, 102, 60.0), (7, 107, 60.0), (6, 102, 10.0)], "user_id long, agent_id long, score double")
    got = C.occurrence_has_candidate(counts, claims, agents, scores, 50.0)
    # 10: its agent matches person 2, who has claimed it; 20: the network of 1 is person 2 alone; 30: no network; 31: 8 met 7 and 6
    assert [r.occurrence_id for r in got.collect()] == [31]
    one = C.occurrence_has_candidate(counts, claims, agents, scores, 50.0, min_network=1)
    assert sorted(r.occurrence_id for r in one.collect()) == [20, 31]


def test_exports_keep_hidden_claims_and_both_ids(spark):
    users = spark.createDataFrame([(1, "o1", "Q1", True), (2, "o2", None, False)], "id long, orcid string, wikidata string, is_public boolean")
    claims = spark.createDataFrame([(1, 5, "recorded,identified", False, 1), (2, 5, "recorded", True, 2), (1, 6, None, True, 1)], CLAIM)
    got = rows(K.claim_triples(claims, users), "Predicate", "Object")
    assert len(got) == 2 and {o for _, o in got} == {"http://www.wikidata.org/entity/Q1"}
    known = spark.createDataFrame([("o1",)], "identifier string")
    assert rows(K.new_identifiers(users, known)) == [("Q1",)]
    both = aggs.profile_totals(users.withColumns({"visited": F.lit(True), "zenodo_doi": F.lit(None).cast("string")}))
    assert rows(both, "kind", "total") == [("orcid", 2), ("wikidata", 1)]


def test_suggestions_are_as_many_as_fellows(spark):
    claims = spark.createDataFrame([(u, 1, "recorded", True, u) for u in range(1, 4)] + [(u, 2, "recorded", True, u) for u in range(10, 40)], CLAIM)
    users = spark.range(1, 50).select("id", F.when(F.col("id") != 2, F.lit("o")).alias("orcid"))
    taxa = spark.createDataFrame([], "occurrence_id long, family string")
    orgs = spark.createDataFrame([(1, 7), (45, 7)], "user_id long, organization_id long")
    got = T.might_know(claims, taxa, orgs, users, seed=3)
    n = {r.user_id: r["count"] for r in got.groupBy("user_id").count().collect()}
    assert n == {1: 3, 3: 2, 45: 1, **{u: 5 for u in range(10, 40)}}


def test_candidate_rules(spark):
    users = spark.createDataFrame([(1, "Smith", "John", None, None, None, None)],
                                  "id long, family string, given string, particle string, label string, orcid string, other_names string")
    agent = "id long, family string, given string, particle string, appellation string, title string, suffix string, nick string, dropping_particle string, unparsed string"
    data = [(1, "Smith", "John"), (2, "Smith", "J."), (3, "Smith", "Mary"), (4, "Smyth", "John")]
    agents = spark.createDataFrame([(*d, None, None, None, None, None, None, "") for d in data], agent)
    got = {r.agent_id: r.score for r in T.candidate_agents(users, agents, 40.0).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 40


def test_lifespan_centuries(spark):
    df = spark.createDataFrame([(dt.date(2005, 1, 1), "century", dt.date(1850, 3, 4), "day"), (dt.date(1015, 1, 1), "century", None, None)],
                               "date_born date, date_born_precision string, date_died date, date_died_precision string")
    assert [r[0] for r in df.select(S.lifespan_label()).collect()] == ["21st century – March 4, 1850", "11th century – ?"]


def test_source_people_are_unique_and_valid(spark):
    m = Model(spark, "/root/testdata/sf0.1")
    ids = m.users.filter("orcid is not null").select("orcid", S.is_orcid("orcid").alias("ok"))
    assert ids.agg(F.count_distinct("orcid")).first()[0] == ids.count() == ids.filter("ok").count()
    assert m.occurrences.count() == m.raw("part").count() and AS_OF.year == 2002


def test_claim_pivot_deals_long_lists(spark):
    users = spark.createDataFrame([(7, "o7", None), (8, None, "Q8")], "id long, orcid string, wikidata string")
    claims = spark.createDataFrame([(7, i, "recorded", True, 2) for i in range(1, 51)] + [(8, 3, "identified,recorded", True, 2), (8, 4, None, False, 2)], CLAIM)
    whole = rows(K.claim_pivot(claims, users))
    assert whole == [("Q8", "recorded,identified", "[3]"), ("o7", "recorded", str(list(range(1, 51))).replace(" ", ""))]
    parts = [r for r in K.claim_pivot(claims, users, max_ids=10).collect() if r.identifier == "o7"]
    lists = [[int(x) for x in r.occurrence_ids.strip("[]").split(",")] for r in parts]
    assert 3 <= len(lists) <= 5 and all(x == sorted(x) for x in lists) and sorted(sum(lists, [])) == list(range(1, 51))
