"""People-to-agent matching and document filters (T-series).

The reference asks a search index one name at a time. Here every person's
name variants are matched against every agent in one job, by the folded full name
and by folded family name and first initial; a documented weighted score replaces
the index's relevance score (see README, "Matching score"). Search of text (T7) is
in ``operators.search``, specimens with a candidate (T4) in ``operators.candidates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.functions import scalars as S
from herbaria.operators.paging import rank_within
from herbaria.operators.pairs import join_in_blocks
from herbaria.session import checkpoint_dir

# Weights per variant kind (fixed values).
VARIANT_WEIGHTS = {"fullname": 5, "label": 4, "abbreviation": 4, "family": 3, "other": 1}
UNPARSED_WEIGHT = 5
EXACT, INITIAL = 10.0, 5.0
#: Agents of one name that travel in one row.
PACK = 256


def name_variants(users: DataFrame, max_other_names: int | None = None) -> DataFrame:
    """(user_id, variant, kind, weight, family) per person.

    Variants: view name, family, initials + family for every prefix of the
    initials, all other names or the first ``max_other_names`` (skipping ones
    contained in the family; a single-word other name also gets the family
    appended).
    """
    names = S.user_names()
    init = S.initials("given")
    n_init = F.size(F.filter(F.split(init, r"\."), lambda x: x != ""))
    abbrevs = F.transform(F.sequence(F.lit(1), F.greatest(n_init, F.lit(1))),
                          lambda i: F.concat_ws(" ", F.substring(init, 1, i * 2), F.col("family")))
    others = S.split_pipe("other_names")
    if max_other_names is not None:
        others = F.slice(others, 1, max_other_names)
    others = F.filter(others, lambda o: ~F.coalesce(F.col("family").contains(F.regexp_replace(o, r"\.", "")),
                                                     F.lit(False)))
    others = F.flatten(F.transform(others, lambda o: F.when(o.contains(" "), F.array(o))
                                   .otherwise(F.array(o, F.concat_ws(" ", o, F.col("family"))))))
    kv = F.array(
        F.struct(names["viewname"].alias("variant"),
                 F.when(F.col("label").isNotNull(), F.lit("label")).otherwise(F.lit("fullname")).alias("kind")),
        F.struct(F.col("family").alias("variant"), F.lit("family").alias("kind")))
    abbr = F.when(init != F.col("given"),
                  F.transform(abbrevs, lambda a: F.struct(a.alias("variant"), F.lit("abbreviation").alias("kind"))))
    oth = F.transform(others, lambda o: F.struct(o.alias("variant"), F.lit("other").alias("kind")))
    empty = F.array().cast("array<struct<variant:string,kind:string>>")
    allv = F.concat(kv, F.coalesce(abbr, empty), F.coalesce(oth, empty))
    weight = F.create_map(*[x for k, w in VARIANT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    return (users.filter(F.col("family").isNotNull() & (F.col("family") != ""))
            .select(F.col("id").alias("user_id"), "family", F.explode(F.array_distinct(allv)).alias("v"))
            .filter(F.col("v.variant").isNotNull() & (F.col("v.variant") != ""))
            .select("user_id", F.col("v.variant").alias("variant"), F.col("v.kind").alias("kind"),
                    weight[F.col("v.kind")].alias("weight"), "family"))


def _variant_keys(variants: DataFrame) -> DataFrame:
    tokens = S.name_tokens("variant")
    fam = S.fold_name("family")
    first = F.element_at(tokens, 1)
    ini = F.when(F.size(tokens) > 1, F.substring(first, 1, 1)).otherwise(F.lit(""))
    return variants.select("user_id", "variant", "kind", "weight", fam.alias("fam"), ini.alias("ini"),
                           F.array_join(tokens, " ").alias("folded"),
                           S.initials_key("variant").alias("ikey"))


def _agent_keys(agents: DataFrame) -> DataFrame:
    full = S.agent_names()["fullname"]
    return agents.select(F.col("id").alias("agent_id"), S.fold_name("family").alias("fam"),
                         F.substring(S.fold_name("given"), 1, 1).alias("ini"),
                         F.array_join(S.name_tokens(full), " ").alias("folded"),
                         F.col("unparsed"), S.initials_key("unparsed").alias("ikey"),
                         full.alias("agent_fullname"), "given", "family")


def _person_profiles(variants: DataFrame) -> DataFrame:
    """(user_id, profile, names): the match keys of all variants of a person; people with equal keys share a profile."""
    keys = F.sort_array(F.collect_list(F.struct("fam", "ini", "folded", "ikey", "weight")))
    return _variant_keys(variants).groupBy("user_id").agg(keys.alias("names")).withColumn("profile", _digest("names"))


def _agent_profiles(agents: DataFrame) -> DataFrame:
    """(agent_id, agent_profile, names): the match keys of an agent; agents of one name share a profile."""
    keys = F.sort_array(F.collect_list(F.struct("fam", "ini", "folded", "ikey")))
    return _agent_keys(agents).groupBy("agent_id").agg(keys.alias("names")).withColumn("agent_profile", _digest("names"))


def _digest(names: str | Column) -> Column:
    return F.unhex(F.md5(F.to_json(names)))


def _names(profiles: DataFrame, key: str) -> DataFrame:
    return profiles.select(key, "names").distinct().select(key, F.explode("names").alias("n")).select(key, "n.*")


def _profile_scores(people: DataFrame, agents: DataFrame) -> DataFrame:
    """(profile, agent_profile, score) for every pair of profiles with points."""
    v, a = _names(people, "profile"), _names(agents, "agent_profile")
    parsed = a.filter(F.col("fam") != "")
    exact = join_in_blocks(v.filter(F.col("folded") != "").select("profile", "weight", "folded"),
                           parsed.select("agent_profile", "folded"), "folded").select("profile", "agent_profile", (EXACT * F.col("weight")).alias("pts"))
    initial = (join_in_blocks(v.filter(F.col("ini") != "").select("profile", "weight", "fam", "ini", "folded"),
                              parsed.select("agent_profile", "fam", "ini", F.col("folded").alias("afold")), ["fam", "ini"])
               .filter("folded <> afold").select("profile", "agent_profile", (INITIAL * F.col("weight")).alias("pts")))
    unparsed = (join_in_blocks(v.filter(F.col("ikey") != "").select("profile", "ikey"),
                               a.filter((F.col("fam") == "") & (F.col("ikey") != "")).select("agent_profile", "ikey"), "ikey")
                .select("profile", "agent_profile", F.lit(INITIAL * UNPARSED_WEIGHT).alias("pts")))
    return exact.unionByName(initial).unionByName(unparsed).groupBy("profile", "agent_profile").agg(F.sum("pts").alias("score"))


def _pairs_of(scores: DataFrame, people: DataFrame, agents: DataFrame) -> DataFrame:
    """(user_id, agent_id, score): the people and agents of scored profiles.

    The agents of a profile travel in packs, so pairs are made in the last join and
    shuffled no more; a profile of many people and packs is dealt to many tasks.
    """
    sizes = agents.groupBy("agent_profile").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("n"))
    packs = (agents.join(sizes, "agent_profile").groupBy("agent_profile", F.pmod(F.xxhash64("agent_id"), F.col("n")).alias("part"))
             .agg(F.collect_list(F.struct("agent_id")).alias("agents")))
    theirs = scores.join(packs, "agent_profile").select("profile", "score", "agents")
    met = join_in_blocks(people.select("profile", "user_id"), theirs, "profile")
    return met.select("user_id", "score", F.explode("agents").alias("a")).select("user_id", "a.agent_id", "score")


def match_agents(variants: DataFrame, agents: DataFrame) -> DataFrame:
    """(user_id, agent_id, score) for every person-agent pair with points.

    Per variant: the agent's folded full name is the variant's: 10 x weight; else
    the person's family name and the variant's first initial are the agent's: 5 x
    weight. An agent whose name was not parsed gets 25 for each variant with the
    same initials key. Equal names are scored once and give their score to all
    their people and agents.
    """
    checkpoint_dir(agents.sparkSession)
    people, theirs = _person_profiles(variants).checkpoint(), _agent_profiles(agents).checkpoint()  # read several times below
    return _pairs_of(_profile_scores(people, theirs), people, theirs)


def known_names(users: DataFrame) -> DataFrame:
    """(user_id, families, initials): folded names a person is known by, for T3.

    Other names of two words or more bring their last word as a family name and
    their first letter as an initial.
    """
    others = F.transform(F.coalesce(S.split_pipe("other_names"), F.array().cast("array<string>")), S.name_tokens)
    parsed = F.filter(others, lambda t: F.size(t) > 1)
    own = F.filter(F.array(S.fold_name("family")), lambda x: x.isNotNull())
    given = F.filter(F.array(F.substring(S.fold_name("given"), 1, 1)), lambda x: x.isNotNull() & (x != ""))
    return users.select(F.col("id").alias("user_id"),
                        F.array_distinct(F.concat(own, F.transform(parsed, lambda t: F.element_at(t, -1)))).alias("families"),
                        F.array_distinct(F.concat(given, F.transform(parsed, lambda t: F.substring(t[0], 1, 1)))).alias("initials"))


def candidate_agents(users: DataFrame, agents: DataFrame, cutoff: float, relaxed: bool = False) -> DataFrame:
    """(user_id, agent_id, score) of the agents kept for a person.

    An agent with one of the person's full names gains ``cutoff``. Any other is
    removed if one of the person's known initials is not the agent's, or if the
    agent's family name is not known; a score over twice ``cutoff`` saves it. Scores
    below ``cutoff`` are dropped. ``relaxed``: no rule but half of ``cutoff``.
    Like the points, the rules look at names only and are applied once per name.
    """
    checkpoint_dir(agents.sparkSession)
    people, theirs = _person_profiles(name_variants(users)), _agent_profiles(agents).checkpoint()  # read several times below
    if relaxed:
        people = people.checkpoint()
        return _pairs_of(_profile_scores(people, theirs).filter(F.col("score") >= 0.5 * cutoff), people, theirs)
    known = known_names(users).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("families", "initials"))).alias("known"))
    people = people.join(known, "user_id").withColumn("profile", _digest(F.struct("names", "known"))).checkpoint()
    theirs = theirs.filter(F.col("agent_id").isNotNull())
    a = _names(theirs, "agent_profile").select("agent_profile", F.col("folded").alias("afold"), "fam", "ini")
    p = (people.select("profile", "names", "known").distinct()
         .select("profile", F.col("names.folded").alias("full_names"), F.explode("known").alias("k")).select("profile", "full_names", "k.*"))
    j = _profile_scores(people, theirs).join(a, "agent_profile").join(p, "profile")
    same = F.array_contains("full_names", F.col("afold"))
    dissimilar = (F.col("ini") != "") & F.exists("initials", lambda x: x != F.col("ini"))
    unknown = ~F.array_contains("families", F.col("fam"))
    score = F.when(same, F.col("score") + cutoff).otherwise(F.col("score"))
    kept = same | ~(F.coalesce(dissimilar, F.lit(False)) | unknown) | (score > 2 * cutoff)
    judged = j.select("profile", "agent_profile", score.alias("score"), kept.alias("kept"))
    return _pairs_of(judged.filter(F.col("kept") & (F.col("score") >= cutoff)).drop("kept"), people, theirs)


def person_documents(users: DataFrame, claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """K18 (people): one row per public person with arrays of distinct
    (family, country) pairs by role; built with collect_set after a distinct,
    so each array is bounded by the person's distinct pairs."""
    c = claims.filter(P.vis() & P.any_role()).select("user_id", F.col("occurrence_id").alias("gbifID"), "action")
    j = c.join(occurrences.select("gbifID", "family", "countryCode"), "gbifID")
    rows = j.select("user_id", P.rec().alias("r"), P.idn().alias("i"), "family", "countryCode")
    rec = (rows.filter("r").select("user_id", "family", "countryCode").distinct()
           .groupBy("user_id").agg(F.collect_list(F.struct("family", F.col("countryCode").alias("country")))
                                   .alias("recorded")))
    idn = (rows.filter("i").select("user_id", "family", "countryCode").distinct()
           .groupBy("user_id").agg(F.collect_list(F.struct("family", F.col("countryCode").alias("country")))
                                   .alias("identified")))
    return (users.filter(F.col("is_public")).select(F.col("id").alias("user_id"), "family", "given")
            .join(rec, "user_id", "left").join(idn, "user_id", "left"))


def people_by_country(docs: DataFrame, country: str, role: str = "recorded", family: str | None = None) -> DataFrame:
    """T5: people where one array element matches the country (and family)."""
    def cond(x):
        c = x["country"] == country
        return c & (x["family"] == family) if family else c
    return docs.filter(F.coalesce(F.exists(role, cond), F.lit(False)))


def people_by_family(docs: DataFrame, family: str, role: str = "identified") -> DataFrame:
    """People with an element whose family equals ``family`` (case-insensitive)."""
    return docs.filter(F.coalesce(F.exists(role, lambda x: F.lower(x["family"]) == family.lower()), F.lit(False)))


def _neighbours(members: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, user_id, other_id): for each member of a group the next ``k`` in a seeded circle of its members.

    A random sample of a person's fellows, all of them in groups of up to k + 1: k
    rows per member instead of all pairs. A group of any size is ranked in ranges.
    """
    rows = members.select(group, "user_id").distinct().withColumn("_h", F.md5(F.concat_ws(":", "user_id", F.lit(seed))))
    placed = rank_within(rows, group, [F.col("_h"), F.col("user_id")]).select(group, "user_id", "position")
    sizes = placed.groupBy(group).agg(F.max("position").alias("n"))
    steps = placed.join(sizes, group).select(group, "user_id", "n", "position", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")).filter("j < n")
    next_ = steps.select(group, "user_id", ((F.col("position") - 1 + F.col("j")) % F.col("n") + 1).alias("position"))
    return next_.join(placed.withColumnRenamed("user_id", "other_id"), [group, "position"]).select(group, "user_id", "other_id")


def might_know(claims: DataFrame, taxon_occurrences: DataFrame, user_organizations: DataFrame, users: DataFrame, seed: int,
               k: int = 5, colleagues: int = 10) -> DataFrame:
    """Up to ``k`` suggestions for each person with an ORCID (the sample is the feature).

    Candidates are co-collectors, people who identified the same family (one of the
    person's, drawn by the seed) and up to ``colleagues`` people of the same
    organisations. Each kind is sampled in its groups before it is gathered, with at
    least ``k`` per group, so a person gets as many suggestions as if all pairs had
    been made.
    """
    rec = claims.filter(P.vis() & P.rec()).select("occurrence_id", "user_id")
    idn = claims.filter(P.vis() & P.idn()).select("occurrence_id", "user_id").join(taxon_occurrences, "occurrence_id").select("user_id", "family").distinct()
    drawn = idn.groupBy("user_id").agg(F.min_by("family", F.md5(F.concat_ws(":", "user_id", "family", F.lit(seed)))).alias("family"))
    met = _neighbours(rec, "occurrence_id", k, seed).select("user_id", "other_id")
    same_family = _neighbours(idn, "family", k, seed).join(drawn, ["user_id", "family"], "left_semi").select("user_id", "other_id")
    works = _neighbours(user_organizations, "organization_id", colleagues, seed).select("user_id", "other_id")
    asked = users.filter(F.col("orcid").isNotNull()).select(F.col("id").alias("user_id"))
    found = met.unionByName(same_family).unionByName(works).filter("user_id <> other_id").join(asked, "user_id", "left_semi").distinct()
    order = W.partitionBy("user_id").orderBy(F.md5(F.concat_ws(":", "user_id", "other_id", F.lit(seed))), "other_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
