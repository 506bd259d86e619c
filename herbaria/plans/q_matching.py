"""Registered matching queries (T-series) with their oracle SQL; T4 is under B7, T7 in ``q_features``."""

from __future__ import annotations

from herbaria.operators import aggs
from herbaria.operators import candidates as C
from herbaria.operators import matching as T
from herbaria.plans.registry import query

REC = "('recorded','recorded,identified','identified,recorded')"
IDN = "('identified','recorded,identified','identified,recorded')"

#: Cut-off of the scores of T2: a family and initial match of the full name (25) and of one
#: abbreviation (20) pass.
CUTOFF = 40.0

_FULL = ("CASE WHEN {p}.family IS NULL OR trim({p}.family) = '' THEN {p}.orcid ELSE "
         "trim(concat_ws(' ', nullif(trim({p}.given), ''), nullif(trim(concat_ws(' ', nullif(trim({p}.particle), ''), "
         "nullif(trim({p}.family), ''))), ''))) END")


def _fold(x: str) -> str:
    return (f"regexp_replace(replace(replace(replace(strip_accents(lower({x})), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), "
            r"'(^|[^q])ue', '\1u', 'g')")


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({_fold(x)}, '\.|,| '), lambda w: w <> '')"


def _ikey(x: str) -> str:
    return rf"strip_accents(lower(regexp_replace({x}, '[a-z.\s]', '', 'g')))"


_INIT = r"regexp_replace(regexp_replace(given, '(\p{Lu})\p{Ll}+', '\1.', 'g'), '\s+', '', 'g')"
_VARIANTS = f"""
p AS (SELECT id AS user_id, family, given, coalesce(label, {_FULL.format(p='users')}) AS viewname, label, {_INIT} AS init,
        list_filter(list_transform(string_split(other_names, '|'), lambda x: trim(x)), lambda x: x <> '') AS others
      FROM users WHERE family IS NOT NULL AND family <> ''),
o AS (SELECT user_id, family, unnest(others) AS name FROM p),
ok AS (SELECT * FROM o WHERE NOT contains(family, replace(name, '.', ''))),
v0 AS (
  SELECT user_id, family, viewname AS variant, CASE WHEN label IS NOT NULL THEN 'label' ELSE 'fullname' END AS kind FROM p
  UNION SELECT user_id, family, family, 'family' FROM p
  UNION SELECT user_id, family, concat_ws(' ', substring(init, 1, CAST(n * 2 AS INTEGER)), family), 'abbreviation'
        FROM p, LATERAL (SELECT unnest(range(1, 1 + greatest(1, len(list_filter(string_split(init, '.'), lambda x: x <> ''))))) AS n) WHERE init <> given
  UNION SELECT user_id, family, name, 'other' FROM ok
  UNION SELECT user_id, family, concat_ws(' ', name, family), 'other' FROM ok WHERE NOT contains(name, ' ')),
variants AS (SELECT user_id, variant, kind, CASE kind WHEN 'fullname' THEN 5 WHEN 'label' THEN 4 WHEN 'abbreviation' THEN 4 WHEN 'family' THEN 3 ELSE 1 END AS weight,
               family FROM v0 WHERE variant IS NOT NULL AND variant <> '')
"""


@query("T1_name_variants", "WITH " + _VARIANTS + " SELECT * FROM variants")
def t1(m):
    return T.name_variants(m.users)


_SCORES = _VARIANTS + f""",
vk AS (SELECT *, {_tokens('variant')} AS ts, {_fold('family')} AS fam, {_ikey('variant')} AS ikey FROM variants),
vkey AS (SELECT *, array_to_string(ts, ' ') AS folded, CASE WHEN len(ts) > 1 THEN left(ts[1], 1) ELSE '' END AS ini FROM vk),
ak AS (SELECT id AS agent_id, {_fold('family')} AS fam, left({_fold('given')}, 1) AS ini, {_ikey('unparsed')} AS ikey,
         array_to_string({_tokens("trim(concat_ws(' ', nullif(trim(given), ''), nullif(trim(family), '')))")}, ' ') AS folded FROM agents),
pts AS (
  SELECT v.user_id, a.agent_id, 10.0 * v.weight AS pts FROM vkey v JOIN ak a ON a.folded = v.folded AND a.fam <> '' AND v.folded <> ''
  UNION ALL SELECT v.user_id, a.agent_id, 5.0 * v.weight FROM vkey v JOIN ak a ON a.fam = v.fam AND a.ini = v.ini AND a.fam <> '' AND v.ini <> '' AND a.folded <> v.folded
  UNION ALL SELECT v.user_id, a.agent_id, 25.0 FROM vkey v JOIN ak a ON a.fam = '' AND a.ikey = v.ikey AND v.ikey <> ''),
scored AS (SELECT user_id, agent_id, CAST(sum(pts) AS DOUBLE) AS score FROM pts GROUP BY 1, 2)
"""


@query("T2_match_agents", "WITH " + _SCORES + " SELECT * FROM scored")
def t2(m):
    return T.match_agents(T.name_variants(m.users), m.agents)


_CANDIDATES = _SCORES + f""",
other AS (SELECT id AS user_id, list_filter(list_transform(list_filter(list_transform(string_split(other_names, '|'), lambda x: trim(x)), lambda x: x <> ''),
            lambda n: {_tokens('n')}), lambda t: len(t) > 1) AS ts FROM users),
known AS (SELECT p.user_id, list_append(coalesce(list_transform(o.ts, lambda t: t[len(t)]), []), {_fold('p.family')}) AS families,
            list_append(coalesce(list_transform(o.ts, lambda t: left(t[1], 1)), []), left({_fold('p.given')}, 1)) AS initials
          FROM p JOIN other o USING (user_id)),
fulls AS (SELECT DISTINCT user_id, folded FROM vkey),
judged AS (SELECT s.user_id, s.agent_id, EXISTS (SELECT 1 FROM fulls f WHERE f.user_id = s.user_id AND f.folded = a.folded) AS same,
    a.ini <> '' AND len(list_filter(k.initials, lambda x: x <> '' AND x <> a.ini)) > 0 AS dissimilar, NOT list_contains(k.families, a.fam) AS unknown, s.score
  FROM scored s JOIN ak a USING (agent_id) JOIN known k USING (user_id)),
boosted AS (SELECT user_id, agent_id, same, dissimilar, unknown, CASE WHEN same THEN score + {CUTOFF} ELSE score END AS score FROM judged),
candidates AS (SELECT user_id, agent_id, score FROM boosted WHERE (same OR NOT (dissimilar OR unknown) OR score > {2 * CUTOFF}) AND score >= {CUTOFF})
"""


@query("T3_candidate_agents", "WITH " + _CANDIDATES + " SELECT * FROM candidates")
def t3(m):
    return T.candidate_agents(m.users, m.agents, CUTOFF)


@query("T3_candidate_agents_relaxed", "WITH " + _SCORES + f" SELECT * FROM scored WHERE score >= {CUTOFF / 2}")
def t3r(m):
    return T.candidate_agents(m.users, m.agents, CUTOFF, relaxed=True)


@query("T4_occurrence_has_candidate", "WITH " + _CANDIDATES + """,
uc AS (SELECT occurrence_id, count(*) AS user_count FROM claims WHERE action LIKE '%recorded%' GROUP BY 1 HAVING count(*) > 1),
ac AS (SELECT occurrence_id, count(DISTINCT agent_id) AS agent_count FROM occurrence_agents WHERE agent_role GROUP BY 1),
counts AS (SELECT uc.occurrence_id, uc.user_count, ac.agent_count FROM uc JOIN ac USING (occurrence_id) WHERE agent_count NOT IN (1, 2)),
rec AS (SELECT DISTINCT occurrence_id, user_id FROM claims WHERE visible AND action IN """ + REC + f"""),
edges AS (SELECT DISTINCT a.user_id AS collector, b.user_id AS other FROM rec a JOIN rec b USING (occurrence_id) WHERE a.user_id <> b.user_id),
network AS (SELECT DISTINCT c.occurrence_id, e.other FROM counts c JOIN rec r USING (occurrence_id) JOIN edges e ON e.collector = r.user_id),
big AS (SELECT occurrence_id FROM network GROUP BY 1 HAVING count(*) >= 2),
hit AS (SELECT DISTINCT n.occurrence_id FROM network n JOIN candidates s ON s.user_id = n.other AND s.score > {0.75 * CUTOFF}
        JOIN occurrence_agents oa ON oa.occurrence_id = n.occurrence_id AND oa.agent_id = s.agent_id AND oa.agent_role
        WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.occurrence_id = n.occurrence_id AND r.user_id = n.other))
SELECT c.* FROM counts c WHERE c.occurrence_id IN (SELECT occurrence_id FROM big) AND c.occurrence_id IN (SELECT occurrence_id FROM hit)
""")
def t4(m):
    counts = aggs.occurrence_counts(m.claims, m.occurrence_agents)
    return C.occurrence_has_candidate(counts, m.claims, m.occurrence_agents, T.candidate_agents(m.users, m.agents, CUTOFF), 0.75 * CUTOFF)


@query("T5_people_by_country_family", f"""
SELECT u.id AS user_id, u.family, u.given FROM users u
WHERE u.is_public AND EXISTS (SELECT 1 FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.user_id = u.id AND c.visible AND c.action IN {REC} AND o.countryCode = 'AA' AND o.family = 'PROMO')
""")
def t5(m):
    docs = T.person_documents(m.users, m.claims, m.occurrences)
    return T.people_by_country(docs, "AA", "recorded", "PROMO").select("user_id", "family", "given")


@query("T6_people_by_family", f"""
SELECT u.id AS user_id, u.family, u.given FROM users u
WHERE u.is_public AND EXISTS (SELECT 1 FROM claims c JOIN occurrences o ON o.gbifID = c.occurrence_id
  WHERE c.user_id = u.id AND c.visible AND c.action IN {IDN} AND lower(o.family) = 'small')
""")
def t6(m):
    docs = T.person_documents(m.users, m.claims, m.occurrences)
    return T.people_by_family(docs, "small", "identified").select("user_id", "family", "given")


_CIRCLE = """
{name}_p AS (SELECT g, user_id, row_number() OVER (PARTITION BY g ORDER BY md5(user_id || ':7'), user_id) AS pos, count(*) OVER (PARTITION BY g) AS n
             FROM (SELECT DISTINCT {g} AS g, user_id FROM {table})),
{name} AS (SELECT a.g, a.user_id, b.user_id AS other_id FROM {name}_p a, range(1, {k} + 1) r(j), {name}_p b
           WHERE r.j < a.n AND b.g = a.g AND b.pos = (a.pos - 1 + r.j) % a.n + 1)
"""


@query("T8_might_know", f"""
WITH rec AS (SELECT occurrence_id, user_id FROM claims WHERE visible AND action IN {REC}),
idn AS (SELECT DISTINCT c.user_id, t.family FROM claims c JOIN taxon_occurrences t USING (occurrence_id) WHERE c.visible AND c.action IN {IDN}),
drawn AS (SELECT user_id, arg_min(family, md5(user_id || ':' || family || ':7')) AS family FROM idn GROUP BY 1),
{_CIRCLE.format(name='met', g='occurrence_id', table='rec', k=5)}, {_CIRCLE.format(name='fam', g='family', table='idn', k=5)},
{_CIRCLE.format(name='org', g='organization_id', table='user_organizations', k=10)},
found AS (SELECT user_id, other_id FROM met UNION SELECT f.user_id, f.other_id FROM fam f JOIN drawn d ON d.user_id = f.user_id AND d.family = f.g
          UNION SELECT user_id, other_id FROM org)
SELECT user_id, other_id FROM found WHERE user_id <> other_id AND user_id IN (SELECT id FROM users WHERE orcid IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || other_id || ':7'), other_id) <= 5
""")
def t8(m):
    return T.might_know(m.claims, m.taxon_occurrences, m.user_organizations, m.users, seed=7)
