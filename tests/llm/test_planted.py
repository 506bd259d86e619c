"""Planted embeddings near the threshold, SQL of mixing and WARC, and the pipeline end to end against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from herbaria.llm import embedding_dedup, queries, toxicity
from herbaria.llm.common import cut, table
from herbaria.llm.oracle import MIXING_SQL, WARC_SQL

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_embedding_links_near_the_threshold(spark):
    """Pairs planted from 0.90 to 0.97: no link below 0.93, nearly all above, components of what was found."""
    rnd = np.random.default_rng(7)
    rows, n = [], 0
    for c in np.repeat([0.90, 0.925, 0.932, 0.94, 0.95, 0.97], 150):
        x, z = rnd.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
        label = int(rnd.integers(0, 3))
        rows += [(n, label, (3 * x).tolist()), (n + 1, label, y.tolist())]
        n += 2
    rows += [(n, 0, [0.0] * 64), (n + 1, None, rows[0][2]), (n + 2, rows[0][1], rows[0][2]), (n + 3, 1, None), (n + 4, 1, [float("nan")] * 64)]
    df = cut(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "in")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, 0.93).collect()}
    v = np.array([r[2] if r[2] is not None and np.isfinite(r[2]).all() and any(r[2]) else [np.nan] * 64 for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([-1 if r[1] is None else r[1] for r in rows])
    near = (np.nan_to_num(v @ v.T, nan=-1) >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    links = np.array([got[r[0]].n_links for r in rows])
    assert (links <= want).all() and links.sum() >= 0.985 * want.sum() and want.sum() > 1000
    same = [k for k in range(len(rows)) if links[k] == want[k]]
    comp = groups(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(near))])
    assert sum(got[k].component_id == comp[k] for k in same) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("name,sql", [("op5_mixing", MIXING_SQL), ("op7_warc", WARC_SQL)])
def test_sql(spark, name, sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    rel = con.sql(sql)
    rows = queries.QUERIES[name](spark, SMALL).select(*rel.columns).collect()
    tidy = lambda rs: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs), key=repr)
    assert rows and tidy(rows) == tidy(rel.fetchall())


# -- the pipeline, stage by stage ------------------------------------------------------

def plain_lines(docs):
    strip = " \t\n\v\f\r"
    place = {(d, i): line.strip(strip) for d, t in docs.items() for i, line in enumerate((t or "").split("\n")) if line.strip(strip)}
    sets = {s: {s[i:i + 8] for i in range(max(1, len(s) - 7))} for s in set(place.values())}
    by, links = defaultdict(list), []
    for s in sets:
        for x in sets[s]:
            by[x].append(s)
    for s in sets:
        for o, n in Counter(o for x in sets[s] for o in by[x] if o < s).items():
            if n >= 0.8 * (len(sets[s]) + len(sets[o]) - n):
                links.append((s, o))
    comp, first = groups(sets, links), {}
    for at in sorted(place):
        first.setdefault(comp[place[at]], at)
    kept = set(first.values())
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in place or (d, i) in kept) for d, t in docs.items()}


def plain_simhash(docs):
    def fp(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints, ids = {d: fp(t) for d, t in docs.items()}, sorted(docs)
    comp = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 4])
    return {d for d in ids if comp[d] == d}


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]

    out = cut(stages["toxicity"](spark, docs, SMALL), "toxicity")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(spark, SMALL, "labels")).collect()}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and kept == {d: t for d, t in before.items() if not scored[d]} and 0 < len(kept) < len(before)

    out = cut(stages["line_dedup"](spark, out, SMALL), "lines")
    lines = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and lines == plain_lines(kept) and lines != kept
    assert all(r.text is None or lines[r.doc_id] == kept[r.doc_id] or r.n_chars == len(r.text) for r in out.collect())

    out = cut(stages["simhash_dedup"](spark, out, SMALL), "simhash")
    single = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and set(single) == plain_simhash(lines) and all(lines[d] == t for d, t in single.items())

    sources = {r.doc_id: r.source for r in out.collect()}
    out = cut(stages["mixing"](spark, out, SMALL), "mixing")
    copies = Counter(r.doc_id for r in out.collect())
    assert out.columns == columns and set(copies) <= set(single) and max(copies.values()) <= 3
    assert all(single[r.doc_id] == r.text for r in out.collect())
    size = {d: len(WORD.findall(t or "")) for d, t in single.items()}
    have, target = Counter(), {}
    for d, s in sources.items():
        have[s] += size[d]
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight, open_, total = {s: 1 + i % 3 for i, s in enumerate(order)}, set(order), sum(have.values())
    while True:  # the excess over three times a source's size goes to the others by weight
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * have[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * have[s] for s in over}
        open_ -= over
        if not open_:
            break
    taken = Counter()
    for d, n in copies.items():
        taken[sources[d]] += n * size[d]
    largest = {s: max(size[d] for d in single if sources[d] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(2 * largest[s], 0.05 * target[s]) for s in order)

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = cut(stages["bpe"](spark, out, SMALL), "bpe").collect()
    assert Counter(r.doc_id for r in rows) == copies
    for r in rows:
        ids = encoder.encode(single[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((single[r.doc_id] or "").encode()).hexdigest()
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.ids_sha256) for r in run.collect()) == sorted((r.doc_id, r.ids_sha256) for r in rows)
