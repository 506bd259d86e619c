"""Each query against a plain version of its contract, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from herbaria.llm import queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


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


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def run(spark, name, sf=SMALL):
    return queries.QUERIES[name](spark, sf).collect()


def test_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([-1 if r.label is None else r.label for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    ids = [r.vec_id for r in rows]
    want = groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in run(spark, "op2_embedding_dedup", "/root/testdata/sf0.01")}
    assert {k: r.component_id for k, r in got.items()} == want
    assert [got[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_bpe(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in run(spark, "op4_bpe"):
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_simhash(spark, texts):
    def fp(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fp(t) for d, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(ids, links)
    got = run(spark, "op6_simhash_dedup")
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_substring(spark, texts):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    seen = Counter(tuple(w[i:i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in run(spark, "op9_substring_dedup"):
        w = words[r.doc_id]
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_fingerprints(spark, texts):
    order = sorted(texts, reverse=True)

    def shingles(text):
        w = WORD.findall(text)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r.doc_id: r for r in run(spark, "op10_fingerprints")}
    errors, prints = [], defaultdict(set)
    for i, d in enumerate(order):
        text, following = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(got) == len(texts)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03 and np.abs(errors).max() < 0.15


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = run(spark, "op3_toxicity", sf)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p == t for p, t in judged]) >= 0.9


def test_line_dedup(spark, documents, texts):
    def shingles(s):
        return {s[i:i + 8] for i in range(max(1, len(s) - 7))}

    place = {(d, i): line.strip(" \t\n\v\f\r") for d, t in texts.items() for i, line in enumerate(t.split("\n")) if line.strip(" \t\n\v\f\r")}
    sets = {s: shingles(s) for s in set(place.values())}
    lines = sorted(sets, key=len)
    links, by_shingle = [], defaultdict(list)
    for s in lines:
        for x in sets[s]:
            by_shingle[x].append(s)
    for s in lines:
        both = Counter(o for x in sets[s] for o in by_shingle[x] if o < s)
        links += [(s, o) for o, n in both.items() if n >= 0.8 * (len(sets[s]) + len(sets[o]) - n)]
    comp = groups(lines, links)
    first = {}
    for at in sorted(place):
        first.setdefault(comp[place[at]], at)
    kept = set(first.values())
    got = {r.doc_id: r for r in run(spark, "op1_line_dedup")}
    for d, t in texts.items():
        want = [line for i, line in enumerate(t.split("\n")) if (d, i) not in place or (d, i) in kept]
        assert got[d].text == "\n".join(want)
        assert got[d].n_lines - got[d].n_removed == len(want)


def test_pii_leaves_no_entity(spark, texts):
    mail = re.compile(r"[\w.]+@[\w.]+\.\w{2,}")
    card, ip = re.compile(r"(?<!\d)\d{16}(?!\d)"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
    phone = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")
    real = {m for t in texts.values() for p in (mail, card, ip, phone) for m in p.findall(t)}
    assert len(real) > 10
    sur = set()
    for r in run(spark, "op8_pii"):
        found = [m for p in (mail, card, ip, phone) for m in p.findall(texts[r.doc_id])]
        assert not [m for m in real if m in r.text]
        assert (r.text == texts[r.doc_id]) == (r.n_entities == 0)
        assert r.n_entities >= len(found)
        sur |= {m for p in (mail, card, ip, phone) for m in p.findall(r.text)}
    assert len(sur) == len(real)


def test_line_bitmaps_never_rule_out_a_match():
    """Pairs that may_match rules out are below the similarity, for any line lengths and scripts."""
    import random

    import numpy as np

    from herbaria.llm.line_dedup import bitmaps, may_match

    rng = random.Random(5)
    for n in (3, 8, 11):
        lines = ["", "a", "é" * 40, "ab" * 5000]
        while len(lines) < 120:
            base = "".join(rng.choice("abcd éłž漢😀") for _ in range(rng.choice([2, n - 1, n, 30, 300, 3000])))
            at = rng.randrange(len(base))
            lines += [base, base[:at] + "x" + base[at + 1:], base + base[:9]]
        sets = [{s[i:i + n] for i in range(max(1, len(s) - n + 1))} for s in lines]
        x, y = np.triu_indices(len(lines), 1)
        for similarity in (0.5, 0.8, 1.0):
            ok = may_match(*bitmaps(lines, n), x, y, similarity)
            for p, q in zip(x[~ok].tolist(), y[~ok].tolist()):
                assert len(sets[p] & sets[q]) < similarity * len(sets[p] | sets[q])
            assert (~ok).any()
