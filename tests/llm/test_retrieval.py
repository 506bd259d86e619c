"""Hard negatives, periodic runs and packing against plain versions, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herbaria.llm import hard_negatives, packing, queries, runs
from herbaria.llm.common import cut
from herbaria.llm.oracle import HARD_NEGATIVES_SQL

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- hard negatives ------------------------------------------------------------

def mined(rows, anchor, scale=256):
    """The definition: every anchor against every row."""
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])
    rows = {(i, lab, tuple(math.floor(scale * float(x)) for x in v)) for i, lab, v in filter(usable, rows)}
    out = set()
    for a, lab, v in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a)
        for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
            hard = [s for s in scored if s[2] != lab and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out |= {(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(hard)}
    return out


@pytest.mark.parametrize("blocks", [(256, 8192), (3, 17)])
def test_hard_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[1])
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, int(rnd.integers(0, 3)), [float(x) for x in np.float32(centres[i % 6] + rnd.choice([0.02, 0.4]) * rnd.normal(size=8))]) for i in range(240)]
    rows += [(300 + i, i % 3, rows[0][2]) for i in range(12)]  # ties and equal vectors
    rows += [(320, 1, [0.0] * 8), (330, None, rows[0][2]), (340, 0, None), (350, 0, [1.0, None]), (360, 0, [float("nan")] * 8),
             (370, 1, [1.0, 2.0]), (380, 0, []), (None, 1, rows[1][2]), rows[10], rows[10], (390, 1, [-x for x in rows[20][2]]),
             (400, 9, [float("inf")] * 8), (410, 7, rows[3][2])]
    df = cut(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
             .withColumns({"score": F.lit("x"), "rank": F.lit(1), "id": F.lit(0)}), "in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()]
    assert len(got) == len(set(got)) and len(got) > 100
    assert set(got) == mined(rows, lambda i: i % 10 == 0)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_bounds_leave_rows_out():
    """Children in a cluster take their parents' bounds: few rows are scored again, all wanted ones are."""
    rnd = np.random.default_rng(1)
    anchors = (1000 * rnd.normal(size=(1, 16)) + 5 * rnd.normal(size=(20, 16))).astype(np.int64)
    rows = (1000 * rnd.normal(size=(500, 16))).astype(np.int64)
    order, up, edge = hard_negatives.spanning_tree(anchors)
    anchors = anchors[order]
    meeting = hard_negatives.Meeting([a.tobytes() for a in anchors], up, edge, [r.tobytes() for r in rows])
    for i, again, score in meeting.walk(lambda i, low, high: (high >= 5e6) & (low <= 6e6)):
        true = rows @ anchors[i]
        assert (true[again] == score).all()
        assert set(np.flatnonzero((true >= 5e6) & (true <= 6e6))) <= set(again)
        assert i == 0 or len(again) < 150


def test_large_components_and_overflow(spark):
    big = [(i, i % 2, [float(2**40 + i), 1.0]) for i in range(0, 40, 5)]
    df = cut(spark.createDataFrame(big, "vec_id long, label int, embedding array<double>"), "big")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()
    small = [(i, l, [x / 2**12 for x in v]) for i, l, v in big]
    df = cut(spark.createDataFrame(small, "vec_id long, label int, embedding array<double>"), "large")
    got = {tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), scale=4).collect()}
    assert got == mined(small, lambda i: i % 10 == 0, 4)


def test_op11_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rel = con.sql(HARD_NEGATIVES_SQL)
    got = [tuple(r[c] for c in rel.columns) for r in queries.op11_hard_negatives(spark, sf).collect()]
    assert got and sorted(got) == sorted(rel.fetchall())


# -- periodic runs ---------------------------------------------------------------

def plain_runs(words, min_length=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_batch_runs():
    rnd = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            letters, doc = rnd.choice([1, 2, 3, 6]), []
            for _ in range(rnd.randint(0, 6)):
                doc += [rnd.randrange(letters) for _ in range(rnd.randint(0, 20))]
                part = [rnd.randrange(letters + 1) for _ in range(rnd.randint(1, 8))]
                doc += part * rnd.randint(1, 9) + part[: rnd.randrange(len(part))]
            docs.append(doc)
        docs.append(docs[0])
        for doc, found in zip(docs, runs.batch_runs([np.array(d, np.int64) for d in docs])):
            assert [tuple(int(x) for x in r) for r in zip(*found)] == plain_runs(doc)


def test_grammar_is_exact():
    """Nonterminals stand for equal words at every occurrence."""
    rnd = random.Random(9)
    words = np.array([rnd.choice([0, 1, 1, 2, 3]) for _ in range(500)] + [0, 1] * 60 + [2] * 50)
    (number, place, half, size), begins = runs.re_pair(words, np.zeros(len(words), bool))
    expansions = defaultdict(set)
    for n, p, h, s in zip(number, place, half, size):
        expansions[n].add((tuple(words[p:p + s]), h))
    assert len(expansions) > 20 and all(len(x) == 1 for x in expansions.values())
    assert begins[0] == 0 and (np.diff(begins) > 0).all() and len(begins) < len(words) / 3


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op12(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = planted(d.doc_id, WORD.findall(d.text or ""))
        words_runs, r = plain_runs(words), got[d.doc_id]
        covered = {i for s, n, q in words_runs for i in range(s + q, s + n)}
        assert r.n_runs == len(words_runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in words_runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in covered))
        best = min(words_runs, key=lambda x: (-(x[1] * 10**12 // x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        with_runs += bool(words_runs)
    assert with_runs > 5


def test_runs_edges(spark):
    long = " ".join(["a b"] * 50_000 + [f"w{i}" for i in range(3000)] * 5)
    rows = [(1, None), (2, ""), (3, "x x x x x"), (4, "x x x x x x"), (4, "x x x x x x"), (None, "a b a b a b a b c"), (5, long),
            (6, "é é é é é é é é é é é é"), (7, "\n\t ")]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("old")), "in")
    out = [(r.doc_id, [tuple(x) for x in r.runs], r.best_run and tuple(r.best_run), r.collapsed) for r in runs.periodic_runs(df).collect()]
    want = [(1, [], None, ""), (2, [], None, ""), (3, [], None, "x x x x x"), (4, [(0, 6, 1)], (0, 6, 1), "x"), (4, [(0, 6, 1)], (0, 6, 1), "x"),
            (None, [(0, 8, 2)], (0, 8, 2), "a b c"),
            (5, [(0, 100_000, 2), (100_000, 15_000, 3000)], (0, 100_000, 2), " ".join(["a b"] + [f"w{i}" for i in range(3000)])),
            (6, [(0, 6, 1)], (0, 6, 1), "é é"), (7, [], None, "")]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    tie = [np.array(x, np.int64) for x in ([0, 12, 30], [8, 8, 16], [2, 2, 4])]
    assert runs.strongest(*tie) == 0 and runs.strongest(np.array([0, 9]), np.array([8, 9]), np.array([2, 2])) == 1


# -- packing -----------------------------------------------------------------------

def check_pieces(rows, texts, window):
    """Every id in one piece, sequences without holes, full or a power of two."""
    encoder = Tokenizer.from_file(VOCAB)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_op13(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op13_packing(spark, SMALL).collect()
    assert check_pieces(rows, texts, 2048) == 0
    again = queries.op13_packing(spark, SMALL).collect()
    assert sorted(rows) == sorted(again)


def test_packing_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCS", 7)
    monkeypatch.setattr(packing, "SHARD_IDS", 900)
    rnd = random.Random(2)
    vocab = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper") for b in range(30)]
    texts = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 30, 80]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: " ".join(vocab * 40), 103: "İstanbul ΣΑΣ ﬁx é don't<|endoftext|>x y", 104: "z" * 5000}
    df = cut(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"ids": F.lit(1), "length": F.lit(2)}), "in")
    out = packing.pack(df, VOCAB, 1, window=128).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_pieces(out, texts, 128) == 0
    assert len({r.sequence_id >> 32 for r in out}) > 3
    twice = packing.pack(df.union(df), VOCAB, 1, window=128)
    assert twice.agg(F.sum("length")).first()[0] == 2 * sum(r.length for r in out)
    assert packing.pack(df.limit(0), VOCAB, 1).count() == 0
    with pytest.raises(ValueError, match="white space"):
        packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), 1)


def test_scores_are_bm25_and_neighbours_follow():
    rnd = np.random.default_rng(4)
    ids = [rnd.choice(40, size=rnd.integers(3, 30), p=np.arange(40, 0, -1) / 820).astype("<u2") for _ in range(50)]
    held = Counter(t for x in ids for t in set(x.tolist()))
    idf = np.array([max(0, math.log((50 - held[t] + 0.5) / (held[t] + 0.5))) for t in range(40)])
    mean = np.mean([len(x) for x in ids])
    block = packing.Block(ids, idf, mean)

    def bm25(q, d):
        tf = Counter(ids[d].tolist())
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ids[d]) / mean)) for t in set(ids[q].tolist()))

    want = np.array([[bm25(q, d) for d in range(50)] for q in range(50)])
    assert np.allclose([block.scores(q) for q in range(50)], want)
    lengths, packed = np.array([len(x) for x in ids]), np.zeros(50, int)
    windows = list(packing.fill_windows(lengths, lambda q: want[q], 64))
    for pieces in windows:
        assert sum(n for _, _, n in pieces) == 64 or pieces is windows[-1]
        for k, (d, start, n) in enumerate(pieces):
            assert start == packed[d]
            if k:  # the best unused neighbour of the seed
                unused = np.flatnonzero(packed < lengths)
                assert want[pieces[0][0], d] == want[pieces[0][0], unused].max()
            packed[d] += n
    assert (packed == lengths).all()
