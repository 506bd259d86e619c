"""Substring dedup as a parse: sources hold the words, equality is of words and not of weak hashes."""

import random
import re

from pyspark.sql import functions as F

from herbaria.llm import substring
from herbaria.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_sources_hold_the_factors(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(50)]
    shared = [[rnd.choice(vocab) for _ in range(rnd.choice([36, 50, 120]))] for _ in range(4)]
    docs = []
    for i in range(40):
        words = [f"own{i}x{k}" for k in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) - 30)
            words += s[a:] + [f"gap{rnd.randint(0, 10**9)}"] * rnd.randint(0, 2)
        docs.append((i, "  ".join(words)))
    docs += [(100, None), (101, ""), (102, docs[5][1]), (103, " ".join(["same"] * 80))]
    df = cut(spark.createDataFrame(docs, "doc_id long, text string"), "in")
    keyed = {r.doc_id: r.k for r in df.withColumn("k", F.monotonically_increasing_id()).collect()}
    by_row = {keyed[d]: WORD.findall(t or "") for d, t in docs}
    starts = {}
    for row, words in by_row.items():
        for i in range(len(words) - 34):
            starts.setdefault(tuple(words[i:i + 35]), []).append((row, i))
    found = 0
    for r in substring.remove_repeats(df).collect():
        row = keyed[r.doc_id]
        words, gone = by_row[row], set()
        for i in range(len(words) - 34):
            if len(starts[tuple(words[i:i + 35])]) > 1:
                gone.update(range(i, i + 35))
        covered = set()
        for f in r.factors:
            source = by_row[f.source_row][f.source:f.source + f.end - f.first]
            assert words[f.first:f.end] == source and f.end - f.first >= 35
            assert (f.source_row, f.source) != (row, f.first)
            covered.update(range(f.first, f.end))
            found += 1
        assert covered == gone and r.n_removed == len(gone)
        assert r.kept_text == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert found > 20


def test_regular_words_do_not_collide(spark):
    """Words that polynomials modulo a power of two cannot tell apart, and windows of such patterns."""
    plain = [f"v{i}" for i in range(40)]
    docs = []
    for k, n in enumerate((1024, 2048, 4096)):
        a = thue_morse(n)
        for j, word in enumerate((a, a.translate(str.maketrans("ab", "ba")))):
            docs.append((10 * k + j, " ".join(plain[:17] + [word] + [f"t{k}x{i}" for i in range(17)])))
    pattern = ["x" if i.bit_count() % 2 else "y" for i in range(64)]
    docs += [(50, " ".join(pattern)), (51, " ".join({"x": "y", "y": "x"}[p] for p in pattern))]
    df = cut(spark.createDataFrame(docs, "doc_id long, text string"), "in")
    seen = {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i:i + 35]), []).append((d, i))
    repeated = {d for places in seen.values() if len(places) > 1 for d, _ in places}
    got = {r.doc_id for r in substring.remove_repeats(df).collect() if r.n_removed}
    assert got == repeated and not got & {0, 1, 10, 11, 20, 21}


def test_parse_breaks_where_sources_do():
    assert substring.parse([(0, 3, 7, 10), (3, 1, 7, 13), (4, 2, 7, 40), (6, 1, 8, 42), (20, 1, 8, 56)], 35) == [
        (0, 38, 7, 10), (4, 40, 7, 40), (6, 41, 8, 42), (20, 55, 8, 56)]
