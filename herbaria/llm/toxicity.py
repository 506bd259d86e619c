"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings) and patterns; each votes
"toxic", "clean" or abstains. Lexicon voters are mined: the document counts of
all words and word beginnings are taken over all labelled learning rows, a row
weighing 1 / size of its group of verified near copies of one label, and entries
that stand significantly more in toxic documents become voters, beside a seed list.

A generative label model estimates from the votes how often each voter fires on
toxic and on clean documents (expectation maximisation over documents with and
without labels; labelled rows anchor the classes), and the correlations that remain
between voters given the class: a voter's evidence is divided by its effective
number of correlated twins, so ten beginnings of one word do not count ten times.
Its posterior labels, of both kinds of documents, train a linear classifier on all
of the lexicon's words and word beginnings and on the patterns, which scores every
document; neutral words are no features, so long texts gather no noise.

The label model and the classifier are fitted on the driver on a bounded sample
(about ``FIT_ROWS`` labelled rows, and the unlabelled of as many documents, taken by hash); counts cover all
labelled learning rows. The classifier starts from the label model's own odds; an
entry that no sampled row holds keeps the odds counted over all labelled rows. The
lexicon has no bound but the vocabulary of toxic texts; driver and tasks hold it as
one dict.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import Forest, RollingHash, cut, mix64, norm_words, pairs_of_runs, shingle_hashes, small_batches, whole_runs, with_row_key
from herbaria.llm.components import connected_components

#: Bound, a documented parameter: rows of the fitting sample.
FIT_ROWS = 12_000
#: Pairs of votes that are counted at a time, and words that a worker holds.
PAIRS, COUNTED = 4_000_000, 100_000
#: An entry is mined if more than this share of its documents is toxic, at this many standard errors.
MIN_SHARE, SURE = 0.5, 1.96
#: Rows of one label are near copies from this five-word Jaccard on; candidates share two smallest hashes in one of the bands.
COPY_SIMILARITY, COPY_BANDS = 0.8, 8
#: Texts of one band that are compared in one group; larger bands are compared block by block.
COPY_BLOCK = 128
PREFIXES = (4, 5, 6)
CUT = 0.3

#: Seed lexicon of insults; mined entries join it.
SEEDS = ("idiot moron stupid loser pathetic worthless disgusting scum trash clown "
         "idiota imbécil estúpido basura asqueroso idiote imbécile stupide ordure minable "
         "dumm trottel abschaum widerlich erbärmlich").split()

_HASH = RollingHash(9)
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "insult_you": re.compile(r"\byou(?:'re| are| r)?\s+(?:an?\s+|such\s+)?\w*(?:idiot|moron|loser|scum|trash|clown)", re.I),
    "shouting": re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}"),
    "exclaim": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b\w+\*{2,}\w*"),
}


def entries(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text and, marked by ``*``, their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def word_entries(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def copy_weights(rows: DataFrame) -> DataFrame:
    """Append weight to rows (row_key, text, toxic): 1 / size of the row's group of near copies; no row is dropped.

    Copies carry the same label and are linked if the five-word Jaccard of their
    shingles is ``COPY_SIMILARITY``. Texts that share a band are compared with one
    another, those of a large band block by block; two that a band has already
    linked, directly or through others, are not. Texts without words are no copies of each other.
    """
    small_batches(rows.sparkSession)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole, out = [], []
            for text in pdf["text"].tolist():
                words = norm_words(text)
                h = shingle_hashes(_HASH, *words, 5)
                least = np.array([mix64(h, s).min() for s in range(2 * COPY_BANDS)] if len(h) else [], np.uint64)
                whole.append(hashlib.blake2b(words[0], digest_size=16).digest())
                out.append((mix64(least[::2] ^ (least[1::2] >> np.uint64(1))) >> np.uint64(1)).tolist())
            yield pd.DataFrame({"row_key": pdf["row_key"], "toxic": pdf["toxic"], "whole": whole, "keys": out})

    label = (F.col("toxic") == 1).alias("toxic")
    marked = cut(rows.select("row_key", label, "text").mapInPandas(
        keys, "row_key long, toxic boolean, whole binary, keys array<long>"), "copy_keys")
    # Equal texts collapse first, so a text that is repeated often meets its near copies once.
    heads = cut(marked.filter(F.size("keys") > 0).groupBy("toxic", "whole")
                .agg(F.min("row_key").alias("node"), F.first("keys").alias("keys"), F.count("*").alias("n")), "copy_heads")
    links = cut(_copy_links(heads, rows.select(F.col("row_key").alias("node"), "text")), "copy_links")
    found = connected_components(links, "node", "other")
    grouped = heads.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = grouped.groupBy("component").agg(F.sum("n").alias("size"))
    weights = grouped.join(size, "component").select("toxic", "whole", (1 / F.col("size")).alias("weight"))
    weights = marked.select("row_key", "toxic", "whole").join(weights, ["toxic", "whole"], "left").select(
        "row_key", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return rows.join(weights, "row_key")


def _copy_links(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (node, other) of ``heads`` (toxic, node, keys) that share a band; ``texts`` (node, text)."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(_HASH, *norm_words(t), 5)).tobytes() for t in pdf["text"].tolist()]
            yield pd.DataFrame({"node": pdf["node"], "shingles": sets})

    each = heads.select("node", F.posexplode("keys").alias("band", "key"), "toxic")
    group = ["toxic", "band", "key"]
    sizes = each.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").select(
        *group, F.ceil(F.col("n") / COPY_BLOCK).cast("int").alias("blocks"))
    met = cut(each.join(sizes, group), "copy_bands")
    shingles = texts.join(met.select("node").distinct().hint("shuffle_hash"), "node").mapInPandas(shingled, "node long, shingles binary")
    dealt = (met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*group, "node", "mine", F.least("mine", "to").alias("i"), F.greatest("mine", "to").alias("j"))
             .withColumn("g", F.xxhash64(*group, "i", "j")).join(shingles, "node"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, ends in whole_runs(batches, ["g"]):
            sets = [np.frombuffer(s, np.uint64) for s in df["shingles"].tolist()]
            across, mine, node = (df["i"] != df["j"]).to_numpy(), df["mine"].to_numpy(), df["node"].to_numpy()
            forest, out = Forest(len(df)), []
            for x, y in pairs_of_runs(ends):
                for p, q in zip(x.tolist(), y.tolist()):
                    if across[p] and mine[p] == mine[q] or forest.root(p) == forest.root(q):
                        continue
                    a, b = sets[p], sets[q]
                    if min(len(a), len(b)) < COPY_SIMILARITY * max(len(a), len(b)):
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= COPY_SIMILARITY * (len(a) + len(b) - both):
                        forest.join(p, q)
                        out.append((node[p], node[q]))
            ab = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"node": ab[:, 0], "other": ab[:, 1]})

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(compare, "node long, other long")


def count_entries(labelled: DataFrame) -> DataFrame:
    """Weight of documents per entry and class, over all labelled rows (text, toxic, weight): (entry, toxic_docs, clean_docs)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tox, clean = Counter(), Counter()
            for text, toxic, weight in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), pdf["weight"].tolist()):
                counts = tox if toxic else clean
                for e in entries(text):
                    counts[e] += weight
                if len(tox) + len(clean) > COUNTED:  # a worker's memory is bounded; Spark adds the parts
                    yield totals(tox, clean)
                    tox, clean = Counter(), Counter()
            if tox or clean:  # Arrow takes an empty column for numbers
                yield totals(tox, clean)

    def totals(tox: Counter, clean: Counter) -> pd.DataFrame:
        keys = list(tox.keys() | clean.keys())
        return pd.DataFrame({"entry": keys, "toxic_docs": [float(tox[k]) for k in keys], "clean_docs": [float(clean[k]) for k in keys]})

    return (labelled.select("text", "toxic", "weight").mapInPandas(count, "entry string, toxic_docs double, clean_docs double")
            .groupBy("entry").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs")))


def fired(text: str | None, at: dict[str, int]) -> list[int]:
    """Voters that vote "toxic" on a text: entries of the lexicon by number, then patterns."""
    hits = sorted(at[e] for e in entries(text) if e in at)
    return hits + [len(at) + i for i, p in enumerate(_PATTERNS.values()) if p.search(text or "")]


@dataclass
class Votes:
    """Votes that do not abstain, as (row, voter) pairs; rows with a vote for toxic."""

    owner: np.ndarray
    cols: np.ndarray
    voters: int
    toxic: np.ndarray

    @classmethod
    def of(cls, v: "Votes | np.ndarray") -> "Votes":
        return v if isinstance(v, Votes) else cls(*np.nonzero(v), v.shape[1], (v == 1).any(axis=1))

    def by_voter(self, x: np.ndarray) -> np.ndarray:
        """Sum of a value of the rows over the votes of each voter."""
        return np.bincount(self.cols, x[self.owner], self.voters)

    def together(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of voters (i, j), in both orders and with themselves, and the rows on which both vote.

        Voters are taken a few at a time, so that only their pairs are held.
        """
        order = np.argsort(self.owner, kind="stable")
        cols = self.cols[order]
        size = np.bincount(self.owner, minlength=len(self.toxic))
        begin = np.cumsum(size) - size
        by_col = np.argsort(cols, kind="stable")
        row = self.owner[order][by_col]
        votes_on = size[row]  # for each vote, the votes of its row
        work = np.cumsum(votes_on)
        lo = 0
        while lo < len(row):
            last = cols[by_col[min(len(row) - 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + PAIRS)))]]
            hi = max(int(np.searchsorted(cols[by_col], last, "right")), lo + 1)
            n, first = votes_on[lo:hi], begin[row[lo:hi]]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, both = np.unique(np.repeat(cols[by_col[lo:hi]], n) * self.voters + cols[at], return_counts=True)
            yield pair // self.voters, pair % self.voters, both.astype(float)
            lo = hi

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sum of a value of the voters over the votes on each row."""
        return np.bincount(self.owner, x[self.cols], len(self.toxic))


def votes(rows: list[list[int]], n_entries: int) -> Votes:
    """Votes of every voter on every row of fired voters: toxic, clean or abstaining.

    Two more voters speak for clean: no entry fired, and no pattern either.
    """
    n = n_entries + len(_PATTERNS)
    cast = [[*hits, *([n] if all(h >= n_entries for h in hits) else []), *([] if hits else [n + 1])] for hits in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cast])
    return Votes(owner, np.fromiter((c for r in cast for c in r), np.int64, len(owner)), n + 2, np.array([bool(h) for h in rows]))


@dataclass
class LabelModel:
    """Class-conditional voters with correlation-discounted evidence."""

    prior: float = 0.1
    on_toxic: np.ndarray = field(default_factory=lambda: np.empty(0))
    on_clean: np.ndarray = field(default_factory=lambda: np.empty(0))
    twins: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posterior(self, v: Votes | np.ndarray) -> np.ndarray:
        pro = np.log(self.on_toxic / self.on_clean) / self.twins
        con = np.log((1 - self.on_toxic) / (1 - self.on_clean)) / self.twins
        z = np.log(self.prior / (1 - self.prior)) + con.sum() + Votes.of(v).by_row(pro - con)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, v: Votes | np.ndarray, known: np.ndarray, rounds: int = 12) -> "LabelModel":
        """``known``: 1 or 0 for labelled rows, NaN for others; they start from the votes and follow the model."""
        v = Votes.of(v)
        labelled = ~np.isnan(known)
        q = np.where(labelled, known, v.toxic * 0.9 + 0.02)
        self.twins = np.ones(v.voters)
        for step in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-3, 0.999))
            self.on_toxic = (v.by_voter(q) + 0.1) / (q.sum() + 1)
            self.on_clean = (v.by_voter(1 - q) + 0.1) / ((1 - q).sum() + 1)
            if step in (1, rounds // 2):
                self.twins = self._correlations(v, q)
            p = self.posterior(v)
            # A label is strong but not certain evidence, so single mislabelled rows bend nothing.
            q = np.where(labelled, 0.95 * known + 0.05 * p, p)
        return self

    def _correlations(self, v: Votes, q: np.ndarray) -> np.ndarray:
        """Effective number of twins: sum of squared correlations that remain given the class.

        The covariance of two voters is the number of rows on which both vote, less
        what the classes explain; the latter is linear in four numbers of each voter.
        So the sums are exact at any number of voters, from the pairs that do vote
        together and four by four sums, without a matrix of all pairs.
        """
        a, b, r = self.on_toxic, self.on_clean, 1 - q
        on_q, on_r, n = v.by_voter(q), v.by_voter(r), v.by_voter(np.ones(len(q)))
        square = a * a * (q @ q) + 2 * a * b * (q @ r) + b * b * (r @ r) - 2 * (a * on_q + b * on_r) + n
        scale = np.sqrt(np.maximum(square, 1e-9))
        own = np.stack((a, b, on_q, on_r))  # explained(i, j) = part[:, i] @ own[:, j]
        part = np.stack((a * (q @ q) + b * (q @ r) - on_q, a * (q @ r) + b * (r @ r) - on_r, -a, -b))
        total = np.einsum("ki,kl,li->i", part, (own / scale**2) @ own.T, part)
        for i, j, both in v.together():
            explained = np.einsum("kn,kn->n", part[:, i], own[:, j])
            total += np.bincount(i, (both * both + 2 * both * explained) / scale[j] ** 2, v.voters)
        return np.maximum(1.0, total / scale**2)

    def odds(self) -> np.ndarray:
        """Evidence of each voter's vote: its log odds of toxic, shared with its twins."""
        return np.log(self.on_toxic / self.on_clean) / self.twins


def fit_linear(rows: list[list[int]], target: np.ndarray, start: np.ndarray, rounds: int = 400, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features by Adam on soft labels; weights are drawn to ``start`` and stay there without rows."""
    n = len(start)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((c for r in rows for c in r), np.int64, len(owner))
    x = np.append(start, 0.0)  # the last one is the bias
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, x[cols], len(rows)) + x[n]
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.append(np.bincount(cols, g[owner], n) + penalty * len(rows) * (x[:n] - start), g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        x -= 0.15 / (1 + step / 200) * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return x[:n], float(x[n])


@dataclass
class ToxicityModel:
    """Weights of the linear classifier by entry, and by name in angle brackets for patterns."""

    weights: dict[str, float]
    bias: float
    lexicon: list[str]
    prior: float

    def scorer(self):
        """A function text -> score; a word's weight is summed once and kept."""
        weights, known = self.weights, {}
        patterns = [(p, weights[f"<{k}>"]) for k, p in _PATTERNS.items() if weights.get(f"<{k}>")]

        def score(text: str | None) -> float:
            words = set(_WORD.findall((text or "").lower()))
            if len(known) > COUNTED:
                known.clear()
            seen, z = set(), self.bias
            for w in words:
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = tuple(e for e in word_entries(w) if e in weights)
                for e in hits:
                    if e not in seen:
                        seen.add(e)
                        z += weights[e]
            for p, w in patterns:
                if p.search(text or ""):
                    z += w
            return 1 / (1 + float(np.exp(-min(max(z, -40.0), 40.0))))

        return score


def train(labelled: DataFrame, others: DataFrame | None = None) -> ToxicityModel:
    """Mine voters over all of ``labelled`` (key, text, toxic), fit on a bounded sample of it and on ``others`` (text), a sample without labels.

    Without any labelled row, or with one class only, the seed list alone is used.
    """
    rows = cut(with_row_key(labelled.select("key", "text", "toxic").filter("toxic is not null"), "row_key"), "labelled")
    rows = cut(copy_weights(rows), "learning")
    by_class = rows.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()
    totals = {r["toxic"]: r["n"] for r in by_class}
    base = sum(r["weight"] for r in by_class if r["toxic"]) / max(1.0, sum(r["weight"] for r in by_class))
    if not 0 < base < 1:
        return ToxicityModel({e: 4.0 for e in SEEDS}, -3.0, list(SEEDS), base)
    docs = F.col("toxic_docs") + F.col("clean_docs")
    share = F.col("toxic_docs") / docs
    # Lower end of Wilson's interval of the toxic share; it depends on the entry's own counts only.
    z2 = SURE * SURE
    least = (share + z2 / (2 * docs) - SURE * F.sqrt(share * (1 - share) / docs + z2 / (4 * docs * docs))) / (1 + z2 / docs)
    mined = count_entries(rows).filter(least >= MIN_SHARE).collect()  # follows the vocabulary of toxic texts
    counted = {r["entry"]: np.log((r["toxic_docs"] + 0.5) / (r["clean_docs"] + 0.5) * (1 - base) / base) for r in mined}
    lexicon = list(dict.fromkeys([*SEEDS, *sorted(counted)]))
    at = {e: i for i, e in enumerate(lexicon)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def fire(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fired(t, at) for t in s.tolist()])

    # About FIT_ROWS / 2 rows of each class and FIT_ROWS others by hash; the driver gets the numbers of fired voters only.
    turn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20))
    part = F.when(F.col("toxic") == 1, F.lit(FIT_ROWS / 2 / totals[True])).otherwise(F.lit(FIT_ROWS / 2 / totals[False]))
    sample = rows.filter(turn < part * (1 << 20)).select(fire("text").alias("hits"), "toxic").limit(2 * FIT_ROWS).collect()
    known = np.array([float(r["toxic"]) for r in sample])
    if not 0 < known.sum() < len(known):
        return ToxicityModel({e: 4.0 for e in SEEDS}, -3.0, lexicon, base)
    hits = [r["hits"] for r in sample]
    if others is not None:
        free = others.select(fire("text").alias("hits")).limit(2 * FIT_ROWS).collect()
        hits += [r["hits"] for r in free]
        known = np.append(known, np.full(len(free), np.nan))
    v = votes(hits, len(lexicon))
    model = LabelModel().fit(v, known)
    target = model.posterior(v)
    # Weights start from the evidence of the votes. An entry that no sampled row holds has none; it keeps what all
    # labelled rows tell of it, shared with the other entries of the word.
    names = [*lexicon, *(f"<{k}>" for k in _PATTERNS)]
    seen = np.bincount(v.cols, minlength=v.voters)[: len(names)] > 0
    rest = np.array([counted.get(e, 0.0) / len(word_entries(e.replace("*", "."))) for e in names])
    start = np.where(seen, model.odds()[: len(names)], rest)
    w, b = fit_linear(hits, target, start)
    # The sample holds the classes in other shares than the learning rows.
    mean = target.mean()
    b += float(np.log(base / (1 - base)) - np.log(mean / (1 - mean)))
    return ToxicityModel({e: float(x) for e, x in zip(names, w) if x}, b, lexicon, base)


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= 0.3); null and empty texts get the bias only."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the mined lexicon

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for s in batches:
            yield pd.Series([one(t) for t in s.tolist()], dtype=float)

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(doc_id):
    """True for rows whose labels are not learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents (doc_id, text, ...); learn from labelled rows that are not held out.

    Appends held_out, score and predicted. Rows of ``labels`` with a null id or
    label teach nothing; of repeated label rows the larger label counts. Null
    ids are not held out. Repeated documents are scored each; an empty table
    stays empty. Columns of the new names are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    usable = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # Hashed on both sides at every size: the labels grow with the corpus.
    learn = docs.select("doc_id", "text").join(usable.hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic")
    labelled = labels.filter("doc_id is not null").select("doc_id").distinct()
    # about FIT_ROWS of all documents by hash, those without a label among them; sampled before any shuffle
    share = min(1.0, FIT_ROWS / max(1, docs.count()))
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("others")), F.lit(1 << 20)) < share * (1 << 20))
    others = some.join(labelled.hint("shuffle_hash"), "doc_id", "left_anti").select("text")
    return score_texts(docs.withColumn("held_out", held_out(F.col("doc_id"))), train(learn, others))
