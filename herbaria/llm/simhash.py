"""SimHash near-dedup: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most
``d`` of their 8 bytes, so they agree in at least ``8 - d`` byte positions: the
guaranteed minimum of shared positional bytes. The index lists fingerprints
under positional bytes. A single byte is too frequent a key for a large corpus
(256 values), so a posting is keyed by several positional bytes together: the
positions are dealt to groups such that any ``8 - d`` positions hold all
positions of at least one key (pigeonhole), which loses no pair. Pairs that meet
under a key have their shared positional bytes tallied; those that reach the
minimum are verified by bit distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import Forest, cut, norm_words, pairs_of_runs, small_batches, whole_runs, with_row_key
from herbaria.llm.components import connected_components

SEED = 42
BLOCK = 1024


def simhash64(text: str | None, n_words: int = 4) -> int:
    """Fingerprint of one text: bit i is 1 if set in over half the shingle hashes."""
    joined, starts, ends = norm_words(text, lower=True)
    if not len(starts):
        return 0
    k = min(n_words, len(starts))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1:].tolist())),
                    np.uint64, len(starts) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprint(text, n_words: int = 4):
    """Column of signed 64-bit SimHash fingerprints (null text: 0)."""

    @F.pandas_udf(T.LongType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = np.fromiter((simhash64(t, n_words) for t in s.tolist()), np.uint64, len(s))
            yield pd.Series(v.view(np.int64))

    return udf(text)


def position_keys(max_bits: int, width: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``8 - max_bits`` positions contain one.

    Positions are dealt to few groups; a key takes ``width`` positions of one
    group, or, where no dealing can guarantee that, greedily any uncovered set.
    """
    need = 8 - max_bits
    if need < 1:
        raise ValueError("at most 7 differing bits can be found through shared bytes")
    width = min(width, need)
    left = set(itertools.combinations(range(8), need))
    keys: list[tuple[int, ...]] = []
    while left:
        best = max(itertools.combinations(range(8), width),
                   key=lambda k: (sum(set(k) <= set(x) for x in left), [-i for i in k]))
        keys.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return keys


def fingerprint_links(prints: DataFrame, max_bits: int = 4, width: int = 3) -> DataFrame:
    """Linking pairs (a, b) among distinct fingerprints of column ``fp``.

    Returns enough verified pairs to connect everything that is connected: in a
    posting list each fingerprint is compared with all others, and a pair is
    left out only where the list already joins both. Lists over ``BLOCK``
    fingerprints are compared block by block in separate groups.
    """
    need, keys = 8 - max_bits, position_keys(max_bits, width)
    fp = F.col("fp")

    def byte(i: int):
        return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))

    def packed(k: int, at: tuple[int, ...]):
        out = F.lit(k).cast("long")
        for i in at:
            out = out * 256 + byte(i)
        return out

    postings = prints.select("fp").distinct().select(
        "fp", F.explode(F.array(*[packed(k, at) for k, at in enumerate(keys)])).alias("key"))
    postings = cut(postings, "postings")
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # A list of b blocks gives the groups (i, j), i <= j < b; a row goes to those that name its block.
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = (postings.join(sizes, "key").withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, ends in whole_runs(batches, ["key", "i", "j"]):
            fps = df["fp"].to_numpy(np.int64)
            bytes_, bits = fps.view(np.uint8).reshape(-1, 8), fps.view(np.uint64)
            across, mine_ = (df["i"] != df["j"]).to_numpy(), df["mine"].to_numpy()
            forest, out = Forest(len(df)), []
            for x, y in pairs_of_runs(ends):
                ok = (bytes_[x] == bytes_[y]).sum(axis=1) >= need
                ok[ok] = np.bitwise_count(bits[x[ok]] ^ bits[y[ok]]) <= max_bits
                ok &= ~across[x] | (mine_[x] != mine_[y])
                out += [(p, q) for p, q in zip(x[ok].tolist(), y[ok].tolist()) if forest.join(p, q)]
            ab = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": fps[ab[:, 0]], "b": fps[ab[:, 1]]})

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(compare, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4,
                  max_bits: int = 4, extra: list[str] | None = None) -> DataFrame:
    """Fingerprint every text and group the documents whose fingerprints link.

    Returns (id_col, fp long, component_id): the smallest id reachable through
    fingerprints at most ``max_bits`` apart. Equal fingerprints always link.
    Null and empty texts have fingerprint 0. Rows with a null id are kept with
    the component of their group (null if no row of it has an id); repeated rows
    come back repeated. An empty table gives no rows. Other columns are ignored
    but for those named in ``extra``, which are passed through.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select(id_col, *(extra or []), fingerprint(F.col(text_col), n_words).alias("fp")), "simhash")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    links = fingerprint_links(least, max_bits)
    comp = cut(connected_components(links, "a", "b"), "components")
    named = comp.withColumnRenamed("node", "fp").join(least, "fp")
    low = named.groupBy("component").agg(F.min("least_id").alias("low"))
    by_fp = cut(least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").join(low, "component", "left")
                .select("fp", F.coalesce("low", "least_id").alias("component_id")), "classes")
    return prints.join(by_fp, "fp").select(id_col, *(extra or []), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4,
             max_bits: int = 4) -> DataFrame:
    """Documents without near copies: of each group the row with the smallest id stays.

    Null ids come last; of several rows with the smallest id the first read
    stays. Columns are unchanged; null and empty texts form one group, of which
    one row stays. An empty table stays empty.
    """
    keyed = with_row_key(docs, "_row")
    found = cut(simhash_dedup(keyed.select("_row", F.col(id_col).alias("_id"), F.col(text_col).alias("_text")),
                              "_row", "_text", n_words, max_bits, extra=["_id"]), "simhash_rows")
    stay = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).getField("_row").alias("_row")).select("_row")
    return keyed.join(stay, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
