"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself. It is cut into segments, and the segments dealt
by content to blocks, the shuffle partitions, which index them: a block knows each
of its segments and word windows and where else it stands. A document could be
parsed against every block; as segments are dealt by an anchor that equal windows
share, only the block of its own anchor can hold a match, so each segment is looked
up there alone, which finds what all blocks would.

A document is then parsed greedily: a factor (first word, past-the-end word, source
document and word) begins at a window that stands in the index and takes the
following windows as long as their sources follow one another too. Where they do
not, the factor ends, and as every window across that boundary was looked up on its
own, the next factor begins inside it if the match goes on from another place.
Factors are at least one window long; their words are the duplicate spans.

The anchor of a window is its word k-gram with the smallest hash, equal windows have
equal anchors, so only windows with an anchor that occurs twice are looked up. A
segment is the windows in a row that share one anchor; a segment that stands twice
is looked up as a whole, its windows one by one only if it stands once. All counts
are hash aggregates with partial aggregation and all look-ups equi-joins, so hot
passages are reduced before the shuffle and no group of places is collected.

Words are hashed with XXH3, whatever their length, and ranges of words by
polynomials of these hashes; windows are compared by two such hashes, of the window
and of its anchor, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import RollingHash, cut, drop_cut, mix64, small_batches, with_row_key

WINDOW, GRAM = 35, 15
_A, _B, _G = RollingHash(101), RollingHash(202), RollingHash(303)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and where each text's words begin (one more: the end).

    Words that repeat in the batch are hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    begin, words = lists.offsets.to_numpy(), lists.values
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at the ends of a text
    begin = begin - np.concatenate(([0], np.cumsum(blank)))[begin]
    coded = words.filter(pa.array(~blank)).dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy()], begin


def _ranges(hasher: RollingHash, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges [start, end)."""
    return mix64(hasher.of(words, starts, ends), hasher.seed)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the position of the smallest, leftmost of equals, by doubling."""
    best, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        width += step
    return best


class Segments:
    """Windows of a batch of texts, and the segments of windows that share one anchor."""

    def __init__(self, texts: pa.Array, window: int, gram: int) -> None:
        self.words, self.begin = word_hashes(texts)
        owner = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        n = len(self.words) - window + 1
        self.first = self.n = self.doc = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.int64)
        if n <= 0:
            return
        starts = np.arange(len(self.words) - gram + 1)
        grams = _ranges(_G, self.words, starts, starts + gram)
        at = anchors(grams, window - gram + 1)[:n]
        whole = owner[:n] == owner[window - 1:]  # windows that do not cross a text's end
        new = np.flatnonzero(whole & np.append(True, (at[1:] != at[:-1]) | ~whole[:-1] | (owner[1:n] != owner[: n - 1])))
        left = np.append(np.flatnonzero(~whole), n)  # a segment ends where the next begins or a text's windows end
        ends = np.minimum(np.append(new[1:], n), left[np.searchsorted(left, new)])
        self.first, self.n, self.doc = new, ends - new, owner[new]
        self.anchor = grams[at[new]].view(np.int64)

    def at(self) -> np.ndarray:
        """First window of each segment, counted in its text."""
        return self.first - self.begin[self.doc]


def _source(name: str) -> Column:
    """Another place (row, word) of what stands at (row_key, at): the first one, or the last if that is here."""
    here, one = F.col("row_key"), F.col("lo") == F.col("hi")
    row = F.when(one | (F.col("lo") != here), F.col("lo")).otherwise(F.col("hi"))
    at = (F.when(one, F.when(F.col("first") != F.col("at"), F.col("first")).otherwise(F.col("last")))
          .when(F.col("lo") != here, F.col("lo_at")).otherwise(F.col("hi_at")))
    return F.struct(row.alias("row"), at.alias("at")).alias(name)


def _places() -> list[Column]:
    """How often something stands in the corpus, and its first and last place; numbers of fixed size only."""
    return [F.count("*").alias("times"), F.min("row_key").alias("lo"), F.max("row_key").alias("hi"),
            F.min_by("at", "row_key").alias("lo_at"), F.max_by("at", "row_key").alias("hi_at"),
            F.min("at").alias("first"), F.max("at").alias("last")]


def find_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Windows that stand elsewhere, per document: (row_key, ranges array<struct<at, n, row, src>>).

    ``docs`` has row_key and text. In a range, windows of ``window`` words that
    begin at ``n`` following words from ``at`` on each begin at another place of
    the corpus too: the first at word ``src`` of row ``row``. Documents without such a
    window have no row.

    1. Anchors are counted; those that occur twice go back to their documents.
    2. The windows of one anchor in a row form a segment, given by the hash of all
       its words and the hashes of its windows.
    3. A segment that occurs twice is a range. Windows of the other segments are
       counted against all windows of the same anchor.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("row_key", "text")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Segments(batch.column("text"), window, gram)
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(s.doc)), pa.array(s.at(), pa.int32()), pa.array(s.anchor)],
                                             names=["row_key", "at", "anchor"])

    found = cut(texts.mapInArrow(anchor_rows, "row_key long, at int, anchor long"), "anchors")
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    wanted = cut(found.join(again, "anchor").groupBy("row_key").agg(F.collect_list("at").alias("anchors")), "wanted")
    drop_cut(found)

    def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Segments(batch.column("text"), window, gram)
            keep = batch.column("anchors")
            asked = np.repeat(s.begin[:-1], pc.list_value_length(keep).to_numpy()) + pc.list_flatten(keep).to_numpy()
            mine = np.isin(s.first, asked)
            first, n, doc, anchor = s.first[mine], s.n[mine], s.doc[mine], s.anchor[mine]
            begin = np.concatenate(([0], np.cumsum(n)))
            starts = np.repeat(first - begin[:-1], n) + np.arange(begin[-1])
            wins = _ranges(_A, s.words, starts, starts + window).view(np.int64)
            segs = _ranges(_B, s.words, first, first + n + window - 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(doc)), pa.array(s.at()[mine], pa.int32()), pa.array(n, pa.int32()), pa.array(anchor), pa.array(segs),
                 pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(wins))], names=["row_key", "at", "n", "anchor", "segment", "windows"])

    segments = cut(texts.join(wanted.hint("shuffle_hash"), "row_key").select("row_key", "text", "anchors").mapInArrow(
        segment_rows, "row_key long, at int, n int, anchor long, segment long, windows array<long>"), "segments")
    drop_cut(wanted)
    same = ["anchor", "segment", "n"]
    counts = cut(segments.groupBy(*same).agg(*_places()), "times")
    once = counts.filter("times = 1").select(*same)
    repeated = (segments.select("row_key", "at", *same).join(counts.filter("times > 1"), same)
                .select("row_key", "at", "n", _source("s")))
    open_ = (segments.join(once.select("anchor").distinct(), "anchor", "left_semi")
             .select("anchor", "row_key", F.col("at").alias("a"), F.posexplode("windows").alias("i", "w")))
    elsewhere = open_.withColumn("at", F.col("a") + F.col("i")).groupBy("anchor", "w").agg(*_places()).filter("times > 1")
    single = (segments.join(once, same, "left_semi").select("row_key", "anchor", F.col("at").alias("a"), F.posexplode("windows").alias("i", "w"))
              .select("row_key", "anchor", "w", (F.col("a") + F.col("i")).alias("at")))
    partial = single.join(elsewhere, ["anchor", "w"]).select("row_key", "at", F.lit(1).alias("n"), _source("s"))
    row = F.struct("at", "n", F.col("s.row").alias("row"), F.col("s.at").alias("src"))
    ranges = cut(repeated.unionByName(partial).groupBy("row_key").agg(F.collect_list(row).alias("ranges")), "ranges")
    drop_cut(segments)
    drop_cut(counts)
    return ranges


def parse(ranges: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: factors (first word, past-the-end word, source row, source word).

    ``ranges`` (at, n, row, src) say which windows stand elsewhere, and where. A factor
    takes window after window while both they and their sources follow on one
    another; at a boundary the next one begins, inside the words of the last if
    its first window crosses the boundary.
    """
    out: list[tuple[int, int, int, int]] = []
    following = -1
    for at, n, row, src in sorted(ranges):
        first = at
        if out and at == following and (row, src - at) == (out[-1][2], out[-1][3] - out[-1][0]):
            first, _, row, src = out.pop()
        following = at + n
        out.append((first, following - 1 + window, row, src))
    return out


def factors(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The words of ranges (at, n) as spans (first word, past-the-end word): what overlaps or touches is one."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(ranges):
        end = at + n - 1 + window
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((at, end))
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a window that stands anywhere else in the corpus.

    Appends n_words, n_removed, factors (array of first and past-the-end word, and
    the source: the number of its row in the table and a word), spans (array of first
    and past-the-end word: the factors put together) and kept_text (the words left, joined by one space). Null texts
    have no words. Repeated rows count as other places, so all copies of a long
    passage go. Other columns pass through (columns of the new names are
    replaced); an empty table stays empty. Texts with fewer words than a window
    are only split into words.
    """
    new = ["n_words", "n_removed", "factors", "spans", "kept_text"]
    docs = docs.drop(*new)
    keyed = with_row_key(docs, "row_key")
    ranges = find_ranges(keyed.select("row_key", F.col(text_col).alias("text")), window, gram)
    joined = keyed.join(ranges.hint("shuffle_hash"), "row_key", "left").drop("row_key")
    struct = lambda **f: T.ArrayType(T.StructType([T.StructField(k, t) for k, t in f.items()]))
    span, factor = struct(first=T.IntegerType(), end=T.IntegerType()), struct(
        first=T.IntegerType(), end=T.IntegerType(), source_row=T.LongType(), source=T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("factors", factor), T.StructField("spans", span), T.StructField("kept_text", T.StringType())])
    pair = [("first", pa.int32()), ("end", pa.int32())]
    arrow_span, arrow_factor = pa.list_(pa.struct(pair)), pa.list_(pa.struct([*pair, ("source_row", pa.int64()), ("source", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, parses, spans, kept = [], [], [], [], []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column("ranges").to_pylist()):
                words = (text or "").encode("utf-8").split()
                parsed = parse([(r["at"], r["n"], r["row"], r["src"]) for r in found or []], window)
                cuts = factors([(first, end - first + 1 - window) for first, end, *_ in parsed], window)
                left, at = [], 0
                for a, b in cuts:
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words))
                gone.append(len(words) - len(left))
                parses.append([dict(zip(("first", "end", "source_row", "source"), f)) for f in parsed])
                spans.append([{"first": a, "end": b} for a, b in cuts])
                kept.append(b" ".join(left).decode("utf-8"))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "ranges"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(parses, arrow_factor),
                 pa.array(spans, arrow_span), pa.array(kept, pa.string())],
                names=[*(n for n in batch.schema.names if n != "ranges"), *new])

    return joined.mapInArrow(remove, schema)
