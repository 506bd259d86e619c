"""Hard negatives by scores bounded along a spanning tree of anchors.

Vectors are scaled to integers, so scores (inner products) are exact. Anchors are
dealt to blocks of near neighbours; each block is joined by a minimum spanning tree.
All rows lie in blocks too, one record a block, and every anchor block meets every
row block. In such a meeting the tree's root is scored against all rows. Each other
anchor takes its parent's score, or bounds of it, plus and minus the length of the
tree edge times the row's norm (Cauchy-Schwarz): these bound its own scores, and
only rows whose bounds overlap the scores that are asked for are scored again.

A first round asks for the best rows of the anchor's own label, the positives; a
second one for the rows of other labels in the window below each positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herbaria.llm.common import cut

#: Anchors and rows of a block: a meeting holds bounds of all pairs, 16 bytes each.
ANCHORS, ROWS = 256, 8192
#: Records of an Arrow batch that holds whole blocks.
BLOCK_RECORDS = 2
#: Edges times norms are widened by this share, far over their rounding.
SLACK = 1e-9


def integer_rows(df: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, anchor, vec): components floor(scale * x) as packed 64-bit integers.

    Rows with a null id, label or vector, or a null or non-finite component, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, keep, packed = batch.column("vec"), [], []
            for i, v in enumerate(vectors):
                if v.is_valid and not v.values.null_count:
                    x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all():
                        if (np.abs(x) >= 2.0**62).any():
                            raise OverflowError("a scaled component does not fit 62 bits")
                        keep.append(i)
                        packed.append(x.astype("<i8").tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(packed, pa.binary())], names=["id", "label", "anchor", "vec"])

    source = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vec"))
    return source.filter("id is not null and label is not null and vec is not null").mapInArrow(
        run, "id long, label long, anchor boolean, vec binary")


def matrix(packed: list[bytes]) -> np.ndarray:
    """Vectors as rows, missing last components as 0."""
    rows = [np.frombuffer(p, "<i8") for p in packed]
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    return np.array([np.concatenate((r, np.zeros(width - len(r), np.int64))) for r in rows])


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree: visiting order, parent place in it (-1: root), edge length."""
    n = len(x)
    best, parent, order = np.full(n, np.inf), np.full(n, -1), []
    place, done, at = np.zeros(n, np.int64), np.zeros(n, bool), 0
    for i in range(n):
        done[at] = True
        place[at] = i
        order.append(at)
        d = np.sqrt(((x - x[at]).astype(np.float64) ** 2).sum(axis=1))
        nearer = ~done & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
        if i + 1 < n:
            at = int(np.where(done, np.inf, best).argmin())
    order = np.array(order)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    return order, up, np.where(up < 0, 0, best[order])


def anchor_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """One record per block of near anchors, in tree order: block, ids, labels, vecs, up, edge.

    Anchors are dealt by range of one random projection, ties by id, and a task
    cuts its range into blocks, so that equal vectors in any number are split.
    """

    def project(vecs: pd.Series) -> pd.Series:
        x = matrix(list(vecs)).astype(np.float64)
        axis = np.random.Generator(np.random.PCG64(11)).standard_normal(x.shape[1])
        return pd.Series((x * axis).sum(axis=1) / np.maximum(1, np.sqrt((x * x).sum(axis=1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = pd.DataFrame(), TaskContext.get().partitionId() << 32
        for pdf in batches:
            held = pd.concat([held, pdf], ignore_index=True)
            while len(held) >= ANCHORS:
                yield block(held.iloc[:ANCHORS], number)
                held, number = held.iloc[ANCHORS:], number + 1
        if len(held):
            yield block(held, number)

    def block(pdf: pd.DataFrame, number: int) -> pd.DataFrame:
        order, up, edge = spanning_tree(matrix(list(pdf["vec"])))
        pdf = pdf.iloc[order]
        return pd.DataFrame({"block": [number], "ids": [pdf["id"].to_numpy()], "labels": [pdf["label"].to_numpy()],
                             "vecs": [list(pdf["vec"])], "up": [up], "edge": [edge]})

    near = F.pandas_udf(project, "double")
    dealt = anchors.withColumn("at", near("vec")).repartitionByRange(max(1, -(-n // ANCHORS)), "at", "id").sortWithinPartitions("at", "id")
    return dealt.select("id", "label", "vec").mapInPandas(
        run, "block long, ids array<long>, labels array<long>, vecs array<binary>, up array<int>, edge array<double>")


def row_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One record per block of rows, sorted by label: row_block, row_ids, row_labels, row_vecs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "label", "vec"]).sort_values(["label", "id", "vec"])
        return pd.DataFrame({"row_block": pdf["row_block"].iloc[:1], "row_ids": [pdf["id"].to_numpy()],
                             "row_labels": [pdf["label"].to_numpy()], "row_vecs": [list(pdf["vec"])]})

    keyed = rows.withColumn("row_block", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(n_blocks)))
    return keyed.groupBy("row_block").applyInPandas(run, "row_block long, row_ids array<long>, row_labels array<long>, row_vecs array<binary>")


class Meeting:
    """One block of anchors against one block of rows: bounds along the tree, exact scores on demand."""

    def __init__(self, anchors: list[bytes], up: np.ndarray, edge: np.ndarray, rows: list[bytes]) -> None:
        both = matrix([*anchors, *rows])  # one width
        self.a, self.x = both[: len(anchors)], both[len(anchors):]
        top = float(np.abs(self.a).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, both.shape[1])
        if top >= 2.0**63:
            raise OverflowError("scores do not fit 64 bits")
        self.exact = np.float64 if top < 2.0**53 else np.int64  # doubles add such integers exactly, and faster
        self.rounding = 0.0 if top < 2.0**53 else top * 2.0**-52
        self.slack = top * 2.0**-50  # over the rounding of one addition along the tree
        self.a, self.x = self.a.astype(self.exact), self.x.astype(self.exact)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.up, self.edge = up, edge

    def walk(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor in tree order: its place, the rows scored again, their exact scores.

        ``wanted(place, low, high)`` marks the rows whose bounds overlap what is asked for.
        """
        low, high = np.empty((len(self.a), len(self.x))), np.empty((len(self.a), len(self.x)))
        for i, up in enumerate(self.up):
            if up < 0:
                low[i], high[i] = -np.inf, np.inf
            else:
                reach = self.edge[i] * self.norm * (1 + SLACK) + self.slack
                low[i], high[i] = low[up] - reach, high[up] + reach
            again = np.flatnonzero(wanted(i, low[i], high[i])) if up >= 0 else np.arange(len(self.x))
            score = (self.x if len(again) == len(self.x) else self.x[again]) @ self.a[i]
            low[i, again], high[i, again] = score - self.rounding, score + self.rounding
            yield i, again, score.astype(np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then rising id."""
    if len(score) > 4 * k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        few = np.flatnonzero(score >= bound)
        return few[np.lexsort((ids[few], -score[few]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _meet(anchors: DataFrame, rows: DataFrame, n_blocks: int, find, schema: str) -> DataFrame:
    """Every anchor block beside every row block, one meeting a record: ``find(record)`` gives a frame.

    Both sides are dealt by row block, so a row block is shuffled once and an anchor
    block once per row block; a sorted join holds one row block at a time.
    """
    sides = anchors.withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record in pdf.itertuples(index=False):
                yield find(record)

    met = sides.repartition(n_blocks, "row_block").hint("merge").join(rows.repartition(n_blocks, "row_block"), "row_block")
    return met.mapInPandas(run, schema)


@contextmanager
def _batches_of(spark: SparkSession, records: int) -> Iterator[None]:
    """Bound the records of an Arrow batch for the jobs run inside; the caller's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _first(df: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   scale: int = 256, k_positives: int = 5, k_negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchors among the rows, ``label`` gives the label. The
    positives of an anchor are its best ``k_positives`` other rows of the same label;
    for each, the best ``k_negatives`` rows of other labels are returned whose score
    is from ``low_percent`` % to 100 % of the positive's. Ties go to the smaller id.
    A row with a null id, label or vector, or a null or non-finite component, takes
    no part. Shorter vectors count as filled with zeros, an empty one as zero. Rows that repeat
    an id, a label and a vector count once; rows with one id but other contents are
    rows of their own, yet never each other's positives. An empty table gives no
    rows; extra columns are not read. Scores over 64 bits raise OverflowError.
    """
    spark = df.sparkSession
    with _batches_of(spark, 500):
        rows = cut(integer_rows(df, id_col, vector_col, label, anchor, scale), "negatives-rows")
        chosen = rows.filter("anchor").select("id", "label", "vec").distinct()
        n_blocks = max(1, -(-rows.count() // ROWS))
        tree = cut(anchor_blocks(chosen, chosen.count()), "negatives-anchors")
        blocks = cut(row_blocks(rows, n_blocks), "negatives-blocks")

    def positives_of(record) -> pd.DataFrame:
        ids, labels = np.asarray(record.row_ids), np.asarray(record.row_labels)
        a_ids, a_labels = np.asarray(record.ids), np.asarray(record.labels)
        meeting = Meeting(list(record.vecs), np.asarray(record.up), np.asarray(record.edge), list(record.row_vecs))

        def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            mark = np.zeros(len(ids), bool)
            same = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
            if len(same):
                at = max(0, len(same) - k_positives)
                mark[same] = high[same] >= np.partition(low[same], at)[at]
            return mark

        out = []
        for i, again, score in meeting.walk(wanted):
            keep = (labels[again] == a_labels[i]) & (ids[again] != a_ids[i])
            again, score = again[keep], score[keep]
            top = _best(ids[again], score, k_positives)
            out.append(pd.DataFrame({"anchor_id": a_ids[i], "anchor_label": a_labels[i], "place": i, "id": ids[again[top]], "score": score[top]}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, "block", record.block)
        return found

    anchor_key = ["block", "place"]
    near = _meet(tree, blocks, n_blocks, positives_of, "block long, anchor_id long, anchor_label long, place int, id long, score long")
    with _batches_of(spark, BLOCK_RECORDS):
        positives = cut(_first(near, anchor_key, k_positives, "nth"), "negatives-positives")
    asked = positives.groupBy("block").agg(F.collect_list(F.struct("place", "id", "score")).alias("asked"))

    def negatives_of(record) -> pd.DataFrame:
        ids, labels, a_labels, a_ids = (np.asarray(x) for x in (record.row_ids, record.row_labels, record.labels, record.ids))
        meeting = Meeting(list(record.vecs), np.asarray(record.up), np.asarray(record.edge), list(record.row_vecs))
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for p in record.asked:
            s = int(p["score"])
            windows.setdefault(p["place"], []).append((p["id"], s, -(-low_percent * s // 100)))

        def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            mark = np.zeros(len(ids), bool)
            for _, top, bottom in windows.get(i, []):
                if bottom <= top:
                    mark |= (high >= bottom) & (low <= top)
            return mark & (labels != a_labels[i])

        out = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("place", "anchor_id", "positive_id", "positive_score", "id", "score")})]
        for i, again, score in meeting.walk(wanted):
            other = labels[again] != a_labels[i]
            again, score = again[other], score[other]
            for positive, top, bottom in windows.get(i, []):
                inside = np.flatnonzero((score >= bottom) & (score <= top))
                best = inside[_best(ids[again[inside]], score[inside], k_negatives)]
                if len(best):
                    out.append(pd.DataFrame({"place": i, "anchor_id": a_ids[i], "positive_id": positive, "positive_score": top,
                                             "id": ids[again[best]], "score": score[best]}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, "block", record.block)
        return found

    hard = _meet(tree.join(asked, "block"), blocks, n_blocks, negatives_of,
                 "block long, place int, anchor_id long, positive_id long, positive_score long, id long, score long")
    ranked = _first(hard, [*anchor_key, "positive_id", "positive_score"], k_negatives, "rank")
    with _batches_of(spark, BLOCK_RECORDS):
        ranked = cut(ranked, "negatives")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
