"""Helpers shared by the training-data operators: tables, lineage cuts, words, hashes.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``; a null text has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.session import checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch: a batch of very long texts must still fit a Python worker.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, as single texts can be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The shuffle files of the finished job are garbage now, but Spark removes them
    only when the driver's JVM collects the objects that stand for them, so that
    is asked for here; else a chain of jobs holds the sum of its shuffles on disk.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add a key that is unique per row, also where ids repeat or are null.

    It depends on the split of the input files only, so a task that runs again
    after a lost executor gives the same keys; ``df`` must be a scan with
    projections or filters, as all callers pass.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def norm_words(text: str | None, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space as UTF-8, and where each word starts and ends."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        raw = raw.lower()  # bytes.lower touches A-Z only
    joined = b" ".join(raw.split())
    if not joined:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    return joined, starts, ends


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Polynomial hashes (mod 2^64) of any byte ranges of one buffer.

    ``H[j] - H[i]`` is the sum of ``value(byte) * m**position``; multiplying by
    ``m**-i`` makes it independent of the position. Bytes first go through a
    table of random 64-bit values, so regular texts do not cancel out.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.m = int(rng.integers(2**62, 2**63)) * 8 + 5 & 0xFFFFFFFFFFFFFFFF
        self.inv = pow(self.m, -1, 2**64)
        self.seed = seed

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = RollingHash._powers.get(self.seed)
        if have is None or len(have[0]) < n:
            size = max(1 << 14, 1 << (n - 1).bit_length())
            have = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (self.m, self.inv))
            RollingHash._powers[self.seed] = have
        return have

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the bytes ``data[starts[i]:ends[i]]``; mix them before use."""
        return self.of(self.values[data], starts, ends)

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the 64-bit numbers ``values[starts[i]:ends[i]]``; mix them before use."""
        up, down = self._table(len(values) + 1)
        prefix = np.empty(len(values) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)


def shingle_hashes(hasher: RollingHash, joined: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; fewer words: one of the whole sequence; none: none."""
    if not len(starts):
        return np.empty(0, np.uint64)
    k = min(n, len(starts))
    count = len(starts) - k + 1
    return mix64(hasher.ranges(np.frombuffer(joined, np.uint8), starts[:count], ends[k - 1:]), hasher.seed)


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Cut a stream sorted by ``keys`` into frames of whole groups, with the end of each row's group.

    Holds one Arrow batch and the group that runs over its end; callers bound
    the size of a group by splitting large ones first.
    """
    held: list[pd.DataFrame] = []

    def ready(df: pd.DataFrame, new: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        heads = np.append(np.flatnonzero(new), len(df))
        return df, np.repeat(heads[1:], np.diff(heads))

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        k = pdf[keys].to_numpy()
        if (k[0] == k[-1]).all() and (len(held) == 1 or (held[0][keys].iloc[0].to_numpy() == k[0]).all()):
            continue  # still inside one group
        df = pd.concat(held, ignore_index=True)
        k = df[keys].to_numpy()
        new = np.append(True, (k[1:] != k[:-1]).any(axis=1))
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield ready(df.iloc[:last].reset_index(drop=True), new[:last])
        held = [df.iloc[last:]]
    if held:
        df = pd.concat(held, ignore_index=True)
        k = df[keys].to_numpy()
        yield ready(df, np.append(True, (k[1:] != k[:-1]).any(axis=1)))


def pairs_of_runs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (x, y), x < y, inside runs, one array of pairs for each distance y - x."""
    at = np.arange(len(ends))
    x, d = at, 0
    while True:
        d += 1
        x = x[ends[x] - x > d]
        if not len(x):
            return
        yield x, x + d


class Forest:
    """Union-find over positions of one frame; ``join`` is true when it merged two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
        return p != q
