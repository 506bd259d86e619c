"""Embedding near-dedup by lattice hashing.

Vectors of one label are compared by cosine. In each of several tables a vector
is projected by random orthonormal directions to blocks of 8 dimensions, and
each block is decoded to its nearest point of the E8 lattice; the points of all
blocks name the home cell. A vector also probes the neighbouring cells that lie
nearest (one block moved by a shortest lattice vector). Two vectors meet where
one's home is the other's home or probe; every pair that meets is verified by
its cosine in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.llm.common import Forest, cut, mix64, pairs_of_runs, whole_runs, with_row_key
from herbaria.llm.components import connected_components

#: Production parameters; see ``recall`` in the tests for the chance of a miss.
TABLES, BLOCKS, CELL, PROBES, SEED = 10, 2, 0.5, 4, 7
BLOCK_ROWS = 512


@lru_cache(None)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the worst rounding round."""
    r = np.round(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    worst = np.argmax(np.abs(x[odd] - r[odd]), axis=1)
    gap = x[odd, worst] - r[odd, worst]
    r[odd, worst] += np.where(gap >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the even-sum integers and their shift by one half."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@lru_cache(8)
def _projections(dim: int, tables: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    width = 8 * blocks
    q = np.stack([np.linalg.qr(rng.standard_normal((max(dim, width), width)))[0][:dim] for _ in range(tables)])
    return q * np.sqrt(max(dim, width) / width), rng.integers(1, 2**62, (tables, blocks, 8)) * 2 + 1


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, cell: float = CELL, probes: int = PROBES,
          seed: int = SEED) -> np.ndarray:
    """Cell numbers, shape (rows, tables, 1 + probes); the home cell comes first."""
    proj, coef = _projections(unit.shape[1], tables, blocks, seed)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    moves = (2 * shortest()).astype(np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            y = (unit @ proj[t]).reshape(len(unit), blocks, 8) / cell
            home, gain, step = np.zeros(len(unit), np.int64), [], []
            for b in range(blocks):
                p = nearest_e8(y[:, b])
                home += ((2 * p).astype(np.int64) * coef[t, b]).sum(axis=1)
                gain.append((y[:, b] - p) @ shortest().T)
                step.append((moves * coef[t, b]).sum(axis=1))
            gain_, step_ = np.concatenate(gain, axis=1), np.concatenate(step)
            best = np.argsort(-gain_, axis=1, kind="stable")[:, :probes]
            keys = np.concatenate((home[:, None], home[:, None] + step_[best]), axis=1)
            out[:, t] = mix64(keys.view(np.uint64), seed + t + 1).view(np.int64)
    return out


def _usable(embedding, label):
    """True for vectors that may link: a label, and finite components that are not all zero."""
    big = F.lit(float("inf"))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return label.isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair and table: same home; a's home is probed by b; b's home is probed by a."""
    ha, hb = a[:, :, :1], b[:, :, :1]
    return (ha == hb)[:, :, 0], (ha == b[:, :, 1:]).any(axis=2), (hb == a[:, :, 1:]).any(axis=2)


def _first_meeting(a: np.ndarray, b: np.ndarray, t: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """True where cell ``cell`` of table ``t`` is the one place that counts for the pair (a, b)."""
    same, in_a, in_b = _met(a, b)
    at = np.arange(len(a))
    first = np.argmax(same | in_a | in_b, axis=1) == t
    ha, hb = a[at, t, 0], b[at, t, 0]
    both = in_a[at, t] & in_b[at, t]
    place = np.where(same[at, t] | (both & (ha <= hb)) | (~both & in_a[at, t]), ha, hb)
    return first & (place == cell)


def embedding_links(classes: DataFrame, threshold: float, tables: int = TABLES, blocks: int = BLOCKS, cell: float = CELL,
                    probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """Verified links among distinct vectors (cid, label, embedding, copies).

    Returns (cid, links, other): ``links`` sums the copies of linked vectors, each
    pair counted where its members meet first; ``other`` is a linked vector, given
    for as many pairs as connect what a cell connects. Cells over ``BLOCK_ROWS``
    rows are compared block by block in groups of their own.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["embedding"].map(len).to_numpy() if len(pdf) else np.empty(0, int)
            for dim in np.unique(dims):
                part = pdf[dims == dim]
                v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys = cells(unit, tables, blocks, cell, probes, seed)
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "label": part["label"].to_numpy(), "dim": int(dim),
                                    "copies": part["copies"].to_numpy(), "unit": [u.tobytes() for u in unit],
                                    "keys": [k.tobytes() for k in keys], "cells": list(keys.reshape(len(keys), -1))})

    label_type = classes.schema["label"].dataType.simpleString()
    hashed = cut(classes.mapInPandas(assign, f"cid long, label {label_type}, dim int, copies long, unit binary, keys binary, "
                                             "cells array<long>"), "cells")
    rows = hashed.select("cid", "label", "dim", F.posexplode("cells").alias("at", "cell")).select(
        "cid", "label", "dim", F.floor(F.col("at") / (1 + probes)).cast("int").alias("t"),
        (F.col("at") % (1 + probes) == 0).cast("int").alias("home"), "cell")
    where = ["label", "dim", "t", "cell"]
    sizes = (rows.groupBy(*where).agg(F.count("*").alias("n"), F.sum("home").alias("homes"))
             .filter("n > 1 and homes > 0").select(*where, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    met = (rows.join(sizes, where).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("cid", *where, "home", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
           .join(hashed.select("cid", "copies", "unit", "keys"), "cid"))
    group = [*where, "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, ends in whole_runs(batches, group):
            n = len(df)
            dims = df["dim"].to_numpy()
            units = [np.frombuffer(u) for u in df["unit"]]
            width = max(dims)
            unit = np.zeros((n, width))
            for k, u in enumerate(units):
                unit[k, :len(u)] = u
            keys = np.frombuffer(b"".join(df["keys"]), np.int64).reshape(n, tables, 1 + probes)
            cid, copies = df["cid"].to_numpy(), df["copies"].to_numpy()
            t, cell_, home = df["t"].to_numpy(), df["cell"].to_numpy(), df["home"].to_numpy() == 1
            across, mine = (df["i"] != df["j"]).to_numpy(), df["mine"].to_numpy()
            links, forest, edges = np.zeros(n, np.int64), Forest(n), []
            for x, y in pairs_of_runs(ends):
                ok = (home[x] | home[y]) & (~across[x] | (mine[x] != mine[y]))
                x, y = x[ok], y[ok]
                ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[ok], y[ok]
                ok = _first_meeting(keys[x], keys[y], t[x], cell_[x]) if len(x) else np.empty(0, bool)
                x, y = x[ok], y[ok]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                edges += [(p, q) for p, q in zip(x.tolist(), y.tolist()) if forest.join(p, q)]
            e = np.array(edges, np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            yield pd.DataFrame({"cid": np.concatenate((cid[some], cid[e[:, 0]])),
                                "links": np.concatenate((links[some], np.zeros(len(e), np.int64))),
                                "other": pd.array(np.concatenate((np.full(len(some), -1), cid[e[:, 1]])), dtype="Int64")})

    dealt = met.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(compare, "cid long, links long, other long").withColumn(
        "other", F.when(F.col("other") >= 0, F.col("other")))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, **lattice) -> DataFrame:
    """Links and components of vectors (vec_id, embedding, label) by cosine within a label.

    Returns per row vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable, itself included) and kept (vec_id equals it).
    Equal vectors are compared once and counted with their copies. Rows with a
    null label, a null, empty or zero vector, or null or non-finite components
    link with nothing; vectors of different length do not link. Rows with a null
    id count as vectors and take their component's smallest id (null if none).
    """
    rows = with_row_key(vectors.select("vec_id", "embedding", "label"), "row_key").withColumn(
        "ok", _usable(F.col("embedding"), F.col("label")))
    usable = rows.filter("ok")
    classes = cut(usable.groupBy("label", "embedding").agg(F.min("row_key").alias("cid"), F.count("*").alias("copies")), "classes")
    found = cut(embedding_links(classes, threshold, **lattice), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.filter("other is not null"), "cid", "other")
    named = cut(classes.join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "cid").alias("component")), "named")
    linked = usable.join(named, ["label", "embedding"]).select("row_key", "vec_id", "n_links", "component")
    low = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = linked.join(low, "component").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
