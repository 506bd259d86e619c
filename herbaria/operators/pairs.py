"""Joins whose answer is quadratic in a group, made in blocks.

One key with n rows on both sides gives n * n pairs. A plain join makes them in
the one task that holds the key, and adaptive execution cannot split it, as the
group is small before it is expanded. Here a key with more than ``block`` rows is
cut: its left rows into ceil(n / block) buckets by hash, its right rows likewise,
and every pair of buckets is a join key of its own, so no task makes more than
about block * block pairs of a key at a time. A row of a cut key is copied once
per bucket of the other side, n * n / block rows in all; other keys are joined as
they are. The answer is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may hold on each side.
BLOCK = 2048


def _large(df: DataFrame, key: list[str], block: int, name: str) -> DataFrame:
    """Buckets of the keys with more than ``block`` rows; few, as each has that many rows."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    return counts.select(*key, F.ceil(F.col("n") / block).alias(name))


def _cut(df: DataFrame, key: list[str], own: Column, other: Column, first: bool) -> DataFrame:
    """Give each row its bucket and one copy for every bucket of the other side."""
    spread = F.xxhash64(*[c for c in df.columns if c not in key and not c.startswith("_n_")])
    bucket, copies = F.pmod(spread, own), F.explode(F.sequence(F.lit(0).cast("long"), other - 1))
    placed = (bucket.alias("_l"), copies.alias("_r")) if first else (bucket.alias("_r"), copies.alias("_l"))
    return df.select(*[c for c in df.columns if not c.startswith("_n_")], *placed)


def join_in_blocks(left: DataFrame, right: DataFrame, key: str | list[str], block: int | None = None) -> DataFrame:
    """Inner equi-join of ``left`` and ``right`` on ``key``, large keys in blocks.

    The sides share no other column. Null keys join nothing.
    """
    keys, block = [key] if isinstance(key, str) else list(key), block or BLOCK
    cuts = _large(left, keys, block, "_n_l").join(_large(right, keys, block, "_n_r"), keys, "full_outer")
    n_left, n_right = F.coalesce("_n_l", F.lit(1).cast("long")), F.coalesce("_n_r", F.lit(1).cast("long"))
    a = _cut(left.join(cuts, keys, "left"), keys, n_left, n_right, True)
    b = _cut(right.join(cuts, keys, "left"), keys, n_right, n_left, False)
    # dealt by a stated number: the blocks are small until the join expands them, and would be put together
    parts, on = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_l", "_r"]
    return a.repartition(parts, *on).join(b.repartition(parts, *on), on).drop("_l", "_r")


def pair_members(left: DataFrame, right: DataFrame, key: str | list[str], block: int | None = None) -> DataFrame:
    """``join_in_blocks`` where ``right`` holds the key and one other column.

    The right rows of a block are one list, so a block's pairs are made by unfolding
    a list per left row. Right rows whose other column is null are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    member = next(c for c in right.columns if c not in keys)
    block = block or BLOCK
    cuts = _large(left, keys, block, "_n_l").join(_large(right, keys, block, "_n_r"), keys, "full_outer")
    n_left, n_right = F.coalesce("_n_l", F.lit(1).cast("long")), F.coalesce("_n_r", F.lit(1).cast("long"))
    a = _cut(left.join(cuts, keys, "left"), keys, n_left, n_right, True)
    b = _cut(right.join(cuts, keys, "left"), keys, n_right, n_left, False)
    parts, on = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_l", "_r"]
    lists = b.repartition(parts, *on).groupBy(*on).agg(F.collect_list(member).alias("_list"))
    met = a.repartition(parts, *on).join(lists, on)
    return met.select(*left.columns, F.explode("_list").alias(member))


#: Members of an occurrence that travel in one row.
PACK = 256
#: Occurrences of one key that are gathered in one row.
GATHERED = 4096


def parts_of(df: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a row for each ``_part`` that ``gather`` makes of its key."""
    cut = df.join(_large(scope, keys, GATHERED, "_parts"), keys, "left")
    last = F.coalesce("_parts", F.lit(1).cast("long")) - 1
    return cut.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_parts")


def gather(scope: DataFrame, links: DataFrame) -> DataFrame:
    """(keys, _part, members): the members of each key of ``scope`` over its occurrences, repeats included.

    ``scope`` holds keys and occurrence_id, ``links`` occurrence_id and the member's
    columns. For keys with few occurrences each, as articles: an occurrence's members
    travel to its keys in packs instead of a row per key and member, and meet there
    once. A key with more than ``GATHERED`` occurrences is cut by member into parts,
    so a member of a key stands in one part only.
    """
    keys = [c for c in scope.columns if c != "occurrence_id"]
    names = [c for c in links.columns if c != "occurrence_id"]
    one = "x._m" if len(names) == 1 else "x"  # packed while gathered: a list leaves out missing members
    links = links.withColumnRenamed(names[0], "_m") if len(names) == 1 else links
    names = [c for c in links.columns if c != "occurrence_id"]
    packs = (links.join(_large(links, ["occurrence_id"], PACK, "_n"), "occurrence_id", "left")
             .groupBy("occurrence_id", F.pmod(F.xxhash64(*names), F.coalesce("_n", F.lit(1).cast("long"))).alias("_pack"))
             .agg(F.collect_list(F.struct(*names)).alias("l"))
             .select("occurrence_id", F.expr(f"transform(l, x -> {one})").alias("_members")))
    cut = scope.join(_large(scope, keys, GATHERED, "_parts"), keys, "left")
    met = join_in_blocks(cut.withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long"))), packs, "occurrence_id")
    met = met.select(*keys, "_parts", "_members", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    here = F.filter("_members", lambda x: F.pmod(F.xxhash64(x), F.col("_parts")) == F.col("_part"))
    met = met.select(*keys, "_part", F.when(F.col("_parts") == 1, F.col("_members")).otherwise(here).alias("_members")).filter(F.size("_members") > 0)
    parts = int(scope.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (met.repartition(parts, *keys, "_part").groupBy(*keys, "_part")
            .agg(F.flatten(F.collect_list("_members")).alias("members")))


def distinct_members(gathered: DataFrame, name: str) -> DataFrame:
    """The gathered members as rows, each once per key."""
    return gathered.withColumn(name, F.explode(F.array_distinct("members"))).drop("members", "_part")


def counted_members(gathered: DataFrame, name: str, count: str) -> DataFrame:
    """The gathered members as rows, with their number per key."""
    at = lambda i: F.get("_all", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: (i == 0) | ~at(i).eqNullSafe(at(i - 1)))
    runs = F.transform("_starts", lambda s, i: F.struct(at(s).alias("m"), (F.coalesce(F.get("_starts", i + 1), F.size("_all")) - s).alias("n")))
    rows = (gathered.withColumn("_all", F.sort_array("members")).drop("members", "_part").withColumn("_starts", starts)
            .withColumn("_run", F.explode(runs)).drop("_all", "_starts"))
    return rows.select("*", F.col("_run.m").alias(name), F.col("_run.n").cast("long").alias(count)).drop("_run")
