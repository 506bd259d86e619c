"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target size
over source size. Documents of a source stand in a fixed order; the expected
copies are prefix-summed along it, one offset per source is added, and a
document is emitted once for each integer boundary its interval crosses. The
order runs by size class, so the copies spread evenly over sizes and the words
taken stay close to the target.

Expected copies are held as integers (units of 2^-24 copies), so sums are exact
and the same in every run. The prefix sum has two levels: sums of chunks of a
source (a few thousand at most, whatever the input), then rows inside a chunk;
a hot source is spread over all its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herbaria.llm.common import WORD_PATTERN, cut

UNIT = 1 << 24
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def word_count(text):
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Target words per source from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share the sum
    of all sizes; a target stops at ``max_copies`` times its source's size and the
    excess is shared again by weight. In order of size over weight the sources
    that stop come first, so running sums give the final share directly. The
    windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(max_copies)))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    w = w.withColumns({
        "left": F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(upto), F.lit(0.0)),
        "weights_left": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    w = w.withColumn("share", F.col("left") / F.col("weights_left"))
    w = w.withColumn("stops", F.col("most") < F.col("share") * F.col("weight"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), F.col("share")))).over(all_)
    return w.select("source", "source_size",
                    F.when(F.col("stops"), F.col("most")).otherwise(final.getField("share") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """Append size, source_size, target and copies to each document (``copies`` may be 0).

    ``keys`` names the columns that order documents, usually the id; rows equal in
    them and in size share the copies of their places in any order. ``docs`` needs
    text and source; null texts have size 0, a null source is a source of its own,
    a source without words has target 0 and gives no copies. Repeated rows count
    each; an empty table stays empty. Existing columns of the new names are replaced.
    """
    new = ["size", "source_size", "target", "copies"]
    kept = [c for c in docs.columns if c not in new]
    spread = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    sized = (docs.withColumn("size", word_count(F.col("text")))
             .withColumns({"_class": F.length(F.bin("size")), "_spread": F.substring(spread, 1, 2), "_order": spread}))
    chunks = cut(sized.groupBy("source", "_class", "_spread").agg(
        F.count("*").alias("_rows"), F.sum("size").alias("_words")), "chunks")
    targets = source_targets(chunks.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_copies)
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 6), 16, 10).cast("long")
    before = Window.partitionBy("source").orderBy("_class", "_spread").rowsBetween(Window.unboundedPreceding, -1)
    plan = (chunks.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_each", expected)
            .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)) * F.col("_each") + offset)
            .select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_spread").alias("_p"),
                    "source_size", "target", "_each", "_start"))
    inside = Window.partitionBy("source", "_class", "_spread").orderBy("size", "_order")
    placed = sized.withColumn("_n", F.row_number().over(inside))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_spread") == F.col("_p")))
    upper = F.col("_start") + F.col("_n") * F.col("_each")
    copies = F.floor(upper / UNIT) - F.floor((upper - F.col("_each")) / UNIT)
    return joined.withColumn("copies", copies.cast("long")).select(*[F.col(f"`{c}`") for c in kept], *new)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: each document as often as it has copies."""
    return (mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col(f"`{c}`") for c in columns]))
