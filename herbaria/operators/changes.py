"""Ordered changes of claims (M4, M7): a change log reduced to one state per claim.

A log row (seq, op, user_id, occurrence_id, action, visible, created_by) is one of

* ``insert``: add the claim unless it exists (duplicates are ignored);
* ``hide``: the claim becomes, or is made, hidden and without action;
* ``update``: an existing claim takes action, visible and created_by;
* ``delete``: the claim is dropped.

The order matters only per claim, so no sort and no list of a claim's changes is
needed. The last ``hide`` or ``delete`` settles everything before it; after it the
first ``insert`` counts if the claim is absent, then the last ``update`` behind
that. Each is an aggregate keyed by the claim, and rows of a claim changed a
million times combine in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.functions import predicates as P
from herbaria.session import checkpoint_dir

KEY = ["user_id", "occurrence_id"]
PAYLOAD = ["action", "visible", "created_by"]
OPS = ["insert", "hide", "update", "delete"]


def _payload() -> Column:
    return F.struct(*PAYLOAD)


def apply_changes(claims: DataFrame, log: DataFrame) -> DataFrame:
    """M7: the claims after all changes of ``log`` in the order of ``seq``.

    ``claims`` and the result hold the key and the payload; ``seq`` is unique per claim.
    """
    claims = claims.select(*KEY, *PAYLOAD)
    settled = (log.filter(F.col("op").isin("hide", "delete")).groupBy(*KEY)
               .agg(F.max("seq").alias("since"), F.max_by("op", "seq").alias("settled_as"), F.max_by("created_by", "seq").alias("hidden_by")))
    later = (log.filter(F.col("op").isin("insert", "update")).join(settled.select(*KEY, "since"), KEY, "left")
             .filter(F.col("since").isNull() | (F.col("seq") > F.col("since"))).drop("since"))
    inserted = later.filter("op = 'insert'").groupBy(*KEY).agg(F.min("seq").alias("born"), F.min_by(_payload(), "seq").alias("inserted"))
    base = claims.select(*KEY, _payload().alias("base"))
    touched = log.select(*KEY).distinct()
    state = (touched.join(base, KEY, "left").join(settled, KEY, "left").join(inserted, KEY, "left")
             .withColumn("present", F.when(F.col("since").isNull(), F.col("base").isNotNull()).otherwise(F.col("settled_as") == "hide"))
             .withColumn("from_seq", F.when(F.col("present"), F.coalesce("since", F.lit(-1).cast("long"))).otherwise(F.col("born"))))
    updates = (later.filter("op = 'update'").join(state.select(*KEY, "from_seq"), KEY).filter(F.col("seq") > F.col("from_seq"))
               .groupBy(*KEY).agg(F.max_by(_payload(), "seq").alias("updated")))
    none = F.lit(None).cast("string").alias("action")
    hidden = F.struct(none, F.lit(False).alias("visible"), F.col("hidden_by").alias("created_by"))
    row = (F.when(F.col("updated").isNotNull(), F.col("updated")).when(~F.col("present"), F.col("inserted"))
           .when(F.col("since").isNotNull(), hidden).otherwise(F.col("base")))
    changed = (state.join(updates, KEY, "left").filter(F.col("present") | F.col("born").isNotNull())
               .select(*KEY, row.alias("r")).select(*KEY, "r.*"))
    return claims.join(touched, KEY, "left_anti").unionByName(changed)


# -- a table of claims on disk ---------------------------------------------------------

def bucket_of(buckets: int) -> Column:
    """Partition of a claim: by person, so that a batch for few people touches few partitions."""
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def write_claims(claims: DataFrame, path: str, buckets: int) -> None:
    """Write a claims table partitioned by bucket."""
    rows = claims.select(*KEY, *PAYLOAD).withColumn("bucket", bucket_of(buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("occurrence_id"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id long, occurrence_id long, action string, visible boolean, created_by long, bucket int").parquet(path)


def apply_to_table(spark: SparkSession, path: str, log: DataFrame, buckets: int) -> list[int]:
    """Apply a log to a written claims table, rewriting only the partitions it touches.

    The changed rows are checkpointed first, then written beside the old partitions
    and put in their place when all are there, so a lost executor costs a task.
    Returns the numbers of the rewritten partitions.
    """
    checkpoint_dir(spark)
    log = log.withColumn("bucket", bucket_of(buckets))
    touched = sorted(r["bucket"] for r in log.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = read_claims(spark, path).filter(F.col("bucket").isin(touched))
    new = apply_changes(old, log.drop("bucket")).withColumn("bucket", bucket_of(buckets)).checkpoint()
    kept = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    (new.repartition("bucket", F.pmod(F.xxhash64("occurrence_id"), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    empty = [b for b in touched if b not in kept]  # an overwrite without rows leaves the old files
    for bucket in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


# -- reload of the source's claims (M4) --------------------------------------------------

def resolve_people(identifiers: DataFrame, users: DataFrame, destroyed: DataFrame) -> DataFrame:
    """(identifier, user_id): the person behind an ORCID or Wikidata id, merges followed.

    A banned identifier and one that leads into a cycle name nobody and are left
    out; a valid identifier of nobody yet has a null user_id: a person to create.
    """
    from herbaria.functions import scalars as S
    from herbaria.operators import mutate as M
    asked = identifiers.select("identifier").distinct().filter(S.is_orcid("identifier") | S.is_wiki_id("identifier"))
    ends = M.resolve_redirects(destroyed)
    j = asked.join(ends, "identifier", "left").filter(~F.coalesce("banned", F.lit(False)) & ~F.coalesce("cycle", F.lit(False)))
    j = j.select("identifier", F.coalesce("resolved", "identifier").alias("final"))
    own = users.select(F.explode(F.array("orcid", "wikidata")).alias("final"), F.col("id").alias("user_id")).filter("final is not null")
    own = own.groupBy("final").agg(F.min("user_id").alias("user_id"))
    return j.join(own, "final", "left").select("identifier", "user_id")


def reload_log(claims: DataFrame, pivot: DataFrame) -> DataFrame:
    """M4: the change log of a reload: all claims of the source agent go, then those of the pivot come.

    ``pivot`` holds user_id, occurrence_id and action. A claim listed under two
    actions takes the first in the order of ``ALL_ACTIONS``, and a claim that a
    person made themselves stays as it is.
    """
    none = F.lit(None)
    gone = claims.filter(F.col("created_by") == P.SOURCE_AGENT_ID).select(
        F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("op"), *KEY, none.cast("string").alias("action"),
        none.cast("boolean").alias("visible"), none.cast("long").alias("created_by"))
    place = F.array_position(F.array(*map(F.lit, P.ALL_ACTIONS)), F.col("action"))
    come = (pivot.filter(~P.is_bot("user_id") & (place > 0)).groupBy(*KEY, "action").agg(F.max(place).alias("seq"))
            .select("seq", F.lit("insert").alias("op"), *KEY, "action", F.lit(True).alias("visible"),
                    F.lit(P.SOURCE_AGENT_ID).cast("long").alias("created_by")))
    return gone.unionByName(come)


def reload_source_claims(claims: DataFrame, pivot: DataFrame, users: DataFrame, destroyed: DataFrame) -> dict[str, DataFrame]:
    """M4: replace the source's claims by a pivot (identifier, action, occurrence_ids).

    Returns the claims, the people to create (identifier; a reload gives them their
    claims once they exist) and the ids of people who become public: private ones
    with a Wikidata id that the pivot names.
    """
    from herbaria.sources.readers import claim_pivot_rows
    people = resolve_people(pivot, users, destroyed)
    known = people.filter("user_id is not null")
    rows = claim_pivot_rows(pivot, known)
    public = (users.filter(F.col("wikidata").isNotNull() & ~F.col("is_public")).select("id")
              .join(known.select(F.col("user_id").alias("id")), "id", "left_semi"))
    return {"claims": apply_changes(claims, reload_log(claims, rows)),
            "new_people": people.filter("user_id is null").select("identifier"), "made_public": public}
