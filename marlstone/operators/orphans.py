"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.bloom import bloom_blocks, bloom_filter, bloom_probe
from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise


def deliveries(posts: DataFrame) -> DataFrame:
    """One row per post id: its references, first and last delivery. Rows without id are left out."""
    return (
        posts.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.min("ingested_at").alias("first_at"),
            F.max("ingested_at").alias("last_at"),
            F.max("parent_id").alias("parent_id"),
            F.max("accepted_answer_id").alias("accepted_answer_id"),
        )
    )


def references(delivered: DataFrame, links: DataFrame) -> DataFrame:
    """Every non-null reference once per referring id: ref_table, ref_field, ref_id, first_at, target."""
    of_posts = delivered.select(
        F.lit("posts").alias("ref_table"),
        F.col("id").alias("ref_id"),
        F.col("first_at").alias("ref_at"),
        F.explode(F.create_map(F.lit("parent_id"), F.col("parent_id"), F.lit("accepted_answer_id"), F.col("accepted_answer_id"))).alias("ref_field", "target"),
    )
    of_links = (
        links.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("ingested_at").alias("ref_at"), F.max("related_post_id").alias("target"))
        .select(F.lit("post_links").alias("ref_table"), F.col("id").alias("ref_id"), "ref_at", F.lit("related_post_id").alias("ref_field"), "target")
    )
    return of_posts.unionByName(of_links).filter(F.col("target").isNotNull())


def orphan_references(posts: DataFrame, links: DataFrame, removed: DataFrame, max_blocks: int = 16384) -> DataFrame:
    """Orphans among the references of posts and links: ref_table, ref_field, ref_id, ref_month, orphan_kind.

    A Bloom filter of all ids that were delivered or removed, bounded by max_blocks bitmaps of 4 KB and broadcast, proves
    references to ids nobody has heard of; these are orphans without any join. The others, false positives included,
    are verified by an exact join that spreads hot targets over many tasks. A saturated filter costs time, never rows.

    Kinds: deleted (removal notice, no delivery after the latest), missing (no row in posts), late (the target's first
    delivery is after the reference's first). Null references and rows without id give nothing; empty tables give an
    empty result; a null ingested_at never makes a reference late, and a month that isn't known is null; repeated rows
    count once; other columns are ignored.
    """
    delivered = materialise(deliveries(posts.select("id", "parent_id", "accepted_answer_id", "ingested_at")))
    notices = removed.filter(F.col("post_id").isNotNull()).groupBy(F.col("post_id").alias("target")).agg(F.max("removed_at").alias("removed_at"))
    known = materialise(
        delivered.select(F.col("id").alias("target"), F.col("first_at").alias("target_first"), F.col("last_at").alias("target_last"), F.lit(True).alias("present")).join(notices, "target", "full")
    )
    blocks = bloom_blocks(known.count(), max_blocks=max_blocks)
    refs = materialise(bloom_probe(references(delivered, links), "target", bloom_filter(known, "target", blocks), blocks, "maybe_known"))

    kind = (
        F.when(F.col("removed_at").isNotNull() & ~F.coalesce(F.col("target_last") > F.col("removed_at"), F.lit(False)), "deleted")
        .when(F.col("present").isNull(), "missing")
        .when(F.col("target_first") > F.col("ref_at"), "late")
    )
    verified = salted_join(refs.filter("maybe_known").drop("maybe_known"), known, "target").withColumn("orphan_kind", kind).filter(F.col("orphan_kind").isNotNull())
    proven = refs.filter(~F.col("maybe_known")).withColumn("orphan_kind", F.lit("missing"))
    columns = ["ref_table", "ref_field", "ref_id", F.date_format("ref_at", "yyyy-MM").alias("ref_month"), "orphan_kind"]
    return proven.select(*columns).unionByName(verified.select(*columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphans per table, field, month and kind."""
    return orphans.groupBy("ref_table", "ref_field", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))
