"""Two-level query cache over a table of entries (tenant, query, embedding, answer, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import cache_key
from marlstone.operators.asof import last_before
from marlstone.operators.retrieval import dense_search

THRESHOLD = 0.95


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Each seq once."""
    fields = [c for c in ("tenant", "query", "embedding", "answer", "inserted_at") if c in entries.columns]
    return entries.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.max(F.struct(*fields)).alias("e")).select("seq", "e.*")


def exact_entries(entries: DataFrame) -> DataFrame:
    """(key, seq, answer): the latest entry of every cache key; entries without tenant or query have none."""
    keyed = entries.filter(F.col("tenant").isNotNull() & F.col("query").isNotNull()).select(cache_key(F.col("tenant"), F.col("query")).alias("key"), "seq", "answer")
    return keyed.groupBy("key").agg(F.max(F.struct("seq", "answer")).alias("e")).select("key", "e.seq", "e.answer")


def exact_lookup(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """lookups (query_id, tenant, query) with hit_seq and answer of the entry of the same key, null without one."""
    found = exact_entries(entries).select("key", F.col("seq").alias("hit_seq"), "answer")
    return lookups.withColumn("key", cache_key(F.col("tenant"), F.col("query"))).join(found, "key", "left").drop("key")


def semantic_lookup(lookups: DataFrame, entries: DataFrame, dim: int, threshold: float = THRESHOLD, as_of: bool = False) -> DataFrame:
    """(query_id, hit_seq, similarity): for lookups (query_id, tenant, vec) the same tenant's most similar entry of at least `threshold`; equals go to the first inserted.

    Ids of lookups and of entries have nothing to do with each other. as_of: lookups have a time (at, as entries have
    inserted_at), and only entries inserted before it count."""
    docs = entries.filter(F.col("tenant").isNotNull()).select(F.col("seq").alias("doc_id"), F.col("embedding").alias("vec"), "tenant", *([F.unix_micros(F.col("inserted_at").cast("timestamp")).alias("at")] if as_of else []))
    asked = lookups.filter(F.col("tenant").isNotNull())
    if as_of:
        asked = asked.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    found = dense_search(asked, docs, 1, dim, ["tenant"], before="at" if as_of else None)
    return found.filter(F.col("score") >= threshold).select("query_id", F.col("doc_id").alias("hit_seq"), F.col("score").alias("similarity"))


def exact_as_of(entries: DataFrame) -> DataFrame:
    """Every entry as a lookup made when it was inserted: (seq, tenant, hit_seq), the latest earlier entry (by inserted_at, then seq) of its key, null for a miss."""
    keyed = entries.filter(F.col("tenant").isNotNull() & F.col("query").isNotNull()).select(cache_key(F.col("tenant"), F.col("query")).alias("key"), "inserted_at", "seq", "tenant")
    found = last_before(keyed, keyed.withColumn("hit_seq", F.col("seq")), "key", ["inserted_at", "seq"], "hit_seq")
    return found.select("seq", "tenant", "hit_seq")


def lookup_outcomes(lookups: DataFrame, entries: DataFrame, dim: int, allowed: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, tenant, outcome, hit_seq, similarity, refused): lookups (query_id, tenant, query, vec, at) against the entries inserted before each.

    exact if an earlier entry has the key (the latest one is the hit); else refused, which is a miss, where `allowed`, a
    condition on the lookup, doesn't hold; else semantic by the most similar earlier entry of the tenant; else miss. A
    refused lookup still gets its exact hit. Lookups without tenant or query are no lookups."""
    asked = lookups.filter(F.col("tenant").isNotNull() & F.col("query").isNotNull()).withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    keyed = asked.select("query_id", cache_key(F.col("tenant"), F.col("query")).alias("key"), "at")
    earlier = entries.filter(F.col("tenant").isNotNull() & F.col("query").isNotNull()).select(cache_key(F.col("tenant"), F.col("query")).alias("key"), F.col("inserted_at").alias("at"), F.col("seq").alias("exact_seq"))
    exact = last_before(keyed, earlier, "key", ["at"], "exact_seq").select("query_id", "exact_seq")
    near = semantic_lookup(asked.filter("_ok").select("query_id", "tenant", "vec", "at"), entries, dim, threshold, as_of=True).withColumnRenamed("hit_seq", "near_seq")
    outcome = F.when(F.col("exact_seq").isNotNull(), "exact").when(~F.col("_ok"), "miss").when(F.col("near_seq").isNotNull(), "semantic").otherwise("miss")
    joined = asked.join(exact, "query_id", "left").join(near, "query_id", "left").withColumn("outcome", outcome)
    semantic = F.col("outcome") == "semantic"
    return joined.select("query_id", "tenant", "outcome", F.when(semantic, F.col("near_seq")).otherwise(F.col("exact_seq")).alias("hit_seq"), F.when(semantic, F.col("similarity")).alias("similarity"), (F.col("exact_seq").isNull() & ~F.col("_ok")).alias("refused"))


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """Lookups (tenant, outcome exact, semantic or miss, refused) as counts and hit rate by tenant; refused ones are misses and counted apart as well."""
    hits = F.count_if(F.col("outcome") != "miss")
    return outcomes.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("outcome") == "exact").alias("exact"), F.count_if(F.col("outcome") == "semantic").alias("semantic"), F.count_if(F.col("outcome") == "miss").alias("misses"),
        F.count_if("refused").alias("refused"), F.round(F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)), 6).alias("hit_rate"),
    )
