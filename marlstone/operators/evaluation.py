"""Labelled pairs and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL_AT = (1, 5, 10, 50, 100)


def current_posts(posts: DataFrame, *columns: str) -> DataFrame:
    """The latest delivery of every post id, with the columns named (all without names): only these are shuffled."""
    fields = list(columns) or [c for c in posts.columns if c not in ("id", "ingested_at")]
    latest = F.max_by(F.struct(*fields), F.struct("ingested_at", F.coalesce("score", F.lit(-(1 << 62)))))
    return posts.filter(F.col("id").isNotNull()).groupBy("id").agg(latest.alias("p")).select("id", "p.*")


def duplicate_links(links: DataFrame) -> DataFrame:
    """(link_id, post_id, related_post_id) of type 3 with two different ends, each id once."""
    kept = links.filter("link_type_id = 3 AND post_id <> related_post_id AND id IS NOT NULL")
    return kept.groupBy(F.col("id").alias("link_id")).agg(F.min("post_id").alias("post_id"), F.min("related_post_id").alias("related_post_id"))


def label_pairs(posts: DataFrame, links: DataFrame, min_score: int = 1, min_title_bytes: int = 20) -> DataFrame:
    """Every duplicate link as a candidate pair (query, gold) with the reason that drops it, null if kept.

    In this order: missing_post, chained (the gold post is itself a duplicate of another), no_title, low_score,
    short_title, repeated_query (not the query's first link)."""
    p = current_posts(posts, "title", "score", "body")
    pairs = duplicate_links(links)
    query = p.select(F.col("id").alias("post_id"), F.lit(True).alias("q_there"), F.col("title").alias("query_title"), F.col("body").alias("query_body"))
    gold = p.select(F.col("id").alias("related_post_id"), F.lit(True).alias("g_there"), F.col("title").alias("gold_title"), F.col("score").alias("gold_score"))
    chained = pairs.select(F.col("post_id").alias("related_post_id"), F.lit(True).alias("chained")).distinct()
    joined = pairs.join(query, "post_id", "left").join(gold, "related_post_id", "left").join(chained, "related_post_id", "left")
    reason = (
        F.when(F.col("q_there").isNull() | F.col("g_there").isNull(), "missing_post")
        .when(F.col("chained"), "chained")
        .when(F.col("query_title").isNull() | F.col("gold_title").isNull(), "no_title")
        .when(F.coalesce("gold_score", F.lit(0)) < min_score, "low_score")
        .when(F.octet_length("query_title") < min_title_bytes, "short_title")
    )
    first = Window.partitionBy("post_id", F.col("reason").isNull()).orderBy("link_id")
    numbered = joined.withColumn("reason", reason).withColumn("_i", F.row_number().over(first))
    final = F.when(F.col("reason").isNull() & (F.col("_i") > 1), "repeated_query").otherwise(F.col("reason"))
    return numbered.select("link_id", F.col("post_id").alias("query_id"), F.col("related_post_id").alias("gold_doc_id"), "query_title", "query_body", "gold_title", "gold_score", final.alias("reason"))


def build_stats(labelled: DataFrame) -> DataFrame:
    """(outcome, n): how many links were kept, and dropped for which reason."""
    return labelled.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def query_metrics(outcomes: DataFrame, relevant: DataFrame, recall_at: tuple[int, ...] = RECALL_AT, ndcg_at: int = 10) -> DataFrame:
    """Per query of `relevant` (query_id, doc_id, gain): recall@k, reciprocal rank and nDCG of the ranked outcomes (query_id, doc_id, rank).

    A relevant document that wasn't retrieved counts against recall and for the ideal ranking; a query without
    retrieved documents has zeros. Outcomes of other queries don't count."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    rel = relevant.withColumn("ideal_rank", F.row_number().over(ideal))
    hits = rel.join(outcomes.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")

    def discounted(rank: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(rank) <= ndcg_at, F.col("gain") / F.log2(F.col(rank) + 1.0))), F.lit(0.0))

    recalls = [(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in recall_at]
    ndcg = F.coalesce(F.try_divide(discounted("rank"), F.nullif(discounted("ideal_rank"), F.lit(0.0))), F.lit(0.0))
    return hits.groupBy("query_id").agg(*recalls, F.coalesce(F.try_divide(F.lit(1.0), F.min("rank")), F.lit(0.0)).alias("rr"), F.least(ndcg, F.lit(1.0)).alias("ndcg"))


def retrieval_report(metrics: DataFrame) -> DataFrame:
    """One row: means over queries and the number of queries that found nothing relevant; zeros without queries."""
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mrr" if c == "rr" else c) for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *means, F.count_if(F.col("rr") == 0).alias("misses"))
