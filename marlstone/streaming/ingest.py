"""Structured Streaming: idempotent ingest, windowed stage measures, and a stateful exact cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions.text import cache_key, html_to_text, parse_tags
from marlstone.operators.caching import distinct_entries, lookup_outcomes
from marlstone.operators.chunking import chunk_documents
from marlstone.runtime import materialise
from marlstone.sources.tables import upsert_index


def question_documents(posts: DataFrame) -> DataFrame:
    """Questions of a stream or batch of posts as documents without answers."""
    return posts.filter("post_type_id = 1").select(
        F.col("id").alias("doc_id"), "title", parse_tags(F.col("tags")).alias("tags"), html_to_text(F.col("body")).alias("body"), F.array().cast("array<string>").alias("answers"),
        F.substring("creation_date", 1, 10).alias("effective_date"), F.concat(F.lit("qa://posts/q/"), F.col("id").cast("string")).alias("source_uri"),
    )


def ingest_stream(posts: DataFrame, index: str, checkpoint: str, tenant: str = "public", **trigger) -> StreamingQuery:
    """Streams posts into the chunk index at `index`. A batch that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_index(batch.withColumn("tenant_id", F.lit(tenant)), index)

    chunks = chunk_documents(question_documents(posts)).drop("tags")
    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stage_windows(events: DataFrame, time: str, stage: str, value: str, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, stage, n, p50, p95, most): windows of a stream, closed once the watermark has passed them. Works on batches as well."""
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(w.alias("w"), stage).agg(F.count(value).alias("n"), F.percentile_approx(value, 0.5, 10000).alias("p50"), F.percentile_approx(value, 0.95, 10000).alias("p95"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), stage, "n", "p50", "p95", "most")


def cache_stream(requests: DataFrame) -> DataFrame:
    """(seq, outcome, hit_seq) of a stream of requests (seq, tenant, query): exact if the key was seen before, else miss.

    State is one number per cache key, so no tenant gathers in one place."""
    keyed = requests.filter(F.col("tenant").isNotNull() & F.col("query").isNotNull()).select(cache_key(F.col("tenant"), F.col("query")).alias("key"), "seq")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for seq in sorted(x for f in frames for x in f["seq"]):
            out.append((seq, "miss" if last is None else "exact", last))
            last = seq
        state.update((int(last),))
        yield pd.DataFrame(out, columns=["seq", "outcome", "hit_seq"]).astype({"hit_seq": "Int64"})

    return keyed.groupBy("key").applyInPandasWithState(step, "seq bigint, outcome string, hit_seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def cached_answers(requests: DataFrame, store: str, outcomes: str, checkpoint: str, dim: int, allowed: Column, **trigger) -> StreamingQuery:
    """Both levels of the cache over a stream of requests (seq, tenant, query, embedding, answer, inserted_at).

    Each batch is looked up in what earlier batches left in `store` and in its own earlier requests, and then stored. Both
    tables have a folder a batch, written anew if the batch is run again, so a failure repeats nothing. `allowed`: see
    lookup_outcomes, whose rows `outcomes` has."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = materialise(distinct_entries(batch))
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        entries = spark.read.parquet(store).filter(F.col("batch") <= number).drop("batch")
        lookups = new.select(F.col("seq").alias("query_id"), "tenant", "query", F.col("embedding").alias("vec"), F.col("inserted_at").alias("at"))
        lookup_outcomes(lookups, entries, dim, allowed).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
