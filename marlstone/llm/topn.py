"""Top N items within every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a partition of the global sort should hold.
ROWS = 1 << 20


def _positions(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, the first n rows of each group with their position, and one row per group with its count.

    Rows after the n-th of a group within one partition can't be among its first n, so only counts leave for them."""
    part = TaskContext.get().partitionId()
    open_group, seen = None, 0

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch["_group"].to_numpy()
        new = np.r_[True, g[1:] != g[:-1]]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(g)])
        goes_on = open_group is not None and g[0] == open_group
        before = np.zeros(len(begin), np.int64)
        if goes_on:
            before[0] = seen
        local = np.arange(len(g)) - np.repeat(begin, size) + 1 + np.repeat(before, size)
        total = size + before
        keep = np.flatnonzero(local <= n)
        rest = batch.drop_columns(["_group"]).take(pa.array(keep))
        out = [pa.array(g[keep]), pa.array(np.full(len(keep), part)), pa.array(local[keep]), pa.array(np.zeros(len(keep), np.int64))]
        yield pa.RecordBatch.from_arrays(out + rest.columns, names=["_group", "_part", "_local", "_rows", *rest.schema.names])
        done = np.arange(len(begin) - 1)
        ended_g, ended_n = g[begin[done]], total[done]
        if open_group is not None and not goes_on:
            ended_g, ended_n = np.r_[open_group, ended_g], np.r_[seen, ended_n]
        yield _counts(ended_g, ended_n, part, rest.schema)
        open_group, seen, schema = g[-1], int(total[-1]), rest.schema
    if open_group is not None:
        yield _counts(np.array([open_group]), np.array([seen]), part, schema)


def _counts(group: np.ndarray, rows: np.ndarray, part: int, schema: pa.Schema) -> pa.RecordBatch:
    k = len(group)
    own = [pa.array(group.astype(np.int64)), pa.array(np.full(k, part)), pa.array(np.zeros(k, np.int64)), pa.array(rows.astype(np.int64))]
    return pa.RecordBatch.from_arrays(own + [pa.nulls(k, f.type) for f in schema], names=["_group", "_part", "_local", "_rows", *schema.names])


def top_n_per_group(df: DataFrame, group: str, order: list[Column], item: str, n: int, partitions: int | None = None) -> DataFrame:
    """(group, item, rank_no) of the first n rows of every group by `order`, which must be total within a group.

    One global range-partitioned sort by group and order spreads even a group of billions over many partitions. Each
    partition numbers its rows per group and passes on the first n of each, with its row count per group; the counts of
    a group's earlier partitions, prefix-summed, turn these numbers into exact positions, and those up to n stay. What
    leaves a partition is at most n + 1 rows per group, so no group ever meets in one task.

    Null groups give no rows. Nulls in the order sort as its columns say (last, for desc_nulls_last). Repeated rows count
    as often as they occur. An empty table gives an empty result.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.filter(F.col(group).isNotNull()).select(F.col(group).cast("bigint").alias("_group"), F.col(item).cast("bigint").alias("_item"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    sort = [F.col("_group").asc(), *[F.col(f"_o{i}").asc() for i in range(len(order))]]
    out = "_group bigint, _part bigint, _local bigint, _rows bigint, _item bigint"
    numbered = keyed.repartitionByRange(partitions, *sort).sortWithinPartitions(*sort).select("_group", "_item").mapInArrow(lambda b: _positions(b, n), out)
    earlier = Window.partitionBy("_group").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    return (
        numbered.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("rank_no", (F.col("_local") + F.col("_before")).cast("int"))
        .filter((F.col("_local") > 0) & (F.col("rank_no") <= n))
        .select(F.col("_group").alias(group), F.col("_item").alias(item), "rank_no")
    )


def best_answers(posts: DataFrame, n: int = 3) -> DataFrame:
    """(parent_id, answer_id, rank_no): the n best current answers of every current question.

    The current delivery of an id is that of the greatest ingested_at (among equals the greatest in the other columns).
    First comes the answer that the question names, then score descending (null as 0), then id. Answers whose parent is
    null, absent or no question give nothing; nor do questions without answers. Whether an answer is the named one is
    found by a join on the answer's id, which is unique; whether the parent is a question is only asked of the ranked
    answers: at most n a parent. So no join meets a hot parent.
    """
    current = (
        posts.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("ingested_at", "post_type_id", "parent_id", "accepted_answer_id", "score")).alias("p"))
        .select("id", "p.post_type_id", "p.parent_id", "p.accepted_answer_id", "p.score")
    )
    questions = current.filter("post_type_id = 1")
    named = questions.filter(F.col("accepted_answer_id").isNotNull()).select(F.col("accepted_answer_id").alias("id"), F.col("id").alias("parent_id"), F.lit(True).alias("named"))
    answers = current.filter("post_type_id = 2 AND parent_id IS NOT NULL").select("id", "parent_id", "score")
    flagged = answers.join(named, ["id", "parent_id"], "left").select("parent_id", F.col("id").alias("answer_id"), F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("score", F.lit(0)).alias("score"))
    order = [F.when(F.col("named"), 0).otherwise(1), -F.col("score").cast("decimal(20,0)"), F.col("answer_id")]
    # as many partitions as keep each to about ROWS; the count comes from the files' footers
    partitions = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posts.count() // ROWS))
    ranked = top_n_per_group(flagged, "parent_id", order, "answer_id", n, partitions)
    return ranked.join(questions.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
