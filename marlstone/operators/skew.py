"""Joins whose large side has hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", max_hot: int = 1000) -> DataFrame:
    """big joined with small on key, hot keys spread over many tasks.

    A key is hot if it holds more than one part in max_hot of big's rows, so there are fewer than max_hot of them:
    their list is bounded whatever the size of the data, and is broadcast. A hot key has as many salts as it has such
    parts, so that none of its tasks gets more than about one; small's rows of it are repeated once per salt. Other keys
    join as usual. Equal rows are spread as well. small should have few rows per key. Null keys match nothing and are
    kept by a left join. big must be materialised: it is read twice, and salts follow a row's place in it, which a lost
    executor mustn't change.
    """
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") * max_hot / counts.agg(F.sum("_n")).scalar()).cast("int")
    hot = counts.select(key, parts.alias("_parts")).filter("_parts > 1")
    left = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
