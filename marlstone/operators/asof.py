"""The last event before each row of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.runtime import materialise


def last_before(asked: DataFrame, events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """asked with `value` of the last of events of the same key that is before it by the columns `order`, null without one.

    Both sides are sorted together, by range of key and order, so that a key with a third of all rows is spread over many
    tasks; within a partition a running window finds the last event, and what a partition ends with is carried to the
    key's next ones: one row a partition and key. Events equal in order to a row aren't before it; of equal events the
    greatest value counts. Null keys find nothing."""
    rest = [c for c in asked.columns if c not in (key, *order)]
    left = asked.select(key, *order, F.lit(0).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast(dict(events.dtypes)[value]).alias("_value"))
    right = events.filter(F.col(key).isNotNull()).select(key, *order, F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    placed = materialise(left.unionByName(right).repartitionByRange(key, *order, "_kind").withColumn("_part", F.spark_partition_id()))
    running = Window.partitionBy("_part", key).orderBy(*order, "_kind", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = placed.withColumn("_last", F.last("_value", ignorenulls=True).over(running)).filter("_kind = 0")
    ends = placed.filter("_kind = 1").groupBy("_part", key).agg(F.max_by("_value", F.struct(*order, "_value")).alias("_end"))
    # parts of a key that hold only rows of asked take what came before as well
    parts = placed.select("_part", key).distinct().join(ends, ["_part", key], "left")
    carried = parts.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    found = here.join(carried.select("_part", key, "_carried"), ["_part", key], "left")
    return found.select(key, *order, "_row.*", F.when(F.col(key).isNotNull(), F.coalesce("_last", "_carried")).alias(value))
