"""A Bloom filter of bounded size made, merged and probed by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of bitmap_construct_agg; a key's bits all lie in one bitmap ("blocked" filter), so a probe reads one row.
BLOCK_BITS = 32768
HASHES = 6


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(BLOCK_BITS)).cast("bigint") for i in range(HASHES)]


def bloom_blocks(n_keys: int, bits_per_key: int = 16, max_blocks: int = 16384) -> int:
    """Number of 4 KB bitmaps for n_keys; never above max_blocks (64 MB by default, 16 bits for each of 33 million keys), so the broadcast is bounded at any size."""
    return max(1, min(max_blocks, -(-n_keys * bits_per_key // BLOCK_BITS)))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row (_block, _bitmap) per non-empty bitmap, at most `blocks` rows of 4 KB. Null keys are left out."""
    k = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    return (
        k.select(_block(F.col("_k"), blocks).alias("_block"), F.explode(F.array(*_bits(F.col("_k")))).alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def bloom_probe(df: DataFrame, key: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """df with the boolean `flag`: false proves that key isn't among the filter's keys; null keys give false."""
    marked = df.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "_block", "left")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1

    found = F.col("_bitmap").isNotNull() & F.col(key).isNotNull()
    for bit in _bits(F.col(key)):
        found = found & is_set(bit)
    return marked.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_block", "_bitmap")
