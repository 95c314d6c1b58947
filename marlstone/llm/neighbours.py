"""Most similar vectors for every vector, by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise

BITS, TABLES = 64, 4
PART = BITS // TABLES
#: Vectors that the rotation is learned from, chosen by a hash of their key.
SAMPLE = 4096
#: Vectors of one block; two blocks, at most, meet in a task, in single precision.
BLOCK = 1 << 17
#: Standard deviations of the Hamming distance of random codes that the radius allows beyond its mean.
DEVIATIONS = 2.2
MIN_BLOCKS = 4
_BOTH = 2


def learn_rotation(sample: np.ndarray, turns: int = 50) -> np.ndarray:
    """dim x 64 matrix whose signs are the code: principal directions, rotated so that the signs lose least (ITQ).

    Fewer than 64 dimensions are repeated in other rotations."""
    rng = np.random.default_rng(7)
    dim = sample.shape[1]
    columns = []
    for begin in range(0, BITS, dim):
        width = min(dim, BITS - begin)
        base = np.linalg.svd(sample, full_matrices=True)[2][:width].T if dim > BITS else np.eye(dim)[:, :width]
        v = sample @ base
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(turns):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        columns.append(base @ r)
    return np.hstack(columns)


def codes(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(unit @ rotation > 0, axis=1).view(np.uint64).ravel()


def radius_of(similarity: float) -> int:
    """Bits that differ between the codes of two vectors of this cosine: angle / pi of each, plus DEVIATIONS standard deviations.

    Random rotations put 1.4% of the pairs of exactly this cosine further apart, and next to none of those above; learned
    ones fewer."""
    p = math.acos(similarity) / math.pi
    return math.ceil(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def _masks(reach: int) -> np.ndarray:
    """All patterns of at most `reach` of a substring's bits."""
    return np.array([sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(PART), k)], np.uint16)


def _parts(code: np.ndarray) -> list[np.ndarray]:
    return [((code >> np.uint64(PART * j)) & np.uint64((1 << PART) - 1)).astype(np.uint16) for j in range(TABLES)]


def probe(index: np.ndarray, query: np.ndarray, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, index) places of all codes within the Hamming radius, each pair once.

    Pigeonhole: codes that differ in at most radius bits have a substring that differs in at most radius // TABLES; the
    first radius % TABLES + 1 substrings alone may need as much, of the others one bit less is enough."""
    own, other = _parts(index), _parts(query)
    reach = [radius // TABLES - (j > radius % TABLES) for j in range(TABLES)]
    for j in range(TABLES):
        if reach[j] < 0:
            continue
        order = np.argsort(own[j], kind="stable")
        begin = np.searchsorted(own[j][order], np.arange((1 << PART) + 1))
        count = np.diff(begin).astype(np.int32)
        masks = _masks(reach[j])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def near(parts: list, j: int = j) -> tuple[np.ndarray, np.ndarray]:
            q, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            x = query[q] ^ index[i]
            ok = np.bitwise_count(x) <= radius
            q, i, x = q[ok], i[ok], x[ok]
            fresh = np.ones(len(q), bool)  # an earlier table gave the pair if its substring is within reach
            for t in range(j):
                fresh &= np.bitwise_count((x >> np.uint64(PART * t)) & np.uint64((1 << PART) - 1)) > max(reach[t], -1)
            return q[fresh], i[fresh]

        for mask in masks:
            value = other[j] ^ mask
            n = count[value]
            q = np.flatnonzero(n)
            step = max(1, most // max(1, int(n.max(initial=0))))
            for a in range(0, len(q), step):  # a crowded bucket is taken in slices
                part = q[a : a + step]
                k = n[part]
                total = np.cumsum(k)
                i = order[np.repeat(begin[value[part]] - (total - k), k) + np.arange(int(total[-1]))]
                held.append((np.repeat(part, k), i))
                size += len(i)
                if size >= most:
                    yield near(held)
                    held, size = [], 0
        if held:
            yield near(held)


def _best(q: np.ndarray, n: np.ndarray, cos: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k best: cosine descending, then the neighbour's key."""
    order = np.lexsort((key[n], -cos, q))
    first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _cell(key: np.ndarray, vec: np.ndarray, side: np.ndarray, rotation: np.ndarray, radius: int, similarity: float, k: int) -> tuple[np.ndarray, ...]:
    """Best neighbours, in both directions, between the rows of side 0 and of side 1, or among those of side _BOTH."""
    norm, code = np.empty(len(vec)), np.empty(len(vec), np.uint64)
    for s in range(0, len(vec), 1 << 14):  # double precision for a slice at a time
        e = slice(s, s + (1 << 14))
        x = vec[e].astype(np.float64)
        norm[e] = np.sqrt((x**2).sum(axis=1))
        code[e] = codes(x / norm[e, None], rotation)
    itself = side[0] == _BOTH
    left, right = (np.arange(len(key)),) * 2 if itself else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    q, n, c = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for a, b in probe(code[left], code[right], radius):
        x, y = right[a], left[b]
        if itself:
            x, y = x[x < y], y[x < y]
        cos = np.empty(len(x))
        for s in range(0, len(x), 1 << 16):
            e = slice(s, s + (1 << 16))
            cos[e] = np.einsum("ij,ij->i", vec[x[e]].astype(np.float64), vec[y[e]].astype(np.float64)) / (norm[x[e]] * norm[y[e]])
        cos = np.round(cos, 6)
        ok = cos >= similarity
        q, n, c = np.concatenate([q, x[ok], y[ok]]), np.concatenate([n, y[ok], x[ok]]), np.concatenate([c, cos[ok], cos[ok]])
        if len(q) > 1 << 21:
            keep = _best(q, n, c, key, k)
            q, n, c = q[keep], n[keep], c[keep]
    keep = _best(q, n, c, key, k)
    return key[q[keep]], key[n[keep]], c[keep]


def _cells(batches: Iterator[pa.RecordBatch], rotation: Broadcast, radius: int, similarity: float, k: int) -> Iterator[pa.RecordBatch]:
    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            q, n, c = _cell(t["rep"].to_numpy(), flat.reshape(t.num_rows, -1), t["side"].to_numpy(), rotation.value, radius, similarity, k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(c)], names=["q", "n", "cos"])

    held: list[pa.RecordBatch] = []
    cell = None
    for batch in batches:
        c = batch["cell"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1, len(c)] if len(c) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if c[a] != cell:
                yield from solve(held)
                held, cell = [], c[a]
            held.append(batch.slice(a, b - a))
    yield from solve(held)


def nearest_vectors(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, similarity: float = 0.85, radius: int | None = None, block: int = BLOCK, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """(key, neighbour, cosine, rank_no): up to k other keys of greatest cosine (double, 6 decimals) of at least `similarity`.

    Ties go to the smaller key. Codes are the signs of the vectors under a rotation learned from at most SAMPLE vectors;
    all vectors are indexed. Codes are cut into substrings of 16 bits, each an index of its own; by the pigeonhole
    principle probing every substring within its share of the radius finds every code within the radius; these are
    ranked by the float vectors. Blocks of rows meet pairwise: a task has one pair of blocks, the index of one and the
    probes of the other, and the best k + 1 a row leave it, so no crowd of similar vectors is ever collected.

    Equal vectors are one class: it is searched once, and since ties go to small keys, its k + 1 smallest keys are all
    that any list can name. Vectors that are null, of another length, or all zero don't count and get no row; nor do
    rows without key. Repeated rows of a key count once (of several vectors of one key the greatest is taken). NaN is
    similar to nothing. Other columns are ignored; no vectors give an empty result.
    """
    spark = df.sparkSession
    v = F.col("vec")
    valid = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("vec"))
    valid = valid.filter(F.col("key").isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    valid = materialise(valid.groupBy("key").agg(F.max("vec").alias("vec")))
    few = Window.partitionBy("vec").orderBy("key")
    small = valid.withColumn("i", F.row_number().over(few)).filter(F.col("i") <= k + 1)
    classes = materialise(small.groupBy("vec").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(F.col("keys")[0].alias("rep"), "keys", "vec"))
    n = classes.count()
    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()["vec"]
    if not n:
        return spark.createDataFrame([], "key bigint, neighbour bigint, cosine double, rank_no int").withColumnRenamed("key", key)
    x = sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), dim)
    rotation = spark.sparkContext.broadcast(learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True)))
    reach = radius_of(similarity) if radius is None else radius

    blocks = max(min_blocks, math.ceil(n / block))
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = classes.select("rep", "vec", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = met.select((low * blocks + high).alias("cell"), F.when(F.col("own") == F.col("other"), _BOTH).when(F.col("own") == low, 0).otherwise(1).alias("side"), "rep", "vec")
    tasks = blocks * (blocks + 1) // 2
    found = rows.repartition(2 * tasks, "cell").sortWithinPartitions("cell").mapInArrow(lambda b: _cells(b, rotation, reach, similarity, k + 1), "q bigint, n bigint, cos double")

    best = Window.partitionBy("q").orderBy(F.desc("cos"), "n")
    near = found.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k + 1).drop("i")
    entries = near.join(classes.select(F.col("rep").alias("n"), "keys"), "n").select("q", "cos", "keys").union(classes.select("rep", F.lit(1.0), "keys"))
    listed = entries.groupBy("q").agg(F.flatten(F.collect_list(F.transform("keys", lambda x: F.struct((-F.col("cos")).alias("c"), x.alias("key"))))).alias("l"))
    top = listed.select(F.col("q").alias("rep"), F.slice(F.array_sort("l"), 1, k + 1).alias("l"))
    of_class = classes.join(top, "rep").select("vec", "l")
    mine = salted_join(valid, of_class, "vec", "inner")
    others = F.slice(F.filter("l", lambda x: x["key"] != F.col("key")), 1, k)
    out = mine.select("key", F.posexplode(others).alias("i", "x"))
    return out.select(F.col("key").alias(key), F.col("x.key").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("i") + 1).alias("rank_no"))


def neighbour_pairs(neighbours: DataFrame, key: str) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: pairs of which at least one is among the other's nearest."""
    return neighbours.select(F.least(key, "neighbour").alias("seq_a"), F.greatest(key, "neighbour").alias("seq_b")).distinct()
