"""Consolidating pairwise matches into groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textvec import mix
from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise

#: Edges that one task may hold in memory (16 bytes each, a few times over).
CELL_EDGES = 1 << 20


def local_union_find(u: np.ndarray, v: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and, for each, the vertex of the least rank in its component. Ranks are seeded hashes of vertices."""
    ends, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    by_rank = np.argsort(_rank(ends, seed), kind="stable")
    rank = np.empty(len(ends), np.int64)
    rank[by_rank] = np.arange(len(ends))
    a, b = rank[index[: len(u)]], rank[index[len(u) :]]
    parent = np.arange(len(ends))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)  # hook
        while True:  # compress
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return ends, ends[by_rank[parent[rank]]]


def _rank(v: np.ndarray, seed: int) -> np.ndarray:
    return mix(v.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def _cells(batches: Iterator[pa.RecordBatch], seed: int, most: int) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of each grid cell; rows come cell by cell. No more than `most` edges are held: what a cell has beyond counts as another cell."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            t = pa.Table.from_batches(parts)
            v, r = local_union_find(t["u"].to_numpy(), t["v"].to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r), pa.array(_rank(r, seed))], names=["vertex", "rep", "rank"])

    held: list[pa.RecordBatch] = []
    cell, rows = None, 0
    for batch in batches:
        c = batch["cell"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1, len(c)] if len(c) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for low in range(a, b, most):
                n = min(most, b - low)
                if c[a] != cell or rows + n > most:
                    yield from solve(held)
                    held, cell, rows = [], c[a], 0
                held.append(batch.slice(low, n))
                rows += n
    yield from solve(held)


def _block(vertex: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(blocks)).cast("int")


def connected_components(pairs: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES, min_blocks: int = 4, max_rounds: int = 100) -> DataFrame:
    """(group_id, member): every vertex of `pairs` with the smallest vertex of its component.

    Two-dimensional grid: vertices are hashed into blocks and edge (u, v) goes to cell (block of u, block of v), so the
    edges of a hub are spread over a whole row of cells; cells that still have more than cell_edges are split by edge, into
    tasks of about that many. Each cell runs a union-find of its own; a vertex then takes the
    best of the representatives that its row and column of cells found for it, and the representatives' remaining
    differences are the edges of the next round, until none is left. Ranks are hashes of vertices with another seed each
    round, so any chain, sorted or not, is expected to shrink by a constant share a round. Parents of all rounds are then resolved backwards.

    Repeated and reversed pairs count once; self-pairs and pairs with a null end link nothing and give no vertex; no
    pairs give an empty result; other columns are ignored.
    """
    spark = pairs.sparkSession
    u, v = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = materialise(pairs.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    levels: list[DataFrame] = []
    count = edges.count()
    for turn in range(max_rounds):
        if not count:
            break
        # a cell holds about 2 * count / blocks**2 edges
        blocks = max(min_blocks if turn == 0 else 1, math.ceil(math.sqrt(2 * count / cell_edges)))
        i, j = _block(F.col("u"), blocks, turn), _block(F.col("v"), blocks, turn)
        cells = edges.withColumn("cell", (F.least(i, j) * blocks + F.greatest(i, j)).cast("bigint"))
        if count > cell_edges:  # the crowded cells are at most one in cell_edges edges, so their list is short
            crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_edges)
            part = F.pmod(F.xxhash64("u", "v"), F.ceil(F.coalesce("n", F.lit(1)) / cell_edges))
            cells = cells.join(F.broadcast(crowded), "cell", "left").withColumn("cell", F.col("cell") * (1 << 32) + part).drop("n")
        tasks = max(1, math.ceil(count / (cell_edges / 8)), min(blocks, blocks * (blocks + 1) // 2))
        solve = partial(_cells, seed=turn, most=cell_edges)
        found = materialise(cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(solve, "vertex bigint, rep bigint, rank bigint"))
        # exchange: the representative of least rank wins, as in the cells
        parents = materialise(found.groupBy("vertex").agg(F.min(F.struct("rank", "rep"))["rep"].alias("parent")))
        levels.append(parents)
        edges = materialise(found.join(parents, "vertex").filter(F.col("rep") != F.col("parent")).select(F.least("rep", "parent").alias("u"), F.greatest("rep", "parent").alias("v")).distinct())
        count = edges.count()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not levels:
        return spark.createDataFrame([], "group_id bigint, member bigint")
    # root of every vertex: a parent of one round is a vertex of the next, or a root
    roots = levels[-1].withColumnRenamed("parent", "root")
    for parents in reversed(levels[:-1]):
        up = roots.select(F.col("vertex").alias("parent"), "root")
        roots = materialise(salted_join(parents, up, "parent").select("vertex", F.coalesce("root", "parent").alias("root")))
    least = roots.groupBy("root").agg(F.min("vertex").alias("group_id"))
    return salted_join(roots, least, "root").select("group_id", F.col("vertex").alias("member"))

