import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm.components import connected_components, local_union_find
from marlstone.llm.topn import best_answers, top_n_per_group


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_top_n_over_partitions(spark, partitions):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 40).cast("bigint").alias("g"), (F.col("id") * 7919 % 13).alias("score"), F.col("id").alias("item"), F.lit(1).alias("_group"))
    got = {(r["g"], r["rank_no"]): r["item"] for r in top_n_per_group(df, "g", [-F.col("score"), F.col("item")], "item", 4, partitions).collect()}
    want = {}
    rows = [r for r in df.collect() if r["g"] is not None]
    for g in {r["g"] for r in rows}:
        for i, r in enumerate(sorted((x for x in rows if x["g"] == g), key=lambda r: (-r["score"], r["item"]))[:4]):
            want[g, i + 1] = r["item"]
    assert got == want


def test_best_answers(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [
        (1, 1, None, 12, 0, a, "x"), (10, 2, 1, None, 5, a, None), (11, 2, 1, None, 5, a, None), (12, 2, 1, None, -9, a, None), (13, 2, 1, None, None, a, None), (13, 2, 1, None, 9, b, None),
        (2, 1, None, 10, None, a, None), (20, 2, 2, None, None, a, None), (20, 2, 2, None, None, a, None), (21, 2, 99, None, 1, a, None), (22, 2, 10, None, 1, a, None), (23, 2, None, None, 1, a, None), (3, 1, None, None, 1, a, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, post_type_id tinyint, parent_id bigint, accepted_answer_id bigint, score bigint, ingested_at timestamp, rank_no string")
    got = sorted(tuple(r) for r in best_answers(df).collect())
    assert got == [(1, 10, 3), (1, 12, 1), (1, 13, 2), (2, 20, 1)]
    assert best_answers(df.limit(0)).count() == 0


def test_local_union_find():
    v, r = local_union_find(np.array([1, 2, 9]), np.array([2, 3, 8]))
    rep = dict(zip(v.tolist(), r.tolist(), strict=True))
    assert rep[1] == rep[2] == rep[3] != rep[8] == rep[9]


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {(min(g), x) for g in groups.values() for x in g}


def shapes():
    random.seed(2)
    chain = [(i, i + 1) for i in range(400)]
    star = [(5000, 5001 + i) for i in range(300)]
    ring = [(7000 + i, 7000 + (i + 1) % 60) for i in range(60)]
    noise = [(random.randrange(8000, 9000), random.randrange(8000, 9000)) for _ in range(300)]
    return [*chain, *star, *ring, *noise, (3, 3), (None, 4), (4, None), (1, 0), (0, 1), (-5, 2**62)]


@pytest.mark.parametrize(("cell_edges", "min_blocks"), [(1 << 20, 1), (1 << 20, 4), (40, 4)])
def test_components_equal_union_find(spark, cell_edges, min_blocks):
    df = spark.createDataFrame([(a, b, 1, 2, "x") for a, b in shapes()], "a bigint, b bigint, u int, v int, cell string")
    got = [tuple(r) for r in connected_components(df, "a", "b", cell_edges, min_blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(shapes())


def test_no_components(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")
    out = connected_components(df, "a", "b")
    assert out.columns == ["group_id", "member"] and out.count() == 0
