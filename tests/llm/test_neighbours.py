import numpy as np
import pytest

from marlstone.llm.neighbours import codes, learn_rotation, nearest_vectors, neighbour_pairs, probe

SCHEMA = "seq bigint, v array<float>, key string, vec string, rep int"


@pytest.mark.parametrize("radius", [0, 3, 7, 15])
def test_probe_finds_every_code_within_the_radius_once(radius):
    rng = np.random.default_rng(1)
    index = rng.integers(0, 2**64, 300, np.uint64)
    query = index[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) ^ (np.uint64(7) << rng.integers(0, 60, 80).astype(np.uint64))
    found = [x for q, i in probe(index, query, radius, most=50) for x in zip(q.tolist(), i.tolist(), strict=True)]
    d = np.bitwise_count(query[:, None] ^ index[None, :])
    assert len(found) == len(set(found)) and set(found) == set(zip(*map(list, (x.tolist() for x in np.nonzero(d <= radius))), strict=True))


def test_rotation_keeps_similar_vectors_close():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64))
    r = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.allclose(r.T @ r, np.eye(64), atol=1e-8)
    near = x + 0.2 * rng.normal(size=x.shape)
    d = np.bitwise_count(codes(x, r) ^ codes(near, r))
    assert np.median(d) < 8
    assert learn_rotation(x[:, :10]).shape == (10, 64) and learn_rotation(rng.normal(size=(90, 80))).shape == (80, 64)


def data(n=400, dim=64):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(n // 8, dim))
    x = np.repeat(centers, 8, axis=0) + 0.28 * rng.normal(size=(n // 8 * 8, dim))
    x[50:90] = x[50]  # a crowd of equal vectors
    x[100:110] = 3 * x[100]  # the same direction
    return x.astype(np.float32)


def brute(x, k=5, least=0.85):
    x = x.astype(np.float64)
    n = np.sqrt((x**2).sum(axis=1))
    s = np.round(x @ x.T / (n[:, None] * n[None, :]), 6)
    out = {}
    for i in range(len(x)):
        near = sorted((-s[i, j], j) for j in range(len(x)) if j != i and s[i, j] >= least)[:k]
        out[i] = [(j, -c) for c, j in near]
    return out


@pytest.mark.parametrize(("block", "min_blocks"), [(1 << 16, 1), (64, 3)])
def test_recall_against_brute_force(spark, block, min_blocks):
    x = data()
    rows = [(i, v.tolist(), "a", "b", 1) for i, v in enumerate(x)]
    rows += [rows[3], rows[60], (900, None, None, None, None), (901, [], None, None, None), (902, [0.0] * 64, None, None, None), (903, [1.0] * 32, None, None, None), (904, [float("nan")] * 64, None, None, None), (None, [1.0] * 64, None, None, None)]
    got = {}
    for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA), "seq", "v", 64, block=block, min_blocks=min_blocks).orderBy("rank_no").collect():
        got.setdefault(r["seq"], []).append((r["neighbour"], r["cosine"]))
    want = brute(x)
    hits = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in v}) for i, v in want.items())
    total = sum(map(len, want.values()))
    assert hits / total >= 0.99
    assert set(got) <= set(want)
    for i in range(50, 90):  # ties go to the smaller keys
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_pairs_and_nothing(spark):
    none = nearest_vectors(spark.createDataFrame([], SCHEMA), "seq", "v", 64)
    assert none.columns[0] == "seq" and neighbour_pairs(none, "seq").count() == 0
    one = nearest_vectors(spark.createDataFrame([(1, [1.0, 2.0], "", "", 0), (2, [2.0, 4.1], "", "", 0)], SCHEMA), "seq", "v", 2)
    assert [tuple(r) for r in neighbour_pairs(one, "seq").collect()] == [(1, 2)]
