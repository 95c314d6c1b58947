import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.bkforest import BKForest, hamming
from marlstone.llm.near_duplicates import _rest_codes, all_pairs, near_duplicate_groups, near_duplicate_pairs, plain, search_shards
from marlstone.llm.textvec import WHITE_SPACE, class_table, code_points, words

SCHEMA = "id bigint, title string, body string, code_a string, shard string, rep string, _id string"


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 200), st.integers(0, 20), st.integers(1, 2), st.integers(0, 1000))
def test_forest_finds_all_within_the_radius(n, radius, width, seed):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 2**64, (n, width), np.uint64) & rng.integers(0, 2**64, (n, width), np.uint64) & np.uint64(0xFFFFF)
    if n:
        code[n // 2 :: 3] = code[0]  # many equal codes
    shard = np.sort(rng.integers(0, 5, n))
    found = [x for q, i in BKForest(shard, code).search(shard, code, radius, most=64) for x in zip(q.tolist(), i.tolist(), strict=True)]
    want = {(a, b) for a in range(n) for b in range(n) if shard[a] == shard[b] and hamming(code[a : a + 1], code[b : b + 1])[0] <= radius}
    assert len(found) == len(set(found)) and set(found) == want


def test_children_hang_on_their_distance():
    code = np.array([[0], [1], [3], [2], [1]], np.uint64)
    f = BKForest(np.zeros(5, int), code)
    assert f.parent.tolist() == [-1, 0, 0, 1, 1] and f.edge.tolist() == [-1, 1, 2, 2, 0]


def test_words_are_runs_of_letters_and_digits():
    import re

    texts = ["", "A b2_c", "é x", "ab", "cd", "日本-語", "½²٣", "áb", "x" * 50]
    cps, starts = code_points([t.lower() for t in texts])
    at, end, doc = words(cps, starts)
    got = [(int(d), "".join(map(chr, cps[a:b]))) for a, b, d in zip(at, end, doc, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W_]+", t.lower())]
    assert class_table()[WHITE_SPACE].tolist() == [3] * len(WHITE_SPACE)


def test_plain():
    assert plain(None, "<p>a &lt;b&gt; &amp;amp; c</p>") == "  a <b> &amp; c "
    assert plain("t", None) == "t "
    assert plain("t", "x < y") == "t x < y"


def brute(rows, k, threshold):
    import re

    sets = {}
    for i, t, b in rows:
        w = re.findall(r"[^\W_]+", plain(t, b).lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    ids = sorted(i for i, s in sets.items() if s and i is not None)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [random.choice(vocabulary) for _ in range(random.randint(30, 90))]
        rows.append((len(rows), "T" if i % 3 else None, " ".join(base)))
        for _ in range(i % 5):
            edited = list(base)
            for _ in range(random.randint(0, 5)):
                edited[random.randrange(len(edited))] = random.choice(vocabulary)
            rows.append((len(rows), "T" if i % 3 else None, "<p>" + " ".join(edited) + "</p>"))
    rows += [(1000 + i, None, "the same copy of a text that is here a hundred times over") for i in range(30)]
    return rows + [(2000, None, None), (2001, "", ""), (2002, "one", "two"), (None, "x", "y z a b c d e f"), (0, None, rows[0][2])]


@pytest.mark.parametrize(("k", "threshold", "block"), [(3, 0.6, 1 << 14), (3, 0.6, 3), (5, 0.8, 1 << 14), (3, 0.3, 1 << 14), (2, 0.4, 5), (3, 0.5, 1 << 14)])
def test_pairs_equal_brute_force(spark, k, threshold, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", "s", "r", "i") for r in rows], SCHEMA)
    got = {tuple(r) for r in all_pairs(*near_duplicate_pairs(df, "id", "title", "body", k, threshold, block)).collect()}
    assert got == brute(rows, k, threshold)


def test_groups_and_empty(spark):
    df = spark.createDataFrame([(*r, "c", "s", "r", "i") for r in corpus()], SCHEMA)
    got = {r["id"]: r for r in near_duplicate_groups(df, "id", "title", "body", 3, 0.6).collect()}
    assert len({got[1000 + i]["group_id"] for i in range(30)}) == 1 and got[1005]["rep"] == 1000
    assert 2000 not in got and 2002 not in got
    for a, b in brute(corpus(), 3, 0.6):
        assert got[a]["group_id"] == got[b]["group_id"]
    empty = near_duplicate_groups(spark.createDataFrame([], SCHEMA), "id", "title", "body")
    assert empty.count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, None, long), (2, "t", long + " x"), (3, None, "short text of a few words")], "id bigint, title string, body string")
    assert [tuple(r) for r in all_pairs(*near_duplicate_pairs(df, "id", "title", "body")).collect()] == [(1, 2)]


def test_no_pair_is_lost_at_the_threshold(spark):
    """1,500 pairs of exactly 0.6, of 27 shingles in common out of 45; the chance that bands of min-hashes keep all is under one in 10,000."""
    rows = []
    for i in range(1500):
        base = [f"w{i}x{j}" for j in range(38)]  # 36 shingles; the other text has another end, from the 30th word on
        rows += [(2 * i, None, " ".join(base)), (2 * i + 1, None, " ".join(base[:29] + [f"v{i}x{j}" for j in range(9)]))]
    df = spark.createDataFrame(rows, "id bigint, title string, body string")
    pairs, _ = near_duplicate_pairs(df, "id", "title", "body", 3, 0.6)
    assert {tuple(r) for r in pairs.collect()} == {(2 * i, 2 * i + 1, 0.6) for i in range(1500)}


def test_trees_prune_groups_of_similar_texts():
    """A shard of 40 groups of 50 texts of 100 shingles that differ in 4: a probe passes by over a third of the nodes."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 48, 100, np.uint64)
        for _ in range(50):
            edited = base.copy()
            edited[rng.choice(100, 4, replace=False)] = rng.integers(0, 1 << 48, 4, np.uint64)
            sets.append(edited)
    values, at = np.concatenate(sets), np.arange(0, 200_000, 100)
    n = len(sets)
    facts = np.full(n, 100 << 32, np.int64)
    t = pa.table({"shard": np.zeros(n, np.int64), "facts": facts, "set_a": np.arange(n), "code": pa.array(_rest_codes(values, at + 99, at, np.full(n, 100)), pa.binary())})
    a, b, visited, nodes = search_shards(t, 0.8)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(n) for j in range(i + 1, n) if i // 50 == j // 50}
    assert nodes == n * n and visited < 0.7 * nodes
