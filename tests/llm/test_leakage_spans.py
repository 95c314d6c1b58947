import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import leakage
from marlstone.llm.leakage import _sliding_min, leaked_items
from marlstone.llm.spans import shared_share, shared_spans


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 12))
def test_sliding_min(values, width):
    x = np.array(values, np.uint64)
    assert _sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def word_list(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def leaks(docs, items, n=13):
    grams = {}
    for q, t in items:
        w = word_list(t)
        if q is not None and w:
            k = min(n, len(w))
            grams[q] = (k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    out = set()
    for d, t in docs:
        w = word_list(t)
        for q, (k, g) in grams.items():
            if d is not None and any(tuple(w[i : i + k]) in g for i in range(len(w) - k + 1)):
                out.add((d, q))
    return out


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_leaks_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MAX_FILTER_BITS", bits)
    random.seed(4)
    v = [f"w{i}" for i in range(60)] + ["Über", "日本"]
    items = [(i, " ".join(random.choice(v) for _ in range(random.choice([1, 2, 4, 7, 12, 13, 14, 30])))) for i in range(40)] + [(100, None), (101, ""), (102, " -- "), (None, "w1"), (3, "w1 w2 w3")]
    docs = []
    for i in range(80):
        w = [random.choice(v) for _ in range(random.randint(0, 120))]
        if i % 3 == 0:
            q = word_list(items[i % 40][1])
            a = random.randint(0, max(0, len(q) - 13))
            w[len(w) // 2 : len(w) // 2] = q[a : a + random.choice([11, 12, 13, 20])]
        docs.append((i, random.choice([" ", ", ", "\n"]).join(w).upper()))
    docs += [(200, None), (201, ""), (None, "w1"), (5, docs[5][1]), (202, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc bigint, body string, size int, query_id string")
    tests = spark.createDataFrame([(q, t, 0) for q, t in items if q != 3], "q bigint, t string, id int")
    got = [tuple(r) for r in leaked_items(df, "doc", "body", tests, "q", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == leaks(docs, [x for x in items if x[0] != 3])


def test_a_passage_of_a_third_of_all(spark):
    """The same words open a third of the items and of the documents; only those that go on alike for 13 words count."""
    intro = "how can i configure the following on my server"
    items = [(i, (intro + " " if i % 3 == 0 else "") + " ".join(f"i{i}x{j}" for j in range(20))) for i in range(300)]
    docs = [(i, (intro + " " if i % 3 == 0 else "") + " ".join(f"{'i' if i % 30 == 0 else 'd'}{i}x{j}" for j in range(30))) for i in range(300)]
    got = leaked_items(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame(items, "q bigint, t string"), "q", "t")
    assert {tuple(r) for r in got.collect()} == leaks(docs, items) == {(i, i) for i in range(0, 300, 30)}


def test_no_leaks(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "d bigint, t string"), spark.createDataFrame([], "q bigint, t string")
    assert leaked_items(docs, "d", "t", none, "q", "t").count() == 0
    assert leaked_items(docs.limit(0), "d", "t", spark.createDataFrame([(1, "a b")], "q bigint, t string"), "q", "t").count() == 0


def spans(docs, n):
    where = {}
    for d, t in docs:
        if d is not None and t:
            for i in range(len(t) - n + 1):
                where.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d in {d for d, t in docs if d is not None and t}:
        covered = set()
        for e, t in docs:
            if e == d and t:
                for i in range(len(t) - n + 1):
                    if len(where[t[i : i + n]]) > 1:
                        covered |= set(range(i, i + n))
        run = []
        for i in sorted(covered):
            if run and run[-1] == i - 1:
                run[-1] = i
            else:
                if run:
                    out.add((d, run[0], run[-1] + 1))
                run = [i, i]
        if run:
            out.add((d, run[0], run[-1] + 1))
    return out


def span_docs(seed, n):
    random.seed(seed)

    def text(k):
        return "".join(random.choice("abc日é😀 ") for _ in range(k))

    passages = [text(random.randint(n - 2, 4 * n)) for _ in range(6)] + ["ab" * n, "x" * (3 * n)]
    docs = []
    for i in range(40):
        parts = [text(random.randint(0, 2 * n)) for _ in range(4)]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, len(p) // 3)
            parts.insert(random.randrange(len(parts)), p[a : len(p) - random.randint(0, len(p) // 4)])
        docs.append((i, "".join(parts)))
    same = text(3 * n)
    docs += [(100 + i, same) for i in range(12)] + [(200, None), (201, ""), (202, "short"), (203, same * 2), (None, same), (0, docs[0][1])]
    return docs


@pytest.mark.parametrize(("seed", "n", "group"), [(1, 20, 1 << 17), (2, 31, 1 << 17), (3, 20, 1)])
def test_spans_equal_brute_force(spark, seed, n, group):
    docs = span_docs(seed, n)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc bigint, body string, anchor string, low int")
    got = [tuple(r) for r in shared_spans(df, "doc", "body", n, group).collect()]
    assert len(got) == len(set(got)) and set(got) == spans(docs, n)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_any_spans(spark, seed):
    docs = span_docs(seed, 12)[:30]
    df = spark.createDataFrame(docs, "doc bigint, body string")
    assert {tuple(r) for r in shared_spans(df, "doc", "body", 12).collect()} == spans(docs, 12)


def test_shares_and_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "b" * 10), (2, "a" * 10), (3, None), (4, "")], "doc bigint, body string")
    got = {r["doc"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in shared_share(df, shared_spans(df, "doc", "body", 10), "doc", "body").collect()}
    assert got == {1: (20, 10, 0.5), 2: (10, 10, 1.0), 3: (None, 0, None), 4: (0, 0, None)}
    assert shared_spans(df.limit(0), "doc", "body").count() == 0
    assert shared_spans(df, "doc", "body").count() == 0
