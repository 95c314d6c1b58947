import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import caching, evaluation, measures, retrieval
from marlstone.operators.asof import last_before
from marlstone.operators.bloom import bloom_filter, bloom_probe
from marlstone.operators.orphans import orphan_references
from marlstone.operators.skew import salted_join


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    probed = bloom_probe(spark.range(3000).withColumnRenamed("id", "k"), "k", bloom_filter(keys, "k", 2), 2, "maybe").cache()
    assert probed.filter("k % 3 = 0 AND NOT maybe").count() == 0
    assert probed.filter("k % 3 <> 0 AND maybe").count() < 60


def test_bloom_filter_of_nothing_and_null(spark):
    none = spark.createDataFrame([], "k bigint")
    asked = spark.createDataFrame([(1,), (None,)], "k bigint")
    assert bloom_probe(asked, "k", bloom_filter(none, "k", 1), 1, "maybe").filter("maybe").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_is_a_join(spark, how):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).cast("bigint").alias("k"), F.col("id").alias("x"))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    mine, plain = salted_join(big, small, "k", how), big.join(small, "k", how)
    assert sorted(map(tuple, mine.select("k", "x", "y").collect()), key=repr) == sorted(map(tuple, plain.select("k", "x", "y").collect()), key=repr)


POSTS = "id bigint, parent_id bigint, accepted_answer_id bigint, ingested_at timestamp, target string, kind string"
LINKS = "id bigint, post_id bigint, related_post_id bigint, ingested_at timestamp"


def test_orphans(spark):
    def day(n):
        return dt.datetime(2024, 1 + n, 1)

    posts = spark.createDataFrame(
        [(1, None, 2, day(0), None, None), (2, 1, None, day(1), "x", "y"), (3, 99, None, day(1), None, None), (3, 99, None, day(2), None, None), (4, 5, None, day(3), None, None), (5, None, None, day(0), None, None), (6, None, 6, day(1), None, None), (None, 1, 1, day(1), None, None)], POSTS
    )
    links = spark.createDataFrame([(1, 1, 98, day(0)), (1, 1, 98, day(4)), (2, 1, None, day(0)), (3, None, 2, day(0)), (4, 1, 97, day(0))], LINKS)
    removed = spark.createDataFrame([(5, day(2)), (5, day(1)), (97, day(0)), (1, dt.datetime(2023, 1, 1)), (None, day(0))], "post_id bigint, removed_at timestamp")
    got = {tuple(r) for r in orphan_references(posts, links, removed).collect()}
    assert got == {
        ("posts", "accepted_answer_id", 1, "2024-01", "late"), ("posts", "parent_id", 3, "2024-02", "missing"), ("posts", "parent_id", 4, "2024-04", "deleted"),
        ("post_links", "related_post_id", 1, "2024-01", "missing"), ("post_links", "related_post_id", 3, "2024-01", "late"), ("post_links", "related_post_id", 4, "2024-01", "deleted"),
    }


def test_orphans_of_nothing_and_with_a_full_filter(spark):
    empty = orphan_references(spark.createDataFrame([], POSTS), spark.createDataFrame([], LINKS), spark.createDataFrame([], "post_id bigint, removed_at timestamp"))
    assert empty.count() == 0
    now = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([(i, i + 10_000 if i % 2 else 1, None, now, None, None) for i in range(1, 20_000)], POSTS)
    none = spark.createDataFrame([], LINKS)
    got = orphan_references(posts, none, spark.createDataFrame([], "post_id bigint, removed_at timestamp"), max_blocks=1)
    assert got.count() == sum(1 for i in range(1, 20_000) if i % 2 and i + 10_000 >= 20_000)


def terms(spark, docs):
    return spark.createDataFrame([(i, t.split()) for i, t in docs], "doc_id bigint, terms array<string>")


def test_bm25_prefers_rare_terms_short_documents_and_saturates(spark):
    docs = terms(spark, [(1, "disk full"), (2, "disk full " + "pad " * 50), (3, "disk disk disk disk disk disk disk disk"), (4, "other words"), (5, "")])
    queries = spark.createDataFrame([(10, ["full", "disk"]), (11, ["nothing"]), (12, [])], "query_id bigint, terms array<string>")
    got = retrieval.sparse_search(queries, docs, 10).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {10}
    assert [r["doc_id"] for r in got] == [1, 2, 3] or [r["doc_id"] for r in got] == [1, 3, 2]
    one = retrieval.sparse_search(spark.createDataFrame([(1, ["disk"])], "query_id bigint, terms array<string>"), terms(spark, [(1, "disk x"), (2, "disk disk")]), 2).orderBy("rank").collect()
    assert one[0]["doc_id"] == 2 and one[0]["score"] < 3 * one[1]["score"]


def test_term_vectors(spark):
    docs = spark.createDataFrame([("x", ["b", "a", "b", None]), ("y", []), ("z", None), (None, ["a"])], "k string, t array<string>")
    got = {(r["k"], r["term"]): r["tf"] for r in retrieval.bm25_vectors(docs, "k", "t").collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 2, (None, "a"): 1}
    assert retrieval.bm25_vectors(docs.limit(0), "k", "t").count() == 0


def test_searches_in_blocks_of_queries_agree(spark):
    docs = terms(spark, [(i, " ".join(f"t{(i * k) % 17}" for k in range(1, 9))) for i in range(60)])
    queries = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(12)], "query_id bigint, terms array<string>")
    assert sorted(map(tuple, retrieval.sparse_search(queries, docs, 5).collect())) == sorted(map(tuple, retrieval.sparse_search(queries, docs, 5, query_rows=4).collect()))
    vec = spark.range(40).select(F.col("id").alias("doc_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 5)]).alias("vec"))
    asked = vec.select(F.col("doc_id").alias("query_id"), "vec").filter("query_id < 9")
    assert sorted(map(tuple, retrieval.dense_search(asked, vec, 3, 4).collect())) == sorted(map(tuple, retrieval.dense_search(asked, vec, 3, 4, query_rows=8).collect()))


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, terms array<string>")
    queries = spark.createDataFrame([(1, ["a"])], "query_id bigint, terms array<string>")
    assert retrieval.sparse_search(queries, none, 3).count() == 0
    assert retrieval.dense_search(spark.createDataFrame([], "query_id bigint, vec array<float>"), spark.createDataFrame([(1, [1.0])], "doc_id bigint, vec array<float>"), 3, 1).count() == 0


def ranked(spark, lists):
    return spark.createDataFrame([(1, d, r + 1, f"l{i}") for i, x in enumerate(lists) for r, d in enumerate(x)], "query_id bigint, doc_id bigint, rank int, retriever string")


def test_rrf(spark):
    top = retrieval.rrf_fuse(ranked(spark, [[1, 2, 3], [3, 2, 9]]), 2).orderBy("rank").collect()
    assert {r["doc_id"] for r in top[:2]} == {2, 3}
    assert [r["doc_id"] for r in retrieval.rrf_fuse(ranked(spark, [[10, 20], [20, 10]])).orderBy("rank").collect()] == [10, 20]
    assert {r["doc_id"]: r["retrievers"] for r in top}[9] == "l1"


def test_dedupe_by_document(spark):
    rows = spark.createDataFrame([(1, 100, 1, 1), (1, 101, 1, 2), (1, 102, 2, 3), (1, 103, 1, 4), (1, 104, 3, 5)], "query_id bigint, chunk_id bigint, doc_id bigint, rank int")
    got = retrieval.dedupe_by_document(rows, 2).orderBy("doc_rank").collect()
    assert [(r["doc_id"], r["chunk_id"]) for r in got] == [(1, 100), (2, 102)]


def test_metrics(spark):
    outcomes = spark.createDataFrame([(1, 9, 1), (1, 8, 2), (1, 7, 3), (1, 42, 4), (2, 5, 1)], "query_id bigint, doc_id bigint, rank int")
    relevant = spark.createDataFrame([(1, 42, 1.0), (2, 6, 1.0), (3, 1, 2.0)], "query_id bigint, doc_id bigint, gain double")
    m = {r["query_id"]: r for r in evaluation.query_metrics(outcomes, relevant, (3, 4)).collect()}
    assert (m[1]["recall_3"], m[1]["recall_4"], m[1]["rr"]) == (0.0, 1.0, 0.25)
    assert m[2]["rr"] == 0 and m[3]["ndcg"] == 0
    report = evaluation.retrieval_report(spark.createDataFrame(list(m.values()))).first()
    assert report["misses"] == 2 and report["n_queries"] == 3
    graded = spark.createDataFrame([(1, d, float(g)) for d, g in ((1, 3), (2, 2), (3, 1))], "query_id bigint, doc_id bigint, gain double")
    best = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id bigint, doc_id bigint, rank int")
    assert evaluation.query_metrics(best, graded).first()["ndcg"] == pytest.approx(1)


def test_label_pairs_give_each_reason(spark):
    now = dt.datetime(2024, 1, 1)
    long = "a title that is long enough"
    posts = spark.createDataFrame([(1, long, 5, "b", now), (2, long, 5, "b", now), (3, "short", 5, "b", now), (4, long, 0, "b", now), (5, long, 3, "b", now), (6, None, 3, "b", now), (8, long, 1, "b", now), (9, long, 1, "b", now)], "id bigint, title string, score bigint, body string, ingested_at timestamp")
    links = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 999, 3), (3, 8, 4, 3), (4, 3, 2, 3), (5, 1, 5, 3), (6, 9, 1, 3), (7, 8, 6, 3), (8, 1, 2, 1), (9, 1, 1, 3)], "id bigint, post_id bigint, related_post_id bigint, link_type_id int")
    got = {r["link_id"]: r["reason"] for r in evaluation.label_pairs(posts, links).collect()}
    assert got == {1: None, 2: "missing_post", 3: "low_score", 4: "short_title", 5: "repeated_query", 6: "chained", 7: "no_title"}


def test_nearest_rank_and_histogram(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("g"), (F.col("id") * 100).alias("v"))
    assert tuple(measures.nearest_rank(df, ["g"], "v").select("p50", "p95", "p99").first()) == (50000, 95000, 99000)
    h = measures.histogram(df.withColumn("v", F.col("v") / 1e6), ["g"], "v", [0.05, 0.06]).orderBy("le").collect()
    assert [r["cumulative"] for r in h] == [500, 600, 1000]
    q = measures.histogram_quantile(spark.createDataFrame(h), ["g"], 0.55).first()["value"]
    assert q == pytest.approx(0.055)


def test_load_report(spark):
    s = spark.createDataFrame([("a", 0, 100_000, 10_000, True), ("b", 0, 0, 10_000, True), ("b", 0, 0, 1, False), ("b", 0, 0, 1, False)], "g string, intended_us bigint, actual_us bigint, service_us bigint, ok boolean")
    r = {x["g"]: x for x in measures.load_report(s, ["g"]).collect()}
    assert r["a"]["corrected_p95_ms"] == 110 and r["a"]["naive_p95_ms"] == 10 and r["a"]["fell_behind"]
    assert r["b"]["error_rate"] == pytest.approx(2 / 3, abs=1e-6)


def test_budgets(spark):
    c = spark.createDataFrame([("p95", 25.0, 23.1, True), ("recall", 0.85, 0.81, False), ("free", 0.0, 0.0, True)], "name string, budget double, measured double, lower_is_better boolean")
    r = {x["name"]: x for x in measures.budget_checks(c).collect()}
    assert r["p95"]["passed"] and r["p95"]["tight"] and not r["recall"]["passed"] and r["free"]["headroom"] is None
    spend = spark.createDataFrame([("t", 1, 0.02), ("t", 2, 0.03), ("t", 3, 0.02), ("u", 1, 0.01)], "trace string, seq int, usd double")
    got = measures.running_budget(spend, "trace", "seq", "usd", 0.06).orderBy("trace", "seq").collect()
    assert [x["status"] for x in got] == ["ok", "ok", "would_exceed", "ok"]


def test_usage_cost(spark):
    prices = spark.createDataFrame([("m", 2.0, 8.0, 2.5, 4.0, 0.5, "v"), ("n", 1.0, 1.0, 1.0, 1.0, 1.0, "v")], "model string, input_per_mtok double, output_per_mtok double, cache_write_5m_per_mtok double, cache_write_1h_per_mtok double, cache_read_per_mtok double, version string")
    schema = "model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint"
    got = measures.usage_cost(spark.createDataFrame([("m", 10_000, 1000, 0, 0)], schema), prices).first()
    assert got["usd"] == pytest.approx(0.028) and got["cache_hit_ratio"] == 0 and got["price_version"] == "v"
    both = spark.createDataFrame([("m", 0, 0, 1_000_000, 1_000_000, "5m", "r"), ("m", None, None, 1_000_000, 0, "1h", "r"), ("n", 1, 0, 0, 0, None, "r")], schema + ", ttl string, request string")
    costed = measures.usage_cost(both, prices, "ttl")
    assert sorted(round(r["cache_write_usd"], 6) for r in costed.collect()) == [0.0, 2.5, 4.0]
    by_model = {r["model"]: (r["n_calls"], r["cache_write_tokens"], round(r["usd"], 6)) for r in measures.request_cost(costed, "request", "model").collect()}
    assert by_model == {"m": (2, 2_000_000, 7.0), "n": (1, 0, 0.000001)}
    assert {r["model"]: (r["reads_5m"], r["reads_1h"]) for r in measures.breakeven_reads(prices).collect()} == {"m": (pytest.approx(1 / 3), pytest.approx(4 / 3)), "n": (None, None)}
    calls = spark.createDataFrame([("m", 1000, 0, 500), ("m", 1000, 900, 500)], "model string, input_tokens bigint, cached_tokens bigint, max_output_tokens bigint")
    assert [round(r["usd"], 6) for r in measures.projected_cost(calls, prices).orderBy("cached_tokens").collect()] == [0.006, 0.00645]
    asked = spark.createDataFrame([(1, "m", 1000, 600, 0), (2, "n", 1000, 600, 0), (3, None, 5, 5, 5)], "request_id bigint, model string, tokens_in bigint, prefix_tokens bigint, max_output_tokens bigint")
    warm = {r["request_id"]: (round(r["cold_usd"], 6), round(r["warm_usd"], 6)) for r in measures.cold_and_warm(asked, prices, [("n", 700)], 500).collect()}
    assert warm == {1: (0.002, 0.0011), 2: (0.001, 0.001), 3: (0.0, 0.0)}
    with pytest.raises(Exception, match="no price"):
        measures.usage_cost(spark.createDataFrame([("x", 1, 1, 0, 0)], schema), prices).collect()


def test_cache(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [("t", "Where  IS it", [1.0, 0.0], "a", 1, now), ("t", "other", [0.0, 1.0], "b", 2, now), ("u", "third", [1.0, 0.0], "c", 3, now), (None, "x", None, None, 4, now)]
    entries = spark.createDataFrame(rows, "tenant string, query string, embedding array<float>, answer string, seq bigint, inserted_at timestamp")
    entries = caching.distinct_entries(entries.union(entries))
    asked = spark.createDataFrame([(1, "t", "where is it", [0.98, 0.17]), (2, "u", "where is it", [0.4, 0.9]), (6, "t", "x", [0.0, 2.0]), (7, None, "x", [1.0, 0.0])], "query_id bigint, tenant string, query string, vec array<float>")
    exact = {r["query_id"]: r["hit_seq"] for r in caching.exact_lookup(asked, entries).collect()}
    assert exact == {1: 1, 2: None, 6: None, 7: None}
    # a lookup and an entry of the same number have nothing to do with each other
    assert {r["query_id"]: r["hit_seq"] for r in caching.semantic_lookup(asked, entries, 2).collect()} == {1: 1, 6: 2}
    later = asked.withColumn("at", F.lit(now + dt.timedelta(days=1)).cast("timestamp"))
    got = {r["query_id"]: (r["outcome"], r["hit_seq"], r["refused"]) for r in caching.lookup_outcomes(later, entries, 2, F.col("query") != "x").collect()}
    assert got == {1: ("exact", 1, False), 2: ("miss", None, False), 6: ("miss", None, True)}
    earlier = asked.withColumn("at", F.lit(now).cast("timestamp"))
    out = caching.lookup_outcomes(earlier, entries, 2, F.lit(True))
    assert {r["outcome"] for r in out.collect()} == {"miss"}
    stats = {r["tenant"]: (r["lookups"], r["misses"], r["refused"], r["hit_rate"]) for r in caching.cache_stats(caching.lookup_outcomes(later, entries, 2, F.col("query") != "x")).collect()}
    assert stats == {"t": (2, 1, 1, 0.5), "u": (1, 1, 0, 0.0)}


def test_last_before(spark):
    import random

    random.seed(3)
    events = [(random.choice([None, 1, 1, 1, 2, 3]), random.randrange(40), i) for i in range(300)]
    asked = [(random.choice([None, 1, 2, 4]), random.randrange(40), 1000 + i) for i in range(120)]
    got = last_before(spark.createDataFrame(asked, "k int, t int, id int"), spark.createDataFrame(events, "k int, t int, v int"), "k", ["t"], "v").collect()

    def want(k, t):
        earlier = [(y, v) for x, y, v in events if k is not None and x == k and y < t]
        return max(earlier)[1] if earlier else None

    assert sorted((r["id"], r["v"]) for r in got) == sorted(((i, want(k, t)) for k, t, i in asked), key=lambda x: x[0])
    none = spark.createDataFrame([], "k int, t int, v int")
    assert {r["v"] for r in last_before(spark.createDataFrame(asked, "k int, t int, id int"), none, "k", ["t"], "v").collect()} == {None}


def test_filters_of_dense_search(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], ["a"], 5, "t"), (2, [1.0, 0.1], ["b", "c"], 9, "t"), (3, [1.0, 0.2], None, 1, "u"), (4, [1.0, 0.3], ["a", "a"], None, None)], "doc_id bigint, vec array<float>, tags array<string>, at int, tenant string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["a", "z"], 6, "t"), (2, [1.0, 0.0], [], 9, "u"), (3, [1.0, 0.0], None, 100, None)], "query_id bigint, vec array<float>, tags array<string>, at int, tenant string")

    def found(**how):
        rows = retrieval.dense_search(asked, docs, 10, 2, **how).orderBy("query_id", "rank").collect()
        return {q: [r["doc_id"] for r in rows if r["query_id"] == q] for q in (1, 2, 3)}

    assert found() == {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4]}
    assert found(exclude_own=True)[1] == [2, 3, 4]
    assert found(any_of="tags") == {1: [1, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4]}
    assert found(before="at") == {1: [1, 3], 2: [1, 3], 3: [1, 2, 3]}
    assert found(same=["tenant"]) == {1: [1, 2], 2: [3], 3: []}
    assert found(same=["tenant"], any_of="tags", query_rows=2) == {1: [1], 2: [3], 3: []}


def test_classification(spark):
    from marlstone.functions import classify

    rows = [(1, "It does NOT start"), (2, "notable énot"), (3, None), (4, "use 512 GB in 2024"), (5, " ")]
    rules = [("temporal", "20[0-9]{2}"), ("negation", "not")]
    got = {r["i"]: (r["rule"], r["n"]) for r in spark.createDataFrame(rows, "i int, q string").select("i", classify.first_match(F.col("q"), rules).alias("rule"), classify.word_count(F.col("q")).alias("n")).collect()}
    assert got == {1: ("negation", 4), 2: (None, 2), 3: (None, 0), 4: ("temporal", 5), 5: (None, 0)}


def test_record_totals_trim_and_rates(spark):
    df = spark.createDataFrame([("a", [("embed", 9000), ("search", 6000), ("retrieval_total", 15000)]), ("b", None)], "k string, s array<struct<name string, micros bigint>>")
    assert {r["k"]: (r["total_ms"], r["n_stages"]) for r in measures.record_totals(df, "k", "s").collect()} == {"a": (15.0, 2), "b": (0.0, 0)}
    ranked_rows = spark.createDataFrame([("q", 1, 9.0), ("q", 2, 1.0), ("r", 1, 2.0), ("r", 2, 2.0), ("r", 3, 2.0)], "q string, rank int, cost double")
    assert sorted((r["q"], r["rank"]) for r in measures.trim_to_budget(ranked_rows, "q", "rank", "cost", 5.0).collect()) == [("q", 1), ("r", 1), ("r", 2)]
    one = spark.range(1).select(measures.tokens_per_second(F.lit(100), F.lit(3000.0), F.lit(1000.0)).alias("x"), measures.tokens_per_second(F.lit(1), F.lit(1.0), F.lit(1.0)).alias("y"), measures.affordable(F.lit(1.0), F.lit(0.2), F.lit(0.25)).alias("n"), measures.affordable(F.lit(0.1), F.lit(0.2), F.lit(0.25)).alias("z")).first()
    assert tuple(one) == (50.0, 0.0, 3, 0)


def test_cited_sources_and_degraded_answers(spark):
    answers = spark.createDataFrame([(1, "see [2], [2], [9] and array[i]"), (2, None)], "query_id bigint, answer string")
    sources = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "query_id bigint, rank int, doc_id bigint")
    assert [tuple(r) for r in retrieval.cited_sources(answers, sources).collect()] == [(1, 2, 20)]
    chunks = spark.createDataFrame([(1, 100, 1, 1, " aaaa", "u1"), (1, 101, 1, 2, "bbbb", "u1"), (1, 102, 2, 3, "cccc", None)], "query_id bigint, chunk_id bigint, doc_id bigint, rank int, text string, source_uri string")
    got = retrieval.degraded_answers(chunks, 3, 3, intro="").first()
    assert got["answer"] == "[1] u1\naa\n\n[2] \nccc\n\n" and got["doc_ids"] == [1, 2] and (got["tier"], got["usd"], got["degraded"]) == (0, 0.0, True)
    routed = spark.createDataFrame([(1, 0, None), (2, 1, "m")], "query_id bigint, tier int, model string")
    assert {r["query_id"]: (r["answer"], r["usd"]) for r in retrieval.answers_without_model(routed, "no").collect()} == {1: ("no", 0.0), 2: (None, None)}
    assert tuple(retrieval.distinct_documents(chunks.union(chunks.withColumn("query_id", F.lit(2))).union(chunks.withColumn("query_id", F.lit(3)).limit(1))).first()) == (3, 2, 1)
    assert tuple(retrieval.distinct_documents(chunks.limit(0)).first()) == (0, None, None)


def test_reports_sweeps_and_loads(spark):
    checks = measures.budget_checks(spark.createDataFrame([("a", 1.0, 0.95, True), ("b", 1.0, 2.0, True), ("c", 1.0, None, False)], "name string, budget double, measured double, lower_is_better boolean"))
    r = measures.budget_report(checks, warm="yes").first()
    assert (r["passed"], r["n_checks"], r["failures"], r["tight"], r["warm"]) == (False, 3, ["b", "c"], ["a"], "yes")
    assert measures.budget_report(checks.limit(0)).first()["passed"]
    assert measures.budgets(spark, {"p95": (25, True)}).first()["budget"] == 25.0
    m = spark.createDataFrame([("x", 350, 100, 10.0), ("y", 350, 100, 5.0), ("z", 128, 100, 1.0)], "configuration string, tokens int, n bigint, seconds double")
    p = measures.ingest_projection(m, 350, {"all": 72000}).first()
    assert (p["configuration"], p["per_second"], p["hours"]) == ("y", 20.0, 1.0)
    failing = iter([None] * 2 + [1, 0, 1])
    samples = measures.run_load(spark, lambda i: 1 / (next(failing) if i >= 0 else 1), 50, 0.06, warmup=0)
    assert samples.count() == 3
    line = measures.render_load(measures.load_report(samples.withColumn("g", F.lit(None).cast("string")), ["g"])).first()["line"]
    assert line.startswith("n=3")
    s = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 1, 20)], "e string, t int, micros bigint")
    assert [(r["e"], r["t"]) for r in measures.sweep(s, ["e", "t"], "micros").filter("best").collect()] == [("a", 1)]


def test_percentiles_of_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", None), ("b", 5)], "g string, v bigint")
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["most"]) for r in measures.discrete_percentiles(df, ["g"], "v").collect()}
    assert got == {None: (2, 1, 3, 3), "a": (0, None, None, None), "b": (1, 5, 5, 5)}
    h = measures.histogram(df, ["g"], "v", [2.0]).collect()
    assert sorted((r["g"] or "", r["le"], r["n"], r["cumulative"]) for r in h) == [("", 2.0, 1, 1), ("", float("inf"), 1, 2), ("b", 2.0, 0, 0), ("b", float("inf"), 1, 1)]


def test_observations_and_attributes(spark):
    schema = "id int, tenant string, route_tier int, cache_outcome string, degraded boolean, stages array<struct<name string, micros bigint>>, usd double, cache_similarity float, candidates int, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, price_version string, model string"
    rows = [(1, "t", 1, "miss", False, [("embed", 5000)], 0.25, None, 7, 10, 0, 0, None, "v", None), (2, "t", 0, "semantic_hit", True, None, None, 0.96875, 0, 0, 0, 0, 0, None, None)]
    r = spark.createDataFrame(rows, schema)
    got = sorted((x["tenant"], x["metric"], x["label"] or "", x["value"]) for x in measures.observations(r).collect())
    assert got == [("t", "request_usd", "", 0.0), ("t", "request_usd", "", 0.25), ("t", "stage_seconds", "embed", 0.005), ("t", "tokens", "input", 10.0)]
    a = {x["id"]: x["attributes"] for x in measures.record_attributes(r, "id").collect()}
    assert a[1]["cost_usd"] == "0.250000" and "model" not in a[1] and a[1]["price_version"] == "v" and a[2]["cache_similarity"] == "0.9688" and a[2]["degraded"] == "true"
