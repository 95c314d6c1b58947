"""Registered queries of the retrieval operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import classify as C
from marlstone.functions import text as T
from marlstone.functions.vectors import cosine
from marlstone.operators import caching, chunking, corpus, evaluation, measures, retrieval
from marlstone.runtime import materialise, shared_dir, table
from marlstone.sources import tables, xml
from marlstone.streaming import ingest

DIM = 64
#: An example of rules; the operator knows none.
RULES = [("temporal", r"20[0-9]{2}|today|yesterday|latest|current"), ("negation", r"not|don't|never|without|no"), ("numeric", r"[0-9]+(\.[0-9]+)* ?(gb|mb|tb|ms|%)|port [0-9]+")]


def _posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return evaluation.current_posts(table(spark, sf_dir, "posts"), *columns)


def corpus_scan_stats(spark, sf_dir):
    return corpus.scan_stats(table(spark, sf_dir, "posts"))


def tag_histogram(spark, sf_dir):
    return corpus.tag_histogram(_posts(spark, sf_dir, "tags"))


def tag_histogram_topn(spark, sf_dir):
    return corpus.tag_histogram(_posts(spark, sf_dir, "tags"), 12)


def gold_tag_distribution(spark, sf_dir):
    return table(spark, sf_dir, "golden_pairs").select(F.explode("gold_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def parse_tags(spark, sf_dir):
    return _posts(spark, sf_dir, "tags").select("id", F.posexplode(T.parse_tags(F.col("tags"))).alias("pos", "tag"))


def html_clean(spark, sf_dir):
    return _posts(spark, sf_dir, "body").select("id", T.html_to_text(F.col("body")).alias("text"))


def text_profile(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(text).alias("tokens"), T.has_code(text).alias("has_code"), T.content_hash(text).alias("content_hash"), T.excerpt(text, 80).alias("excerpt"))


def duplicate_hashes(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash")).filter("content_hash IS NOT NULL")
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def document_text(spark, sf_dir):
    docs = table(spark, sf_dir, "qa_docs")
    return docs.select("doc_id", T.token_count(T.full_text(F.col("title"), F.col("body"), F.col("answers"))).alias("full_tokens"), T.context_prefix(F.col("title"), F.col("tags")).alias("prefix")).distinct()


def chunk_documents(spark, sf_dir):
    chunks = chunking.chunk_documents(_qa_docs(spark, sf_dir))
    return chunks.select("chunk_id", T.as_uuid(F.col("chunk_id")).alias("chunk_uuid"), "doc_id", "chunk_index", "chunk_count", "content_hash", "element_type", "token_count", "split_code", "text", "pipeline_version")


def _qa_docs(spark, sf_dir):
    """Each different document once: of equal hashes one row, so nothing but ids and hashes decides, and rows spread by both."""
    return table(spark, sf_dir, "qa_docs").withColumn("_h", F.xxhash64("title", "body", "answers")).dropDuplicates(["doc_id", "_h"]).drop("_h")


def chunk_stats(spark, sf_dir):
    return corpus.chunk_stats(chunking.chunk_documents(_qa_docs(spark, sf_dir)))


def raw_chunk_stats(spark, sf_dir):
    chunks = table(spark, sf_dir, "raw_chunks").groupBy("raw_id").agg(F.max(F.struct("doc_id", "element_type", "text")).alias("c")).select("raw_id", "c.*")
    return corpus.chunk_stats(chunks.withColumn("token_count", T.token_count(F.col("text"))))


def chunk_token_percentiles(spark, sf_dir):
    chunks = table(spark, sf_dir, "raw_chunks").select("raw_id", "element_type", "text").distinct().withColumn("tokens", T.token_count(F.col("text")))
    return measures.nearest_rank(chunks, ["element_type"], "tokens")


def changed_chunks(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_chunks").select("raw_id", "doc_id", "chunk_index", "text").distinct()
    old = raw.select(T.chunk_id(F.col("doc_id"), F.col("chunk_index"), T.content_hash(F.col("text"))).alias("chunk_id"))
    edited = raw.withColumn("text", F.when(F.pmod("raw_id", F.lit(7)) == 0, F.concat("text", F.lit(" (edited)"))).when(F.pmod("raw_id", F.lit(7)) == 1, F.concat(F.lit("  "), "text")).otherwise(F.col("text")))
    new = edited.select("raw_id", T.chunk_id(F.col("doc_id"), F.col("chunk_index"), T.content_hash(F.col("text"))).alias("chunk_id"))
    return chunking.changed_chunks(old, new)


def answers_top3(spark, sf_dir):
    return corpus.top_answers(_posts(spark, sf_dir)).select("parent_id", "answer_id", F.col("i").alias("rank_no"))


def assembled_documents(spark, sf_dir):
    docs = corpus.assemble_documents(_posts(spark, sf_dir))
    return docs.select("doc_id", "title", F.size("answers").alias("n_answers"), F.octet_length(F.array_join("answers", "\n")).alias("answer_bytes"), F.array_join("tags", ",").alias("tag_list"), "score", "effective_date", "source_uri")


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.terms(F.col("text")).alias("terms"))


def bm25_stats(spark, sf_dir):
    return retrieval.bm25_stats(_terms(spark, sf_dir), "terms").withColumn("avg_len", F.round("avg_len", 6))


def bm25_idf(spark, sf_dir):
    return retrieval.bm25_idf(_terms(spark, sf_dir), "terms").withColumn("idf", F.round("idf", 6))


def bm25_doc_vector(spark, sf_dir):
    return retrieval.bm25_vectors(_terms(spark, sf_dir), "doc_id", "terms").withColumn("weight", F.round("weight", 6))


def _questions(spark, sf_dir) -> DataFrame:
    """Terms of the current questions' titles and bodies, written once: searches read them several times."""
    posts = _posts(spark, sf_dir, "post_type_id", "title", "body").filter("post_type_id = 1")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.regexp_replace(F.coalesce("body", F.lit("")), "<[^>]*>", " "))
    return materialise(posts.select(F.col("id").alias("doc_id"), T.terms(text).alias("terms")))


def _asked(spark, sf_dir, with_body: bool) -> DataFrame:
    query = T.query_text(F.col("query_title"), F.col("query_body")) if with_body else F.col("query_title")
    return table(spark, sf_dir, "golden_pairs").select("query_id", T.terms(query).alias("terms"))


def _bm25(spark, sf_dir, with_body: bool, k: int, docs: DataFrame | None = None):
    """Labelled questions against all current questions but themselves."""
    found = retrieval.sparse_search(_asked(spark, sf_dir, with_body), _questions(spark, sf_dir) if docs is None else docs, k + 1).filter("query_id <> doc_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, False, 10)


def query_vectors(spark, sf_dir):
    docs = materialise(_terms(spark, sf_dir))
    found = retrieval.query_vector(_asked(spark, sf_dir, False), retrieval.document_frequencies(docs, "terms"), retrieval.bm25_stats(docs, "terms"))
    return found.withColumn("weight", F.round("weight", 6))


def rrf_fusion(spark, sf_dir):
    docs = _questions(spark, sf_dir)
    lists = _bm25(spark, sf_dir, False, 50, docs).withColumn("retriever", F.lit("title")).unionByName(_bm25(spark, sf_dir, True, 50, docs).withColumn("retriever", F.lit("body")))
    return retrieval.rrf_fuse(lists.select("query_id", "doc_id", "rank", "retriever"), limit=10)


def dense_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return retrieval.dense_search(queries, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), 10, DIM, exclude_own=True)


def dense_knn_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    return retrieval.dense_search(queries, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label"), 10, DIM, ["label"], exclude_own=True)


def _cache_sides(spark, sf_dir):
    entries = materialise(caching.distinct_entries(table(spark, sf_dir, "cache_entries")))
    return entries.filter(F.pmod("seq", F.lit(20)) == 0), entries


def hybrid_search(spark, sf_dir):
    asked, entries = _cache_sides(spark, sf_dir)
    dense = retrieval.dense_search(asked.select(F.col("seq").alias("query_id"), F.col("embedding").alias("vec")), entries.select(F.col("seq").alias("doc_id"), F.col("embedding").alias("vec")), 50, DIM, exclude_own=True)
    sparse = retrieval.sparse_search(asked.select(F.col("seq").alias("query_id"), T.terms(F.col("query")).alias("terms")), entries.select(F.col("seq").alias("doc_id"), T.terms(F.col("query")).alias("terms")), 51)
    sparse = sparse.filter("query_id <> doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 50")
    return retrieval.hybrid_search(dense, sparse, 10)


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "raw_chunks").groupBy("raw_id").agg(F.max(F.struct("doc_id", "text")).alias("c")).select(F.col("raw_id").alias("chunk_id"), "c.doc_id", "c.text")


def _chunk_search(spark, sf_dir, k: int) -> DataFrame:
    """(query_id, chunk_id, doc_id, text, rank): chunks for the labelled questions' titles."""
    chunks = materialise(_chunks(spark, sf_dir))
    docs = materialise(chunks.select(F.col("chunk_id").alias("doc_id"), T.terms(F.col("text")).alias("terms")))
    found = retrieval.sparse_search(_asked(spark, sf_dir, False), docs, k).withColumnRenamed("doc_id", "chunk_id")
    return found.join(chunks, "chunk_id")


def dedupe_by_document(spark, sf_dir):
    return retrieval.dedupe_by_document(_chunk_search(spark, sf_dir, 50), 10)


def distinct_documents(spark, sf_dir):
    return retrieval.distinct_documents(_chunk_search(spark, sf_dir, 50))


def _sourced(spark, sf_dir, k: int) -> DataFrame:
    uris = table(spark, sf_dir, "qa_docs").groupBy("doc_id").agg(F.max("source_uri").alias("source_uri"))
    return _chunk_search(spark, sf_dir, k).join(uris, "doc_id", "left")


def degraded_answers(spark, sf_dir):
    a = retrieval.degraded_answers(_sourced(spark, sf_dir, 20))
    return a.select("query_id", "answer", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"), "tier", "usd", "degraded")


def render_sources(spark, sf_dir):
    """The three best chunks of each labelled question as a prompt's sources, and the tokens they take."""
    best = _chunk_search(spark, sf_dir, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"))
    text = T.render_sources(F.transform("l", lambda x: x["text"]))
    return best.select("query_id", F.sha2(text, 256).alias("hash"), T.token_count(text).alias("tokens"))


def cited_sources(spark, sf_dir):
    """Answers that cite two sources each, one of which may not exist."""
    found = _chunk_search(spark, sf_dir, 5)
    said = F.format_string("see [%d], [%d] and [%d]", F.pmod("query_id", F.lit(5)) + 1, F.pmod("query_id", F.lit(9)) + 1, F.pmod("query_id", F.lit(5)) + 1)
    answers = table(spark, sf_dir, "golden_pairs").select("query_id", said.alias("answer"))
    return retrieval.cited_sources(answers, found.select("query_id", "rank", "doc_id"))


def _routed(spark, sf_dir) -> DataFrame:
    tier = C.tier(F.col("query_title"), F.lit(False), [("0:trivial", "hi|thanks"), ("2:compares", "versus|compare|against")], 14)["tier"]
    r = table(spark, sf_dir, "golden_pairs").select("query_id", "query_title", tier.alias("tier"))
    return r.withColumns({"cap": F.when(F.col("tier") == 1, 12).when(F.col("tier") == 2, 8).otherwise(0), "model": F.when(F.col("tier") == 1, "small").when(F.col("tier") == 2, "large")})


def tier_zero_answers(spark, sf_dir):
    return retrieval.answers_without_model(_routed(spark, sf_dir))


def cost_benchmark(spark, sf_dir):
    """By tier: requests, tokens in and worst cost of a labelled question's route, retrieval of 60 chunks, one a document up to the tier's cap, and prompt."""
    routed = materialise(_routed(spark, sf_dir))
    found = materialise(_chunk_search(spark, sf_dir, 60))
    kept = retrieval.dedupe_by_document(found, 12).join(routed.select("query_id", "cap"), "query_id").filter(F.col("doc_rank") <= F.col("cap"))
    used = kept.join(found.select("query_id", "chunk_id", "text"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_rank", "text"))).alias("l"))
    context = used.select("query_id", T.token_count(T.render_sources(F.transform("l", lambda x: x["text"]))).cast("bigint").alias("context"))
    empty = T.token_count(T.render_sources(F.array().cast("array<string>"))).cast("bigint")
    asked = routed.join(context, "query_id", "left").select(F.col("query_id").alias("request_id"), "tier", "model", (F.lit(170) + F.coalesce("context", empty) + T.token_count(F.coalesce("query_title", F.lit("")))).alias("tokens_in"), F.lit(170).cast("bigint").alias("prefix_tokens"), F.lit(900).cast("bigint").alias("max_output_tokens"))
    costed = materialise(measures.cold_and_warm(asked, _prices(spark), [("small", 2048)], 128))
    rounded = costed.withColumns({c: F.round(F.col(c), 9) for c in ("cold_usd", "warm_usd")})
    out = rounded.groupBy("tier").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("warm_usd"), 6).alias("warm_usd"))
    p = measures.nearest_rank(rounded, ["tier"], "cold_usd").select("tier", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])
    return out.join(p, "tier")


def golden_build(spark, sf_dir):
    labelled = evaluation.label_pairs(table(spark, sf_dir, "posts"), table(spark, sf_dir, "post_links"))
    return labelled.filter("reason IS NULL").select("query_id", "gold_doc_id", "query_title", T.excerpt(F.col("query_body")).alias("query_body"), "gold_title", "gold_score")


def golden_build_stats(spark, sf_dir):
    return evaluation.build_stats(evaluation.label_pairs(table(spark, sf_dir, "posts"), table(spark, sf_dir, "post_links")))


def golden_split(spark, sf_dir):
    return table(spark, sf_dir, "golden_pairs").select("query_id", F.when(T.in_split(F.col("query_id"), 0.2), "test").otherwise("train").alias("split"))


def index_composition(spark, sf_dir):
    """All gold documents and about as many others: the size follows the labelled questions."""
    gold = table(spark, sf_dir, "golden_pairs")
    return corpus.index_composition(_posts(spark, sf_dir, "post_type_id").filter("post_type_id = 1"), gold, 2 * gold.select("gold_doc_id").distinct().count())


def _metrics(spark, sf_dir):
    relevant = table(spark, sf_dir, "golden_pairs").select("query_id", F.col("gold_doc_id").alias("doc_id"), F.lit(1.0).alias("gain"))
    return evaluation.query_metrics(_bm25(spark, sf_dir, True, 100), relevant)


def eval_queries(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


def eval_report(spark, sf_dir):
    return evaluation.retrieval_report(_metrics(spark, sf_dir))


def eval_misses(spark, sf_dir):
    return _metrics(spark, sf_dir).filter("rr = 0").select("query_id")


def eval_by_label(spark, sf_dir):
    """Vectors of the query's own label are relevant, with graded gain for near ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = e.filter(F.pmod("vec_id", F.lit(20)) == 0)
    gain = F.when(F.abs(F.col("doc_id") - F.col("query_id")) < 100, 3.0).otherwise(1.0)
    relevant = asked.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("doc_id <> query_id").select("query_id", "doc_id", gain.alias("gain"))
    m = evaluation.query_metrics(dense_knn(spark, sf_dir), relevant, (1, 5, 10))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


def vector_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", "embedding"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def exact_cache(spark, sf_dir):
    asked, entries = _cache_sides(spark, sf_dir)
    lookups = asked.select(F.col("seq").alias("query_id"), "tenant", F.upper("query").alias("query"))
    return caching.exact_lookup(lookups, entries).select("query_id", "hit_seq", "answer")


def _nearby(vector: str):
    """A lookup's vector that isn't quite that of any entry: every third component half as large again."""
    return F.transform(vector, lambda x, i: F.when(i % 3 == 0, x * F.lit(1.5).cast("float")).otherwise(x))


def semantic_cache(spark, sf_dir):
    """Lookups, numbered for themselves, near a twentieth of the entries, against all entries of their tenants."""
    asked, entries = _cache_sides(spark, sf_dir)
    return caching.semantic_lookup(asked.select((F.col("seq") + 1).alias("query_id"), "tenant", _nearby("embedding").alias("vec")), entries, DIM)


def cache_as_of(spark, sf_dir):
    return caching.exact_as_of(caching.distinct_entries(table(spark, sf_dir, "cache_entries"))).select("seq", "hit_seq")


def _outcomes(spark, sf_dir):
    """A twentieth of the entries as lookups made when they were inserted, against all that were inserted before."""
    asked, entries = _cache_sides(spark, sf_dir)
    lookups = asked.select(F.col("seq").alias("query_id"), "tenant", "query", F.col("embedding").alias("vec"), F.col("inserted_at").alias("at"))
    return caching.lookup_outcomes(lookups, entries, DIM, C.first_match(F.col("query"), RULES).isNull())


def cache_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def cache_stats(spark, sf_dir):
    return caching.cache_stats(_outcomes(spark, sf_dir))


def citations(spark, sf_dir):
    """Numbers in brackets in documents, as citations of up to 12 sources."""
    found = T.citations(F.regexp_replace("text", r"\b(\d{1,2})\b", "[$1]"), F.lit(12))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(found).alias("source"))


def latency_percentiles(spark, sf_dir):
    return measures.latency_percentiles(_stages(spark, sf_dir), ["stage"], "micros")


def _stages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 1000).alias("micros"), "ts", "user_id", "event_id")


def nearest_rank_pct(spark, sf_dir):
    return measures.nearest_rank(_stages(spark, sf_dir), ["stage"], "micros")


def latency_histogram(spark, sf_dir):
    seconds = _stages(spark, sf_dir).withColumn("seconds", F.col("micros") / 1e6)
    return measures.histogram(seconds, ["stage"], "seconds", measures.LATENCY_BOUNDS)


def histogram_quantile(spark, sf_dir):
    return measures.histogram_quantile(latency_histogram(spark, sf_dir), ["stage"], 0.95)


def rate_windows(spark, sf_dir):
    return measures.rate_windows(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 day", "6 hours")


def load_report(spark, sf_dir):
    due = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.pmod("event_id", F.lit(13)) * 5000
    s = table(spark, sf_dir, "events").select("event_type", due.alias("intended_us"), (due + late).alias("actual_us"), F.floor(F.col("value") * 1000).alias("service_us"), (F.pmod("event_id", F.lit(50)) != 0).alias("ok"))
    return measures.load_report(s, ["event_type"])


def slo_report(spark, sf_dir):
    p = latency_percentiles(spark, sf_dir).select(F.col("stage").alias("name"), F.lit(150.0).alias("budget"), F.col("p95_ms").alias("measured"), F.lit(True).alias("lower_is_better"))
    return measures.budget_checks(p)


def running_budget(spark, sf_dir):
    spend = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_extendedprice").cast("double")).alias("amount"))
    out = measures.running_budget(spend, "l_orderkey", "l_linenumber", "amount", 60000.0)
    return out.select("l_orderkey", "l_linenumber", F.round("spent_before", 2).alias("spent_before"), F.round("remaining", 2).alias("remaining"), "status")


def _prices(spark) -> DataFrame:
    """An example: the operators know no prices."""
    return spark.createDataFrame([("small", 1.0, 5.0, 1.25, 2.0, 0.1, "v1"), ("large", 5.0, 25.0, 6.25, 10.0, 0.5, "v1")], "model string, input_per_mtok double, output_per_mtok double, cache_write_5m_per_mtok double, cache_write_1h_per_mtok double, cache_read_per_mtok double, version string")


def _calls(spark, sf_dir) -> DataFrame:
    """Events as model calls of the requests of a user's day."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("request"), F.when(i % 3 == 0, "large").otherwise("small").alias("model"), F.when(i % 2 == 0, "1h").otherwise("5m").alias("ttl"),
        (i % 1000).alias("input_tokens"), (i % 100).alias("output_tokens"), (i % 7 * 100).alias("cache_write_tokens"), (i % 5 * 200).alias("cache_read_tokens"),
    )


def request_costs(spark, sf_dir):
    found = measures.request_cost(measures.usage_cost(_calls(spark, sf_dir), _prices(spark), "ttl"), "request", "model")
    return found.withColumn("usd", F.round("usd", 6))


def cost_projection(spark, sf_dir):
    calls = _calls(spark, sf_dir).select("model", "input_tokens", F.col("cache_read_tokens").alias("cached_tokens"), F.lit(900).cast("bigint").alias("max_output_tokens"))
    return measures.projected_cost(calls, _prices(spark)).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("usd"), 6).alias("usd"), F.round(F.max("usd"), 9).alias("most"))


def cache_breakeven(spark, sf_dir):
    return measures.breakeven_reads(_prices(spark)).select("model", F.round("reads_5m", 6).alias("reads_5m"), F.round("reads_1h", 6).alias("reads_1h"))


def _records(spark, sf_dir) -> DataFrame:
    """Events as request records."""
    i = F.col("event_id")
    micros = F.floor(F.col("value") * 1000)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), (i % 3).cast("int").alias("route_tier"), F.when(i % 5 == 0, "exact_hit").when(i % 5 == 1, "semantic_hit").otherwise("miss").alias("cache_outcome"),
        F.when(i % 5 == 1, F.lit(0.96875)).alias("cache_similarity"), (i % 11 == 0).alias("degraded"), F.round(F.col("value") / 1000, 6).alias("usd"), (i % 60).cast("int").alias("candidates"),
        (i % 1000).alias("input_tokens"), (i % 100).alias("output_tokens"), F.lit(0).cast("bigint").alias("cache_write_tokens"), (i % 2 * 50).alias("cache_read_tokens"), F.lit("v1").alias("price_version"), F.lit("small").alias("model"),
        F.array(F.struct(F.col("event_type").alias("name"), micros.alias("micros")), F.struct(F.lit("search").alias("name"), (i % 50 * 1000).alias("micros")), F.struct(F.lit("retrieval_total").alias("name"), (micros + i % 50 * 1000).alias("micros"))).alias("stages"),
    )


def record_totals(spark, sf_dir):
    return measures.record_totals(_records(spark, sf_dir), "event_id", "stages").withColumn("total_ms", F.round("total_ms", 3))


def record_attributes(spark, sf_dir):
    a = measures.record_attributes(_records(spark, sf_dir), "event_id")
    return a.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("attributes"))


def cost_histogram(spark, sf_dir):
    o = measures.observations(_records(spark, sf_dir)).filter("metric = 'request_usd'")
    return measures.histogram(o, measures.LABELS, "value", measures.COST_BOUNDS)


def stage_histogram(spark, sf_dir):
    o = measures.observations(_records(spark, sf_dir)).filter("metric = 'stage_seconds'").withColumnRenamed("label", "stage")
    return measures.histogram(o, ["stage", "tenant"], "value", measures.LATENCY_BOUNDS)


def token_usage(spark, sf_dir):
    o = measures.observations(_records(spark, sf_dir)).filter("metric = 'tokens'")
    return o.groupBy("tenant", "route_tier", F.col("label").alias("token_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("tokens"))


def rate_ratios(spark, sf_dir):
    return measures.ratio_windows(_records(spark, sf_dir), "ts", "1 day", "6 hours", hit_rate=F.col("cache_outcome") != "miss", degraded_rate=F.col("degraded"))


def slo_summary(spark, sf_dir):
    r = measures.budget_report(slo_report(spark, sf_dir), host="local", warm="true")
    return r.withColumns({c: F.array_join(c, ",") for c in ("failures", "tight")})


def load_schedule(spark, sf_dir):
    return measures.schedule(spark, 50, 8)


def load_lines(spark, sf_dir):
    return measures.render_load(load_report(spark, sf_dir)).select("event_type", "line")


def decode_rate(spark, sf_dir):
    rate = measures.tokens_per_second(F.col("event_id") % 500, F.col("value") * 10, F.col("event_id") % 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(rate, 6).alias("tokens_per_second"))


def affordable_context(spark, sf_dir):
    n = measures.affordable(F.col("value") / 1000, F.lit(0.03125), (F.col("event_id") % 4) / 4096)
    return table(spark, sf_dir, "events").select("event_id", n.alias("chunks"))


def encoder_sweep(spark, sf_dir):
    s = _stages(spark, sf_dir).select(F.col("stage").alias("encoder"), (F.pmod("event_id", F.lit(4)) + 1).cast("int").alias("threads"), "micros")
    return measures.sweep(s, ["encoder", "threads"], "micros")


def ingest_projection(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("configuration"), F.when(F.col("event_id") % 2 == 0, 350).otherwise(128).alias("tokens")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.floor(F.col("value") * 1000)) / 1e6).alias("seconds"))
    p = measures.ingest_projection(m, 350, {"all": 638156, "some": 100000})
    return p.withColumns({c: F.round(c, 6) for c in ("per_second", "hours")})


def stage_windows(spark, sf_dir):
    return ingest.stage_windows(_stages(spark, sf_dir), "ts", "stage", "micros", "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _scratch(spark) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"


def posts_xml(spark, sf_dir):
    """Current posts written as XML and read back; control characters, which XML can't hold, as blanks."""
    path = _scratch(spark)
    title = F.trim(F.regexp_replace("title", r"[\x00-\x1f\x7f-\x9f\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]", " "))
    p = _posts(spark, sf_dir, "post_type_id", "parent_id", "accepted_answer_id", "score", "title", "tags")
    named = {"_Id": F.col("id"), "_PostTypeId": F.col("post_type_id"), "_ParentId": F.col("parent_id"), "_AcceptedAnswerId": F.col("accepted_answer_id"), "_Score": F.col("score"), "_Title": title, "_Body": F.lit("b"), "_Tags": F.col("tags")}
    p.select(*[c.alias(k) for k, c in named.items()]).write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)
    back = xml.read_posts(spark, path)
    return back.select("id", "post_type_id", "parent_id", "accepted_answer_id", "score", F.coalesce("title", F.lit("")).alias("title"), F.array_join(T.parse_tags(F.col("tags")), ",").alias("tags"))


def links_xml(spark, sf_dir):
    path = _scratch(spark)
    named = {"_Id": "id", "_PostId": "post_id", "_RelatedPostId": "related_post_id", "_LinkTypeId": "link_type_id"}
    table(spark, sf_dir, "post_links").select(*[F.col(c).alias(k) for k, c in named.items()]).write.format("xml").option("rowTag", "row").option("rootTag", "links").save(path)
    return xml.read_duplicate_links(spark, path)


def index_upsert(spark, sf_dir):
    """Chunks of two tenants put into one index, all of them twice; what it holds and what each step added."""
    path = _scratch(spark)
    tables.ensure_index(spark, path)
    raw = table(spark, sf_dir, "raw_chunks").filter("text IS NOT NULL")
    chunks = raw.select(T.chunk_id(F.col("doc_id"), F.col("chunk_index"), T.content_hash(F.col("text"))).alias("chunk_id"), "doc_id", "chunk_index", "text", "element_type")
    one, two = chunks.withColumn("tenant_id", F.lit("a")), chunks.filter("doc_id % 2 = 0").withColumn("tenant_id", F.lit("b"))
    added = [tables.upsert_index(one, path), tables.upsert_index(two, path), tables.upsert_index(one.unionByName(two), path)]
    return spark.read.schema(tables.INDEX).parquet(path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids")).withColumn("added", F.when(F.col("tenant_id") == "a", F.lit(added[0])).otherwise(F.lit(added[1]))).withColumn("again", F.lit(added[2]))


def term_stats_saved(spark, sf_dir):
    path = _scratch(spark)
    docs = materialise(_terms(spark, sf_dir))
    tables.save_term_stats(retrieval.document_frequencies(docs, "terms"), retrieval.bm25_stats(docs, "terms"), path)
    frequencies, stats = tables.load_term_stats(spark, path)
    return frequencies.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("sum_df"), F.max("df").alias("max_df")).withColumns({c: stats.select(c).scalar() for c in ("doc_count", "total_len")})


def golden_saved(spark, sf_dir):
    path = _scratch(spark)
    pairs = table(spark, sf_dir, "golden_pairs").select("query_id", "gold_doc_id", "query_title")
    tables.save_pairs(pairs, path, source="golden_pairs")
    back, about = tables.load_pairs(spark, path, "query_id bigint, gold_doc_id bigint, query_title string")
    return back.withColumn("source", F.lit(about["source"]))


def sparse_attached(spark, sf_dir):
    chunks = materialise(_chunks(spark, sf_dir).select("chunk_id", T.terms(F.col("text")).alias("terms")))
    got = tables.attach_sparse(chunks.select("chunk_id"), retrieval.bm25_vectors(chunks.filter("terms IS NOT NULL"), "chunk_id", "terms"))
    total = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, x: a + x)
    return got.select("chunk_id", F.coalesce(F.size("sparse"), F.lit(0)).alias("n_terms"), F.round(total, 6).alias("weight"), F.array_min(F.map_keys("sparse")).alias("first_term"))


def sse_completions(spark, sf_dir):
    """Titles as streamed responses, cut in the middle of frames, the last frame left open."""
    t = F.coalesce("title", F.lit(""))
    events = [
        F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(F.lit("m").alias("model"), F.struct(F.coalesce("n_chars", F.lit(0)).alias("input_tokens")).alias("usage")).alias("message"))),
        F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.substring(t, 1, 5).alias("text")).alias("delta"))),
        F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.substr(t, F.lit(6)).alias("text")).alias("delta"))),
        F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.lit("end_turn").alias("stop_reason")).alias("delta"), F.struct(F.length(t).alias("output_tokens")).alias("usage"))),
        F.lit('{"type": "message_delta", "usage": {"output_tokens": 999999}'),
    ]
    body = F.concat_ws("\n\n", *[F.concat(F.lit("event: e\ndata: "), e) for e in events])
    whole = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), body.alias("s"))
    size = F.greatest(F.length("s") / 3, F.lit(1)).cast("int")
    pieces = whole.select("stream", F.posexplode(F.array(*[F.substr("s", 1 + i * size, size if i < 3 else F.length("s")) for i in range(4)])).alias("seq", "data"))
    done = tables.completions(tables.assemble_frames(pieces, "stream", "seq", "data"), "stream")
    return done.select("stream", "text", "model", "input_tokens", "cache_read_tokens", "output_tokens", "stop_reason", "error")


def pipeline_tags(spark, sf_dir):
    tag = T.pipeline_tag(F.coalesce("lang", F.lit("none")), F.lit("chunk1"), F.lit("e1"))
    return table(spark, sf_dir, "documents").groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def dense_knn_tags(spark, sf_dir):
    """Nearest vectors among those whose document has one of the query's tags; a query without tags finds any."""
    tags = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "tags")
    e = materialise(table(spark, sf_dir, "embeddings").join(tags, "vec_id", "left"))
    queries = e.filter(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "tags")
    return retrieval.dense_search(queries, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "tags"), 10, DIM, any_of="tags", exclude_own=True)


def scan_limit(spark, sf_dir):
    """A scan that stops after a hundred rows; which ones is open, so they are counted."""
    path = _scratch(spark)
    table(spark, sf_dir, "posts").select(F.col("id").alias("_Id")).write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)
    return xml.read_posts(spark, path, 100).agg(F.count(F.lit(1)).alias("n"))


def links_fingerprint(spark, sf_dir):
    return tables.fingerprint(table(spark, sf_dir, "post_links").select("id", "post_id", "related_post_id", "link_type_id", "creation_date"))


def slo_budgets(spark, sf_dir):
    """Declared budgets of some stages against what was measured; a stage without budget isn't checked."""
    declared = measures.budgets(spark, {"click": (150.0, True), "error": (60.0, True), "view": (90.0, True), "none": (1.0, False)})
    measured = latency_percentiles(spark, sf_dir).select(F.col("stage").alias("name"), F.col("p95_ms").alias("measured"))
    return measures.budget_checks(declared.join(measured, "name"))


def embedded_documents(spark, sf_dir):
    """Vectors of an encoder that counts characters, blanks and line feeds, of texts with an encoder's query prefix."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]

    e = tables.embed(table(spark, sf_dir, "documents"), "doc_id", "text", encode, tables.query_prefix("bge-small-en-v1.5"), dim=3)
    return e.select("doc_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("n_chars", "n_blanks", "n_lines"))])


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def streamed_documents(spark, sf_dir):
    """Posts streamed into a chunk index, the whole stream twice: which documents it has, and that no chunk is there twice."""
    path = _scratch(spark)
    source = table(spark, sf_dir, "posts")
    for k in range(2):
        stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/posts.parquet*")
        _finished(ingest.ingest_stream(stream, f"{path}/index", f"{path}/checkpoint{k}"))
    index = spark.read.parquet(f"{path}/index")
    return index.groupBy("doc_id", "tenant_id").agg((F.count(F.lit(1)) == F.countDistinct("chunk_id")).alias("once"))


def cache_streamed(spark, sf_dir):
    """All entries as a stream of requests in three batches, in the order of their times, against both levels of the cache."""
    path = _scratch(spark)
    entries = caching.distinct_entries(table(spark, sf_dir, "cache_entries")).filter("inserted_at IS NOT NULL")
    # a few files in the order of time, one a batch
    entries.repartitionByRange(3, "inserted_at").write.parquet(f"{path}/requests")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/requests").schema).parquet(f"{path}/requests")
    _finished(ingest.cached_answers(stream, f"{path}/store", f"{path}/outcomes", f"{path}/checkpoint", DIM, C.first_match(F.col("query"), RULES).isNull()))
    return spark.read.parquet(f"{path}/outcomes").drop("batch")


def cache_exact_streamed(spark, sf_dir):
    """The exact level alone, kept as state by key, over a stream of all entries."""
    path = _scratch(spark)
    entries = caching.distinct_entries(table(spark, sf_dir, "cache_entries")).select("seq", "tenant", "query")
    entries.write.parquet(f"{path}/requests")
    stream = spark.readStream.schema(entries.schema).parquet(f"{path}/requests")
    _finished(ingest.cache_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{path}/out")


def chunk_coverage(spark, sf_dir):
    """What chunks without overlap keep of each document: its characters other than white space and ticks, in order, and whether any chunk is over the limit or out of order."""
    chunks = chunking.chunk_documents(_qa_docs(spark, sf_dir), overlap=0, contextualize=False)
    kept = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "display_text"))), lambda x: x["display_text"]), ""), r"(?U)[\s`]+", "")
    per_doc = chunks.groupBy("doc_id", "doc_content_hash").agg(kept.alias("t"), F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.max("chunk_count").alias("total"), F.max("token_count").alias("most"))
    return per_doc.select("doc_id", F.sha2("t", 256).alias("hash"), ((F.col("n") == F.col("total")) & (F.col("last") + 1 == F.col("n"))).alias("numbered"), (F.col("most") <= 512).alias("within"))


def cost_by_type(spark, sf_dir):
    """Token usage priced by a given table: what the query passes in, the operator knows no prices."""
    p = _posts(spark, sf_dir, "post_type_id", "title", "body").select(F.when(F.col("post_type_id") == 1, "large").otherwise("small").alias("model"), T.token_count(F.col("body")).cast("bigint").alias("input_tokens"), T.token_count(F.coalesce("title", F.lit(""))).cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("cache_write_tokens"), F.lit(10).cast("bigint").alias("cache_read_tokens"))
    return measures.usage_cost(p, _prices(spark)).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("usd"), 6).alias("usd"), F.round(F.max("cache_hit_ratio"), 6).alias("best_hit_ratio"))


def classify_queries(spark, sf_dir):
    q = F.col("query")
    return caching.distinct_entries(table(spark, sf_dir, "cache_entries")).select("seq", C.first_match(q, RULES).alias("rule"), C.word_count(q).alias("words"))


def routing_mix(spark, sf_dir):
    asked = caching.distinct_entries(table(spark, sf_dir, "cache_entries")).filter("query IS NOT NULL")
    r = C.tier(F.col("query"), F.pmod("seq", F.lit(7)) == 0, [("0:trivial", "hi|thanks"), ("2:compares", "versus|compare|against")], 14)
    return asked.select(r.alias("r")).groupBy("r.tier", "r.reason").agg(F.count(F.lit(1)).alias("n"))


def cost_sensitivity(spark, sf_dir):
    sizes = table(spark, sf_dir, "raw_chunks").select("raw_id", "element_type", "text").distinct().select("element_type", T.token_count(F.col("text")).cast("double").alias("tokens"))
    return measures.sensitivity(sizes, ["element_type"], "tokens")


def context_trim(spark, sf_dir):
    """Best documents of each labelled question that fit into 1,500 tokens together."""
    found = _bm25(spark, sf_dir, False, 10)
    sizes = _posts(spark, sf_dir, "body").select(F.col("id").alias("doc_id"), T.token_count(F.coalesce("body", F.lit(""))).cast("double").alias("tokens"))
    return measures.trim_to_budget(found.join(sizes, "doc_id"), "query_id", "rank", "tokens", 1500.0).select("query_id", "doc_id", "rank", "running_cost")


QUERIES = {f.__name__: f for f in (
    corpus_scan_stats, tag_histogram, tag_histogram_topn, gold_tag_distribution, parse_tags, html_clean, text_profile, duplicate_hashes, document_text, chunk_documents, chunk_stats,
    raw_chunk_stats, chunk_token_percentiles, changed_chunks, answers_top3, assembled_documents, bm25_stats, bm25_idf, bm25_doc_vector, bm25_search, rrf_fusion, dense_knn, dense_knn_filtered,
    hybrid_search, dedupe_by_document, golden_build, golden_build_stats, golden_split, index_composition, eval_queries, eval_report, eval_misses, eval_by_label, vector_similarity, exact_cache,
    semantic_cache, cache_as_of, cache_stats, citations, latency_percentiles, nearest_rank_pct, latency_histogram, histogram_quantile, rate_windows, load_report, slo_report, running_budget, cost_by_type,
    classify_queries, routing_mix, cost_sensitivity, context_trim,
    query_vectors, distinct_documents, degraded_answers, render_sources, cited_sources, tier_zero_answers, cost_benchmark, cache_outcomes, request_costs, cost_projection, cache_breakeven, record_totals,
    record_attributes, cost_histogram, stage_histogram, token_usage, rate_ratios, slo_summary, load_schedule, load_lines, decode_rate, affordable_context, encoder_sweep, ingest_projection, stage_windows,
    posts_xml, links_xml, index_upsert, term_stats_saved, golden_saved, sparse_attached, sse_completions, pipeline_tags, dense_knn_tags, scan_limit, chunk_coverage,
    links_fingerprint, slo_budgets, embedded_documents, streamed_documents, cache_streamed, cache_exact_streamed,
)}

from marlstone.plans.oracles import ORACLE  # noqa: E402, F401
