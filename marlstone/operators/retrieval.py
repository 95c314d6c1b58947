"""Sparse, dense and fused top-k retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.runtime import materialise

K1, B = 1.2, 0.75
#: Rows of the query side (query terms, or vectors) that are broadcast at once; larger query sets are searched in blocks.
QUERY_ROWS = 1 << 18
#: Scores that a worker holds at once.
_CELLS = 1 << 21


def bm25_stats(docs: DataFrame, terms: str) -> DataFrame:
    """One row: doc_count, total_len, avg_len (at least 1; 1 without documents)."""
    n = F.coalesce(F.sum(F.size(terms)), F.lit(0)).cast("bigint")
    return docs.agg(F.count(F.lit(1)).alias("doc_count"), n.alias("total_len")).withColumn("avg_len", F.coalesce(F.greatest(F.lit(1.0), F.try_divide(F.col("total_len").cast("double"), "doc_count")), F.lit(1.0)))


def document_frequencies(docs: DataFrame, terms: str) -> DataFrame:
    """(term, df): number of documents with the term."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, doc_count: Column) -> Column:
    return F.log(1 + (doc_count - df + 0.5) / (df + 0.5))


def bm25_idf(docs: DataFrame, terms: str) -> DataFrame:
    return document_frequencies(docs, terms).select("term", "df", idf(F.col("df"), docs.agg(F.count(F.lit(1))).scalar()).alias("idf"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's different terms with their number: no row leaves its place, so nothing is shuffled."""
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            batch = whole.slice(a, 1024)
            size = batch["terms"].value_lengths().fill_null(0).to_numpy().astype(np.int64)
            encoded = batch["terms"].flatten().dictionary_encode()
            code = encoded.indices.fill_null(-1).to_numpy().astype(np.int64)
            doc, code = np.repeat(np.arange(batch.num_rows), size)[code >= 0], code[code >= 0]
            pair, tf = np.unique(doc * max(1, len(encoded.dictionary)) + code, return_counts=True)
            doc, code = np.divmod(pair, max(1, len(encoded.dictionary)))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(doc)), pa.array(size[doc].astype(np.int32)), encoded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(tf)], names=["id", "len", "term", "tf"])


def bm25_vectors(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf, weight): saturated, length-normalised term frequencies of documents, one row each. The inverse document frequency is the query's part, so a grown corpus leaves them as they are but for the average length."""
    own = docs.select(F.col(key).alias("id"), F.col(terms).alias("terms"))
    tf = own.mapInArrow(_term_counts, f"id {own.dtypes[0][1]}, len int, term string, tf bigint")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / bm25_stats(docs, terms).select("avg_len").scalar()))
    return tf.select(F.col("id").alias(key), "term", "tf", weight.alias("weight"))


class _Top:
    """The k best documents of each query seen so far by one task: score (9 decimals) descending, then id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.q, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray, seen: np.ndarray | None = None, queries: np.ndarray | None = None) -> None:
        """scores: documents x queries (all, or those numbered `queries`); seen: which of them count."""
        scores = np.round(scores, 9)
        good = scores >= (self.floor if queries is None else self.floor[queries])
        if seen is not None:
            good &= seen
        d, column = np.nonzero(good)
        if not len(d):
            return
        q = column if queries is None else queries[column]
        q, doc, score = np.r_[self.q, q], np.r_[self.doc, ids[d]], np.r_[self.score, scores[d, column]]
        order = np.lexsort((doc, -score, q))
        first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep = order[rank < self.k]
        self.q, self.doc, self.score = q[keep], doc[keep], score[keep]
        full = order[rank == self.k - 1]
        self.floor[q[full]] = score[full]

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.q]), pa.array(self.doc), pa.array(self.score)], names=["query_id", "doc_id", "score"])


def _blocks(queries: DataFrame, rows: int, limit: int) -> list[DataFrame]:
    n = max(1, -(-rows // limit))
    return [queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _one_by_one(blocks: list[DataFrame], search: Callable[[DataFrame], tuple[DataFrame, Broadcast]], k: int) -> DataFrame:
    """Blocks of queries one after the other: each result is written before the next block is made, and its broadcast freed, so neither driver nor workers ever hold two."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = []
    for block in blocks:
        rows, index = search(block)
        ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))
        if len(blocks) == 1:
            return ranked
        found.append(materialise(ranked))
        index.destroy()
    return reduce(DataFrame.union, found)


def sparse_search(queries: DataFrame, docs: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, doc_id, rank, score): BM25 top k of docs (doc_id, terms) for every query (query_id, terms).

    The stated queries meet all documents in blocks of at most query_rows rows of query terms: the distinct terms of a
    block are broadcast with their inverse document frequencies, and every task scores its documents and passes on k a
    query, so the shuffle is k rows a query and task, not a row a shared term. Documents that share no term aren't found;
    queries without terms find nothing. docs are read three times: give a materialised table where terms are expensive."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    stats = bm25_stats(docs, "terms").first()
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "terms")

    def search(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        vocabulary = part.select("term").distinct()
        df = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count()
        pairs = part.toArrow()
        counts = dict(df.toArrow().to_pandas().itertuples(index=False, name=None)) if pairs.num_rows else {}
        query_ids, q = np.unique(pairs["query_id"].to_numpy(), return_inverse=True)
        vocabulary, t = np.unique(pairs["term"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        d = np.array([counts.get(x, 0) for x in vocabulary.tolist()], float)
        weight = np.log(1 + (stats["doc_count"] - d + 0.5) / (d + 0.5))
        order = np.argsort(t, kind="stable")
        begin = np.searchsorted(t[order], np.arange(len(vocabulary) + 1))
        index = docs.sparkSession.sparkContext.broadcast((query_ids, {x: i for i, x in enumerate(vocabulary.tolist())}, weight, q[order], begin))
        return keyed.mapInArrow(_sparse_task(index, k, float(stats["avg_len"])), "query_id bigint, doc_id bigint, score double"), index

    return _one_by_one(_blocks(wanted, wanted.count(), query_rows), search, k)


def query_vector(queries: DataFrame, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, term, weight): the distinct terms of queries (query_id, terms) with their inverse document frequency by (term, df) and (doc_count); unseen terms have df 0."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    known = wanted.join(frequencies.select("term", "df"), "term", "left")
    return known.select("query_id", "term", idf(F.coalesce("df", F.lit(0)), stats.select("doc_count").scalar()).alias("weight"))


def _sparse_task(index, k: int, avg_len: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, number, weight, queries, begin = index.value
        top = _Top(len(query_ids), k)
        step = max(1, _CELLS // max(1, len(query_ids)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                lists = batch["terms"]
                size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                encoded = lists.flatten().dictionary_encode()
                known = np.array([number.get(x, -1) for x in encoded.dictionary.to_pylist()], np.int64)
                if not len(known):
                    continue
                term = known[encoded.indices.to_numpy()]
                doc = np.repeat(np.arange(batch.num_rows), size)
                ok = term >= 0
                pair, tf = np.unique(doc[ok] * len(weight) + term[ok], return_counts=True)
                doc, term = pair // len(weight), pair % len(weight)
                w = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / avg_len))
                n = begin[term + 1] - begin[term]
                total = np.cumsum(n)
                if not len(total):
                    continue
                q = queries[np.repeat(begin[term] - (total - n), n) + np.arange(int(total[-1]))]
                cell = np.repeat(doc, n) * len(query_ids) + q
                scores = np.bincount(cell, np.repeat(w, n), batch.num_rows * len(query_ids)).reshape(batch.num_rows, -1)
                top.add(scores, batch["doc_id"].to_numpy(), scores > 0)
        yield top.rows(query_ids)

    return run


def dense_search(queries: DataFrame, docs: DataFrame, k: int, dim: int, same: list[str] | None = None, any_of: str | None = None, before: str | None = None, exclude_own: bool = False, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, doc_id, rank, score): cosine top k of docs (doc_id, vec) for every query (query_id, vec), exactly.

    Filters are part of the search, so k documents that pass them are found. `same` names columns of both sides that must
    be equal (a tenant): queries and documents meet by their values, and only those of one value are scored. `any_of`
    names an array of both sides, of which a document must have one of the query's; a null or empty one of a query
    filters nothing. `before` names a number of both sides that must be less for the document. exclude_own: a query
    doesn't find its own id, for queries that are documents themselves. Nulls in `same` match nothing, nor do nulls in
    `before`. Queries go out in blocks as in sparse_search. Zero vectors have cosine 0; vectors that are null or of
    another length are left out."""
    same = same or []
    more = [*same, *([any_of] if any_of else []), *([before] if before else [])]
    fits = F.size("vec") == dim
    queries, docs = queries.filter(fits), docs.filter(fits).select(F.col("doc_id").cast("bigint").alias("doc_id"), "vec", *more)

    def search(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        t = part.select("query_id", "vec", *more).toArrow()
        groups: dict[tuple, list[int]] = {}
        for i, value in enumerate(zip(*(t[c].to_pylist() for c in same), strict=True) if same else [()] * t.num_rows):
            if None not in value:
                groups.setdefault(value, []).append(i)
        wanted = [set(x or ()) for x in t[any_of].to_pylist()] if any_of else None
        limit = t[before].to_numpy(zero_copy_only=False) if before else None
        index = docs.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), _unit(t["vec"], dim), {v: np.array(i) for v, i in groups.items()}, wanted, limit))
        return docs.mapInArrow(_dense_task(index, k, dim, same, any_of, before, exclude_own), "query_id bigint, doc_id bigint, score double"), index

    return _one_by_one(_blocks(queries, queries.count(), max(1, query_rows // dim)), search, k)


def _unit(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _by_value(batch: pa.RecordBatch, same: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of each different value of some columns, by dictionary codes."""
    if not same:
        yield (), np.arange(batch.num_rows)
        return
    encoded = [batch[c].dictionary_encode() for c in same]
    code = np.zeros(batch.num_rows, np.int64)
    for e in encoded:
        code = code * (len(e.dictionary) + 1) + e.indices.fill_null(len(e.dictionary)).to_numpy()
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        value = tuple(batch[c][int(rows[0])].as_py() for c in same) if len(rows) else (None,)
        if None not in value:
            yield value, rows


def _dense_task(index, k: int, dim: int, same: list[str], any_of: str | None, before: str | None, exclude_own: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, groups, wanted, limit = index.value
        top = _Top(len(query_ids), k)
        for whole in batches:
            for value, rows in _by_value(whole, same):
                q = groups.get(value)
                if q is None:
                    continue
                step = max(1, _CELLS // len(q))
                for a in range(0, len(rows), step):
                    batch = whole.take(pa.array(rows[a : a + step]))
                    ids = batch["doc_id"].to_numpy()
                    allowed = np.ones((len(ids), len(q)), bool)
                    if exclude_own:
                        allowed &= ids[:, None] != query_ids[q][None, :]
                    if before:
                        allowed &= batch[before].to_numpy(zero_copy_only=False).astype(float)[:, None] < limit[q].astype(float)[None, :]
                    if any_of:
                        allowed &= _overlaps(batch[any_of].to_pylist(), [wanted[i] for i in q])
                    top.add(_unit(batch["vec"], dim) @ vectors[q].T, ids, allowed, q)
        yield top.rows(query_ids)

    return run


def _overlaps(tags: list, wanted: list[set]) -> np.ndarray:
    """Documents x queries: has one of the wanted, or none is wanted. Counted by one product of membership tables."""
    number = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    has, asks = np.zeros((len(tags), len(number)), np.float32), np.zeros((len(wanted), len(number)), np.float32)
    for table, rows in ((has, tags), (asks, wanted)):
        for i, row in enumerate(rows):
            table[i, [number[t] for t in row or () if t in number]] = 1
    return (has @ asks.T > 0) | np.array([not w for w in wanted])[None, :]


def rrf_fuse(lists: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score, retrievers) from ranked lists (query_id, doc_id, rank, retriever): reciprocal-rank fusion, ties to the smaller id; retrievers are those that really found the document."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("retrievers"))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(best))
    return (ranked.filter(F.col("rank") <= limit) if limit else ranked).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "retrievers")


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fused top k of a dense and a sparse result of at least max(k, 50) each."""
    both = dense.withColumn("retriever", F.lit("dense")).unionByName(sparse.withColumn("retriever", F.lit("sparse")))
    return rrf_fuse(both.select("query_id", "doc_id", "rank", "retriever"), rrf_k, k)


def dedupe_by_document(ranked: DataFrame, limit: int) -> DataFrame:
    """Of (query_id, chunk_id, doc_id, rank) each document's first chunk, ranked anew, at most `limit` a query."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("rank", "chunk_id")
    again = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    kept = ranked.withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")
    return kept.withColumn("doc_rank", F.row_number().over(again)).filter(F.col("doc_rank") <= limit).select("query_id", "doc_id", "chunk_id", "doc_rank")


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, number, doc_id): the sources (query_id, rank, doc_id) that each answer (query_id, answer) cites as [n]; numbers without a source, and repeats, give nothing."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    cited = answers.select("query_id", F.explode(numbers).alias("rank"))
    return cited.join(sources.select("query_id", "rank", "doc_id"), ["query_id", "rank"]).select("query_id", F.col("rank").alias("number"), "doc_id")


#: What a degraded answer, and one that needs no model, begin with.
UNAVAILABLE, TRIVIAL = "No answer could be generated. These documents look most relevant:\n\n", "Please ask a question."


def degraded_answers(ranked: DataFrame, n: int = 3, length: int = 300, intro: str = UNAVAILABLE) -> DataFrame:
    """(query_id, answer, doc_ids, tier, usd, degraded): what is given when no model can be asked.

    Of (query_id, chunk_id, doc_id, rank, text, source_uri) the excerpts of the best n documents, numbered, each under
    its source; it belongs to tier 0, costs nothing and is marked."""
    best = dedupe_by_document(ranked.select("query_id", "chunk_id", "doc_id", "rank"), n).join(ranked.select("query_id", "chunk_id", "text", "source_uri"), ["query_id", "chunk_id"])
    entry = F.concat(F.lit("["), F.col("doc_rank").cast("string"), F.lit("] "), F.coalesce("source_uri", F.lit("")), F.lit("\n"), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, length), r"(?U)\A\s+|\s+\z", ""), F.lit("\n\n"))
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_rank", entry.alias("t"), "doc_id"))).alias("l"))
    text = F.concat(F.lit(intro), F.array_join(F.transform("l", lambda x: x["t"]), ""))
    return listed.select("query_id", text.alias("answer"), F.transform("l", lambda x: x["doc_id"]).alias("doc_ids"), F.lit(0).alias("tier"), F.lit(0.0).alias("usd"), F.lit(True).alias("degraded"))


def answers_without_model(routed: DataFrame, answer: str = TRIVIAL) -> DataFrame:
    """(query_id, tier, answer, usd): queries (query_id, tier, model) that go to no model get a constant answer at no cost; others get null for both."""
    none = F.col("model").isNull()
    return routed.select("query_id", "tier", F.when(none, F.lit(answer)).alias("answer"), F.when(none, F.lit(0.0)).alias("usd"))


def distinct_documents(ranked: DataFrame) -> DataFrame:
    """(queries, p50, least): how many different documents a query's chunks (query_id, doc_id) belong to: the element at half of the sorted counts, and the fewest."""
    counts = ranked.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    # one row a distinct count, so the running sum is over a handful of rows
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("n"))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    return sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("queries"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("p50"), F.min("n").alias("least"))
