"""Corpus statistics, document assembly and index composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import has_code, html_to_text, parse_tags


def scan_stats(posts: DataFrame) -> DataFrame:
    """One row about posts: rows, questions, answers, others, accepted, with code, bytes of bodies, distinct tags."""
    body = F.col("body")
    flat = posts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("post_type_id") == 1).alias("questions"),
        F.count_if(F.col("post_type_id") == 2).alias("answers"),
        F.count_if(~F.coalesce(F.col("post_type_id").isin(1, 2), F.lit(False))).alias("others"),
        F.count_if(F.col("accepted_answer_id").isNotNull()).alias("accepted"),
        F.count_if(F.contains(body, F.lit("<code"))).alias("with_code"),
        F.sum(F.octet_length(body)).alias("body_bytes"),
    )
    # the few columns are read a second time, for the tags alone
    tags = posts.select(F.explode(parse_tags(F.col("tags"))).alias("tag")).agg(F.countDistinct("tag").alias("distinct_tags"))
    return flat.withColumn("distinct_tags", tags.scalar())


def tag_histogram(posts: DataFrame, n: int | None = None) -> DataFrame:
    """(tag, n) by count, then tag; all, or the first n."""
    counts = posts.select(F.explode(parse_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), "tag").limit(n)


def top_answers(posts: DataFrame, n: int = 3) -> DataFrame:
    """(parent_id, answer_id, body, i): each question's n best answers by score, then id."""
    w = Window.partitionBy("parent_id").orderBy(F.coalesce("score", F.lit(0)).desc(), "id")
    answers = posts.filter("post_type_id = 2 AND parent_id IS NOT NULL").select("parent_id", "id", "score", "body")
    return answers.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n).select("parent_id", F.col("id").alias("answer_id"), "body", "i")


def assemble_documents(posts: DataFrame, source: str = "qa://posts/q/", n: int = 3) -> DataFrame:
    """Documents of questions: cleaned body, cleaned best answers in order, tags, date, source. Questions without answers stay."""
    answers = top_answers(posts, n).select("parent_id", F.struct("i", html_to_text(F.col("body")).alias("text")).alias("a"))
    lists = answers.groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["text"]).alias("answers"))
    questions = posts.filter("post_type_id = 1")
    return questions.join(lists, "id", "left").select(
        F.col("id").alias("doc_id"), "title", parse_tags(F.col("tags")).alias("tags"), html_to_text(F.col("body")).alias("body"),
        F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "score", F.substring("creation_date", 1, 10).alias("effective_date"), F.concat(F.lit(source), F.col("id").cast("string")).alias("source_uri"),
    )


def index_composition(questions: DataFrame, gold: DataFrame, n_total: int) -> DataFrame:
    """(id, role): all gold documents that exist, then the oldest others, up to n_total rows in all."""
    is_gold = questions.join(gold.select(F.col("gold_doc_id").alias("id")).distinct(), "id", "left_semi").select("id", F.lit("gold").alias("role"))
    others = questions.join(gold.select(F.col("gold_doc_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("distractor").alias("role"))
    return is_gold.unionByName(others.orderBy("id").limit(max(0, n_total - is_gold.count())))


def code_share(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(has_code(F.col(text))).alias("with_code"))


#: Bytes of a stored vector's component, and of a graph's edges a vector.
FLOAT_BYTES, GRAPH_BYTES = 4, 128


def chunk_stats(chunks: DataFrame, limit: int = 512, small: int = 50, dim: int = 384) -> DataFrame:
    """One row about chunks (doc_id, element_type, token_count): documents, chunks, tokens and chunks a document by percentile (the sorted values at floor((n - 1) * q)), over and under size, code, with percentages, and the bytes of an index of them.

    Percentiles come from counts of values, so nothing is sorted but a few hundred rows."""
    per_doc = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("element_type") == "code").alias("code"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("most"),
        F.count_if(F.col("token_count") > limit).alias("over"), F.count_if(F.col("token_count") < small).alias("under"),
    )
    total = per_doc.agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.max("n").alias("most_per_doc"), F.coalesce(F.sum("code"), F.lit(0)).alias("n_code"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.max("most").alias("most_tokens"), F.coalesce(F.sum("over"), F.lit(0)).alias("n_over"), F.coalesce(F.sum("under"), F.lit(0)).alias("n_under"),
    )
    percent = {f"pct_{c}": F.round(100.0 * F.col(f"n_{c}") / F.greatest(F.col("n_chunks"), F.lit(1)), 3) for c in ("code", "over", "under")}
    sizes = {"float_bytes": F.col("n_chunks") * dim * FLOAT_BYTES, "byte_bytes": F.col("n_chunks") * dim, "graph_bytes": F.col("n_chunks") * GRAPH_BYTES, "resident_bytes": F.col("n_chunks") * (dim + GRAPH_BYTES)}
    ranks = {"_t": _percentiles(chunks, "token_count", "tokens").scalar(), "_d": _percentiles(per_doc, "n", "per_doc").scalar()}
    return total.withColumns(percent | sizes | ranks).select("*", "_t.*", "_d.*").drop("_t", "_d")


def _percentiles(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row of a struct (p50_name, p95_name, p99_name): null without values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.orderBy(value))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    return ranked.agg(F.struct(*[F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), F.col(value))).alias(f"p{round(q * 100):d}_{name}") for q in (0.5, 0.95, 0.99)]).alias("p"))
