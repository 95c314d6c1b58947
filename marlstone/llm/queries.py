"""Registered queries of the corpus operators, with their SQL."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.components import connected_components
from marlstone.llm.leakage import leaked_items
from marlstone.llm.near_duplicates import all_pairs, near_duplicate_groups, near_duplicate_pairs
from marlstone.llm.neighbours import nearest_vectors, neighbour_pairs
from marlstone.llm.spans import shared_share, shared_spans
from marlstone.llm.splitting import cut_levels, file_ranges, item_ranges, split_oversized
from marlstone.llm.tokenizing import encode_corpus
from marlstone.llm.topn import best_answers
from marlstone.runtime import shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*near_duplicate_pairs(table(spark, sf_dir, "posts"), "id", "title", "body", k=3, threshold=0.6))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "posts"), "id", "title", "body")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_answers(table(spark, sf_dir, "posts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "post_links").filter(F.col("link_type_id") == 3)
    return connected_components(links, "post_id", "related_post_id").withColumnRenamed("member", "post_id")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = item_ranges(table(spark, sf_dir, "qa_docs"), "qa_docs", "doc_id", "body")
    return bodies.unionByName(item_ranges(table(spark, sf_dir, "raw_chunks"), "raw_chunks", "raw_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_levels(_ranges(spark, sf_dir))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_ranges(spark, sf_dir))


def p4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each item amount to without their overlaps: bytes, characters and the sum of their code points; whether they tile it without gap and keep the limits."""
    own = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("overlap_bytes") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    points = F.aggregate(F.transform(F.filter(F.split("own", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    pieces = p4_pieces(spark, sf_dir).withColumn("own", own)
    item = ["item_table", "item_id", "version"]
    follows = F.col("start_byte") == F.lag("end_byte", 1, 0).over(Window.partitionBy(*item).orderBy("piece_no"))
    checked = pieces.select(*item, "start_byte", "end_byte", F.length("own").alias("n"), points.alias("points"), (follows & (F.col("n_tokens") <= 512) & (F.col("overlap_bytes") <= 153)).alias("ok"))
    found = checked.groupBy(*item).agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), F.sum("n").cast("bigint").alias("n_chars"), F.sum("points").alias("points"), F.bool_and("ok").alias("ok"))
    return found.drop("version")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of qa_docs as one large file a partition in the shared folder, cut by workers that seek: what the pieces amount to."""
    folder = f"{shared_dir(spark).removeprefix('file:')}/marlstone-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        path = f"{folder}/{TaskContext.get().partitionId()}.txt"
        with open(path, "wb") as f:
            for batch in batches:
                for text in batch["body"].to_pylist():
                    f.write(text.encode() + b"\n\n")
        yield pa.RecordBatch.from_pydict({"path": [path]})

    paths = [r["path"] for r in table(spark, sf_dir, "qa_docs").filter("body IS NOT NULL").select("body").mapInArrow(write, "path string").collect()]
    pieces = split_oversized(file_ranges(spark, sorted(paths)))
    follows = F.col("start_byte") == F.lag("end_byte", 1, 0).over(Window.partitionBy("item_id").orderBy("piece_no"))
    return pieces.withColumn("ok", follows & (F.col("n_tokens") <= 512) & (F.col("overlap_bytes") <= 153)).agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), F.bool_and("ok").alias("ok"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(table(spark, sf_dir, "cache_entries"), "seq", "embedding", dim=64), "seq")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "golden_pairs"), "query_id", "query_body")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return shared_share(documents, shared_spans(documents, "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p4_found, p4_pieces, p4_tiling, p4_files, p5_found, p7_ids, p8_found, p9_found, p9_shared)}

_SPANS = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
s AS (SELECT doc_id, n, unnest(range(n - 299)) AS i, text FROM d),
w AS (SELECT doc_id, i, md5_number_lower(substr(text, i + 1, 300)) AS h FROM s),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w WHERE h IN (SELECT h FROM r)),
g AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i - b > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
f AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS start_pos, CAST(max(i) + 300 AS INTEGER) AS end_pos FROM g GROUP BY doc_id, g)
"""

ORACLE = {
    "p1_found": r"""
WITH t AS (SELECT id, any_value(coalesce(title, '')) AS title, any_value(coalesce(body, '')) AS body FROM posts GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(title || ' ' || replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '[\p{L}\p{N}]+') AS w FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c / (x.n + y.n - c) >= 0.6""",
    "p1_groups": r"""
WITH RECURSIVE t AS (SELECT id, any_value(coalesce(title, '')) AS title, any_value(coalesce(body, '')) AS body FROM posts GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(title || ' ' || replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '[\p{L}\p{N}]+') AS w FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
l AS (SELECT id_a, id_b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c / (x.n + y.n - c) >= 0.8),
e AS (SELECT id_a AS a, id_b AS b, same FROM l UNION ALL SELECT id_b, id_a, same FROM l),
k AS (SELECT n.id, least(n.id, coalesce(min(e.b) FILTER (WHERE same), n.id)) AS rep FROM n LEFT JOIN e ON e.a = n.id GROUP BY n.id),
r AS (SELECT id, id AS seen FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT a AS id, count(DISTINCT k.rep) AS n_links FROM e JOIN k ON k.id = e.b WHERE NOT same GROUP BY a)
SELECT k.id, k.rep, g.group_id, coalesce(m.n_links, 0) AS n_links FROM k JOIN (SELECT id, min(seen) AS group_id FROM r GROUP BY id) g USING (id) LEFT JOIN m USING (id)""",
    "p2_found": """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, score DESC NULLS LAST) AS rn FROM posts) WHERE rn = 1),
r AS (SELECT q.id AS parent_id, a.id AS answer_id,
    row_number() OVER (PARTITION BY q.id ORDER BY CASE WHEN a.id = q.accepted_answer_id THEN 0 ELSE 1 END, coalesce(a.score, 0) DESC, a.id) AS rank_no
  FROM c q JOIN c a ON a.parent_id = q.id AND a.post_type_id = 2 WHERE q.post_type_id = 1)
SELECT parent_id, answer_id, CAST(rank_no AS INTEGER) AS rank_no FROM r WHERE rank_no <= 3""",
    "p3_found": """
WITH RECURSIVE e AS (SELECT DISTINCT post_id AS a, related_post_id AS b FROM post_links WHERE link_type_id = 3 AND post_id <> related_post_id),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS post_id, a AS seen FROM b UNION SELECT r.post_id, b.b FROM r JOIN b ON b.a = r.seen)
SELECT min(seen) AS group_id, post_id FROM r GROUP BY post_id""",
    "p4_found": r"""
WITH i AS (SELECT DISTINCT 'qa_docs' AS item_table, doc_id AS item_id, body AS t FROM qa_docs UNION SELECT DISTINCT 'raw_chunks', raw_id, text FROM raw_chunks),
o AS (SELECT * FROM i WHERE strlen(t) > 1536)
SELECT item_table, item_id, CASE
  WHEN list_max(list_transform(string_split_regex(t, '\n\n+'), lambda x: strlen(x))) <= 1536 THEN 'paragraph'
  WHEN list_max(list_transform(string_split_regex(t, '\n'), lambda x: strlen(x))) <= 1536 THEN 'line'
  WHEN list_max(list_transform(string_split_regex(t, '[ \t\n]+'), lambda x: strlen(x))) <= 1536 THEN 'word' ELSE 'char' END AS cut_level
FROM o""",
    "p4_tiling": """
WITH i AS (SELECT DISTINCT 'qa_docs' AS item_table, doc_id AS item_id, body AS t FROM qa_docs UNION SELECT DISTINCT 'raw_chunks', raw_id, text FROM raw_chunks)
SELECT item_table, item_id, CAST(strlen(t) AS BIGINT) AS n_bytes, length(t) AS n_chars, CAST(list_sum(list_transform(regexp_extract_all(t, '(?s).'), lambda c: unicode(c))) AS BIGINT) AS points, true AS ok FROM i WHERE strlen(t) > 1536""",
    "p4_files": "SELECT CAST(sum(strlen(body) + 2) AS BIGINT) AS n_bytes, true AS ok FROM qa_docs WHERE body IS NOT NULL",
    "p5_found": """
WITH e AS (SELECT DISTINCT seq, CAST(embedding AS DOUBLE[]) AS v FROM cache_entries WHERE len(embedding) = 64),
v AS (SELECT seq, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
p AS (SELECT a.seq AS q, b.seq AS n, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS c FROM v a JOIN v b ON a.seq <> b.seq),
r AS (SELECT q, n, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS k FROM p WHERE c >= 0.85)
SELECT DISTINCT least(q, n) AS seq_a, greatest(q, n) AS seq_b FROM r WHERE k <= 5""",
    "p8_found": r"""
WITH q AS (SELECT query_id, regexp_extract_all(lower(query_body), '[\p{L}\p{N}]+') AS w FROM golden_pairs),
s AS (SELECT DISTINCT least(len(w), 13) AS n FROM q WHERE len(w) > 0),
g AS (SELECT DISTINCT query_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM (SELECT *, least(len(w), 13) AS n FROM q WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, s WHERE len(w) >= n)
SELECT DISTINCT doc_id, query_id FROM h JOIN g USING (n, g)""",
    "p9_found": _SPANS + "SELECT * FROM f",
    "p9_shared": _SPANS + ", c AS (SELECT doc_id, CAST(sum(end_pos - start_pos) AS BIGINT) AS c FROM f GROUP BY doc_id) SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, coalesce(c, 0) AS shared_chars, round(coalesce(c, 0) / nullif(length(text), 0), 6) AS share FROM documents LEFT JOIN c USING (doc_id)",

}
