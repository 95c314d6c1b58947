"""Registered queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators.orphans import orphan_references, orphan_report
from marlstone.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "posts"), table(spark, sf_dir, "post_links"), table(spark, sf_dir, "removed_posts"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p6_found(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_P6 = """
WITH d AS (SELECT id, min(ingested_at) AS first_at, max(ingested_at) AS last_at, max(parent_id) AS parent_id, max(accepted_answer_id) AS accepted_answer_id FROM posts GROUP BY id),
l AS (SELECT id, min(ingested_at) AS first_at, max(related_post_id) AS target FROM post_links GROUP BY id),
r AS (
  SELECT 'posts' AS ref_table, 'parent_id' AS ref_field, id AS ref_id, first_at, parent_id AS target FROM d WHERE parent_id IS NOT NULL
  UNION ALL SELECT 'posts', 'accepted_answer_id', id, first_at, accepted_answer_id FROM d WHERE accepted_answer_id IS NOT NULL
  UNION ALL SELECT 'post_links', 'related_post_id', id, first_at, target FROM l WHERE target IS NOT NULL),
n AS (SELECT post_id, max(removed_at) AS removed_at FROM removed_posts GROUP BY post_id),
k AS (
  SELECT r.ref_table, r.ref_field, r.ref_id, strftime(r.first_at, '%Y-%m') AS ref_month,
    CASE WHEN n.removed_at IS NOT NULL AND (t.last_at IS NULL OR t.last_at <= n.removed_at) THEN 'deleted'
         WHEN t.id IS NULL THEN 'missing' WHEN t.first_at > r.first_at THEN 'late' END AS orphan_kind
  FROM r LEFT JOIN d t ON t.id = r.target LEFT JOIN n ON n.post_id = r.target)
"""

ORACLE = {
    "p6_found": _P6 + "SELECT * FROM k WHERE orphan_kind IS NOT NULL",
    "p6_report": _P6 + "SELECT ref_table, ref_field, ref_month, orphan_kind, count(*) AS n_orphans FROM k WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
