"""Posts and links in their XML form: one <row .../> element per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = "_Id bigint, _PostTypeId string, _ParentId string, _AcceptedAnswerId string, _Score string, _Title string, _Body string, _Tags string, _CreationDate string, _ContentLicense string"
LINKS = "_Id bigint, _PostId bigint, _RelatedPostId bigint, _LinkTypeId int"


def _number(column: str, kind: str):
    return F.col(column).try_cast(kind)


def posts_from(rows: DataFrame) -> DataFrame:
    """Posts of raw rows: a row without a usable id is dropped, kind and score that are no number are 0, other fields that are absent or no number are null."""
    return rows.filter(F.col("_Id").isNotNull()).select(
        F.col("_Id").alias("id"), F.coalesce(_number("_PostTypeId", "tinyint"), F.lit(0).cast("tinyint")).alias("post_type_id"), _number("_ParentId", "bigint").alias("parent_id"),
        _number("_AcceptedAnswerId", "bigint").alias("accepted_answer_id"), F.coalesce(_number("_Score", "bigint"), F.lit(0).cast("bigint")).alias("score"), F.col("_Title").alias("title"),
        F.coalesce("_Body", F.lit("")).alias("body"), F.col("_Tags").alias("tags"), F.col("_CreationDate").alias("creation_date"), F.col("_ContentLicense").alias("content_license"),
    )


def read_posts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The file is split by byte ranges, so one large file is read by many tasks. `limit`: only so many rows, whichever come first."""
    posts = posts_from(spark.read.format("xml").option("rowTag", "row").schema(POSTS).load(path))
    return posts if limit is None else posts.limit(limit)


def stream_posts(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Posts of the files that arrive in a folder."""
    return posts_from(spark.readStream.format("xml").option("rowTag", "row").option("maxFilesPerTrigger", files_per_trigger).schema(POSTS).load(path))


def read_duplicate_links(spark: SparkSession, path: str) -> DataFrame:
    """(id, post_id, related_post_id) of type 3 with two different ends."""
    rows = spark.read.format("xml").option("rowTag", "row").schema(LINKS).load(path)
    kept = rows.filter("_LinkTypeId = 3 AND _PostId <> _RelatedPostId")
    return kept.select(F.col("_Id").alias("id"), F.col("_PostId").alias("post_id"), F.col("_RelatedPostId").alias("related_post_id"))
