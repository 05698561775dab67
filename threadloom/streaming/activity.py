"""Daily comment counts (T5) kept up to date from arriving corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import parse_timestamp
from ..sources.discussions import LINE


def comment_stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """Comments of new one-video-per-line files; a comment seen again within the watermark is dropped."""
    lines = spark.readStream.schema(LINE).json(folder)
    rows = lines.select("video_id", F.explode("comments").alias("c")).select("video_id", F.col("c.youtube_comment_id").alias("comment_id"), parse_timestamp("c.date").alias("date"))
    return rows.withWatermark("date", late).dropDuplicatesWithinWatermark(["comment_id"])


def daily_counts(comments: DataFrame) -> DataFrame:
    """Comments per day; a day is final once the watermark has passed it."""
    return comments.groupBy(F.window("date", "1 day").alias("w")).agg(F.count("*").alias("comments")).select(F.to_date("w.start").alias("day"), "comments")
