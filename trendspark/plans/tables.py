"""The given tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import spread



# Text-heavy tables, which are worth spreading over all cores when they are one small file.
TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def document_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts: language as category, source as topic (the last one as noise).

    Labelled documents are forum posts with a score; the others are articles dated
    by a feed date; Spanish labelled ones have a source of neither kind.
    """
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    seconds = (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double")
    article = F.col("labelled").isNull()
    # Rendered in UTC whatever the session time zone.
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    feed_date = F.date_format(utc, "'Mon, 'd MMM yyyy HH:mm:ss' GMT'")
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ingest_seq"),
        F.col("doc_id").cast("string").alias("id"),
        F.when(article, "espn").when(F.col("lang") == "es", "other").otherwise("reddit").alias("source"),
        F.col("lang").alias("category"),
        F.when(F.col("source") == "src19", -1)
        .otherwise(F.substring("source", 4, 10).cast("int"))
        .alias("topic"),
        title.alias("title"),
        F.when(~article, title).alias("title_en"),
        F.when(~article, F.col("text")).alias("selftext_en"),
        F.when(article, title).alias("summary_en"),
        F.col("text").alias("text_en"),
        F.col("quality").cast("bigint").alias("score"),
        F.col("n_chars").alias("num_comments"),
        F.when(~article, seconds).alias("created_utc"),
        F.when(article, feed_date).alias("published"),
    )


def threads(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as posts: every turn is a title, the next turn its body."""
    turns = table(spark, folder, "conversations")
    opening = turns.select("conv_id", "turn", F.col("text").alias("title"))
    answer = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    return opening.join(answer, ["conv_id", "turn"], "left")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.lit("all").alias("category"),
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("topic"),
    )


