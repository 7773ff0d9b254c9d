"""Trend rows: one per topic, with size, dates, titles, keywords and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions.dates import event_time, utc_date
from trendspark.functions.text import compose_text, popularity, shown_title, truncate_tokens
from trendspark.operators.topics import TOPIC
from trendspark.session import top_per_group


def top_posts(posts: DataFrame, k: int = 5, seq: str = "ingest_seq") -> DataFrame:
    """Most popular posts per topic, ties in row order."""
    ranked = posts.withColumn("popularity", popularity(F.col("score"), F.col("num_comments")))
    return top_per_group(ranked, TOPIC, [F.col("popularity").desc(), F.col(seq)], k)


def _in_rank_order(top: DataFrame, value: str, out: str) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", value)))
    return (
        top.groupBy(*TOPIC)
        .agg(ranked.alias("ranked"))
        .select(*TOPIC, F.transform("ranked", lambda r: r[value]).alias(out))
    )


def top_titles(top: DataFrame) -> DataFrame:
    """Titles of the top posts; empty ones leave a shorter list."""
    titled = top.withColumn("_title", shown_title(F.col("title_en"), F.col("title")))
    return _in_rank_order(titled.filter(F.col("_title").isNotNull()), "_title", "top_titles")


def summary_input(top: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """Texts of the top posts, most popular first, cut to the summary model's input."""
    texts = top.withColumn("_text", compose_text()).filter(F.col("_text") != "")
    joined = _in_rank_order(texts, "_text", "texts")
    return joined.select(
        *TOPIC, truncate_tokens(F.array_join("texts", "\n\n"), max_tokens).alias("summary_input")
    )


def trend_dates(posts: DataFrame) -> DataFrame:
    time = event_time(F.col("created_utc"), F.col("published"))
    return (
        posts.select(*TOPIC, time.alias("_time"))
        .groupBy(*TOPIC)
        .agg(
            F.count(F.lit(1)).alias("total_posts"),
            F.min("_time").alias("first"),
            F.max("_time").alias("last"),
        )
        .select(
            *TOPIC,
            "total_posts",
            utc_date(F.col("first")).alias("start_date"),
            utc_date(F.col("last")).alias("end_date"),
        )
    )


def trend_rows(
    topics: DataFrame, posts: DataFrame, titles: DataFrame, summaries: DataFrame
) -> DataFrame:
    """Trend table of all topics, noise included; topics without posts count 0."""
    none = F.array().cast("array<string>")
    return (
        topics.select(*TOPIC, "keywords")
        .join(trend_dates(posts), TOPIC, "left")
        .join(titles, TOPIC, "left")
        .join(summaries.select(*TOPIC, "summary"), TOPIC, "left")
        .select(
            F.col("topic").cast("int").alias("cluster_id"),
            F.coalesce("total_posts", F.lit(0)).cast("bigint").alias("total_posts"),
            "category",
            F.coalesce("keywords", none).alias("keywords"),
            F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary"),
            F.coalesce("top_titles", none).alias("top_titles"),
            "start_date",
            "end_date",
        )
    )


# Fixed value: summary of a topic without text.
NO_SUMMARY = "[No summary: not enough content]"


def order_trends(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.col("total_posts").desc(), "category", "cluster_id")
