"""Queries of the trend dashboard: filter, search, rank and card texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.text import blank, bound, word_set
from trendspark.operators.topics import NOISE
from trendspark.session import materialize, with_position

# Texts of a card.
NO_TITLE = "(No title)"
HOT_BADGE = "🔥 "


def filter_trends(
    trends: DataFrame, category: str = "All", known: Sequence[str] = ("nba", "soccer")
) -> DataFrame:
    """Real topics of one category, or of all known ones."""
    wanted = F.col("category").isin(list(known)) if category == "All" else F.col("category") == category
    return trends.filter((F.col("cluster_id") != NOISE) & wanted)


def search_trends(trends: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of the summary or of a title; a blank query keeps all."""
    if not query.strip():
        return trends
    needle = F.lit(query.lower())
    in_title = F.exists("top_titles", lambda title: F.contains(F.lower(title), needle))
    return trends.filter(F.contains(F.lower("summary"), needle) | in_title)


def filter_by_keyword(trends: DataFrame, keyword: str) -> DataFrame:
    return trends.filter(F.array_contains("keywords", keyword)) if keyword else trends


def keyword_facet(trends: DataFrame) -> DataFrame:
    return trends.select(F.explode("keywords").alias("keyword")).distinct().orderBy("keyword")


def hot_trends(trends: DataFrame, parity: bool = False) -> DataFrame:
    """Trends by size with ``is_hot`` for the first ``max(3, n // 10)``.

    ``parity`` marks by bare cluster id, so an equal id in another category is marked too.
    """
    sized = trends.withColumn("_smaller", -F.col("total_posts"))
    placed = materialize(
        with_position(sized, ["_smaller", "category", "cluster_id"], name="place").drop("_smaller")
    )
    hot = F.col("place") < max(3, placed.count() // 10)
    if parity:
        ids = placed.filter(hot).select("cluster_id").distinct().withColumn("_hot", F.lit(True))
        marked = placed.join(ids, "cluster_id", "left").withColumn(
            "is_hot", F.coalesce("_hot", F.lit(False))
        )
    else:
        marked = placed.withColumn("is_hot", hot)
    return marked.orderBy("place").select(*trends.columns, "is_hot")


def recent_trends(trends: DataFrame) -> DataFrame:
    """Trends by last date, undated last; none is marked hot."""
    return trends.orderBy(
        F.col("end_date").desc_nulls_last(), F.col("total_posts").desc(), "category", "cluster_id"
    ).withColumn("is_hot", F.lit(False))


def best_title(summary: Column, titles: Column) -> Column:
    """Title sharing most words with the summary; the first one wins ties."""

    def scored(known: Column) -> Column:
        return F.transform(
            titles,
            lambda title, i: F.struct(
                F.size(F.array_intersect(known, word_set(title))).alias("shared"),
                (-i).alias("order"),
                title.alias("title"),
            ),
        )

    best = F.array_max(bound(word_set(blank(summary)), scored))
    return F.coalesce(best["title"], F.lit(NO_TITLE))


def trend_cards(trends: DataFrame) -> DataFrame:
    """Header, category, keyword line, summary and remaining titles of each trend."""
    dated = (blank(F.col("start_date")) != "") & (blank(F.col("end_date")) != "")
    dates = F.when(
        dated, F.concat(F.lit("["), "start_date", F.lit(" – "), "end_date", F.lit("]"))
    ).otherwise("")
    shown = trends.withColumn("display_title", best_title(F.col("summary"), F.col("top_titles")))
    return shown.select(
        "category",
        "cluster_id",
        "is_hot",
        "display_title",
        F.concat(
            F.when(F.col("is_hot"), HOT_BADGE).otherwise(""),
            "display_title",
            F.lit(" ("),
            F.col("total_posts").cast("string"),
            F.lit(" posts) "),
            dates,
        ).alias("header"),
        F.concat(
            F.upper(F.substring("category", 1, 1)), F.lower(F.expr("substring(category, 2)"))
        ).alias("category_label"),
        F.array_join("keywords", " | ").alias("keyword_line"),
        "summary",
        F.filter("top_titles", lambda t: t != F.col("display_title")).alias("other_titles"),
    )
