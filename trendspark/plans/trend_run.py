"""The whole run: landed files to trends, topics and a vector table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.config import Settings, safe_input_tokens
from trendspark.functions.text import compose_text
from trendspark.functions.wordlists import stopwords
from trendspark.operators import topics
from trendspark.operators.clustering import cluster_topics
from trendspark.operators.dedup import dedup_first, valid_ids
from trendspark.operators.embedding import embed_text, embed_with_model, train_idf
from trendspark.operators.search import build_vector_table, write_encoder
from trendspark.operators.summary import summarize, summarize_with_model
from trendspark.operators.translation import ModelLoader, normalize_language
from trendspark.operators.trends import order_trends, summary_input, top_posts, top_titles, trend_rows
from trendspark.schemas import COMBINED
from trendspark.session import materialize
from trendspark.sources import sinks


@dataclass(frozen=True)
class Models:
    """Optional model hooks; each falls back to the built-in operator."""

    translate: ModelLoader | None = None
    embed: Callable | None = None
    summarize: Callable | None = None


@dataclass(frozen=True)
class TrendRun:
    """Tables of a finished run."""

    posts: DataFrame
    topics: DataFrame
    trends: DataFrame


def prepare_posts(
    combined: DataFrame,
    profile: DataFrame,
    lexicon: DataFrame | None = None,
    models: Models = Models(),
    settings: Settings = Settings(),
) -> DataFrame:
    """Filtered, deduplicated and language-normalised posts with their embedding text.

    Ids are deduplicated before the categories are filtered: if the first row of an id is of
    another category, the id drops out. Both run before the costly steps.
    """
    absent = {f.name: F.lit(None).cast(f.dataType) for f in COMBINED.fields if f.name not in combined.columns}
    whole = combined.withColumns(absent) if absent else combined
    unique = dedup_first(valid_ids(whole)).filter(F.col("category").isin(list(settings.categories)))
    english = normalize_language(
        unique,
        profile,
        lexicon,
        models.translate,
        chars=settings.language_chars,
        parity=settings.parity,
        size=settings.chunk_tokens,
        overlap=settings.chunk_overlap,
    )
    return english.withColumn("text_for_embedding", compose_text())


def embed_posts(posts: DataFrame, models: Models = Models(), settings: Settings = Settings()) -> DataFrame:
    if models.embed is not None:
        return embed_with_model(posts, models.embed)
    return embed_text(posts, train_idf(posts), dim=settings.embedding_dim)


def summary_limit(models: Models = Models(), settings: Settings = Settings()) -> int:
    """Tokens of a summary's input: the setting, within the limit of a named summary model."""
    most = settings.summary_input_tokens
    if models.summarize is None or not settings.summary_model:
        return most
    return min(most, safe_input_tokens(settings.summary_model, most))


def find_trends(
    embedded: DataFrame,
    method: str = "topic",
    models: Models = Models(),
    settings: Settings = Settings(),
) -> TrendRun:
    """Topics and trends of embedded posts, all categories in one plan."""
    stop = stopwords(settings.parity)
    labels = cluster_topics(
        embedded.select("category", "id", F.col("embedding").alias("vector")),
        method,
        settings.categories,
        settings.min_cluster_size,
        settings.min_samples,
        settings.reduced_dims,
    )
    posts = materialize(topics.attach_topics(embedded, labels, ("category", "id")))
    weights = materialize(
        topics.ctfidf(
            posts,
            ngrams=settings.ngram_range,
            vocabulary_size=settings.vocabulary_size,
            stop=stop,
            weighting="tfidf" if settings.parity else "counts",
        )
    )
    keywords = topics.topic_keywords(weights, settings.keywords_per_topic)
    known = posts.select("category", "topic").distinct()
    named = topics.enrich_topics(known, keywords, topics.topic_titles(keywords))
    top = top_posts(posts, settings.top_k_titles)
    inputs = summary_input(top, summary_limit(models, settings))
    if models.summarize is not None:
        summaries = summarize_with_model(inputs, models.summarize)
    else:
        summaries = summarize(
            inputs, weights, settings.summary_max_length, settings.summary_min_length, settings.ngram_range, stop,
            None if settings.parity else settings.summary_overlap,
        )
    trends = order_trends(trend_rows(named, posts, top_titles(top), summaries))
    return TrendRun(posts, named, trends)


def run(
    combined: DataFrame,
    profile: DataFrame,
    out: str,
    lexicon: DataFrame | None = None,
    method: str = "topic",
    models: Models = Models(),
    settings: Settings = Settings(),
) -> TrendRun:
    """All stages, their tables written under ``out``."""
    spark = combined.sparkSession
    prepared = materialize(prepare_posts(combined, profile, lexicon, models, settings))
    sinks.write_jsonl(prepared, f"{out}/posts_en")
    if models.embed is None:
        # Stored beside the vectors, so that later query texts get into the same space.
        idf = materialize(train_idf(prepared))
        write_encoder(idf, f"{out}/vectors")
        vectors = embed_text(prepared, idf, dim=settings.embedding_dim)
    else:
        vectors = embed_posts(prepared, models, settings)
    sinks.write_embeddings(vectors, f"{out}/embedded")
    embedded = spark.read.parquet(f"{out}/embedded")
    found = find_trends(embedded, method, models, settings)
    sinks.write_topics(found.topics, f"{out}/topics")
    sinks.write_topics(topics.topic_members(found.posts), f"{out}/members")
    sinks.write_trend_lines(found.trends, f"{out}/trends")
    build_vector_table(
        found.posts.select("category", "id", "topic", "title_en", F.col("embedding").alias("vector")),
        f"{out}/vectors",
    )
    return found
