"""One query per operator over the given tables, read whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.config import Settings
from trendspark.functions import text as tx
from trendspark.functions.dates import event_time, parse_published, utc_date
from trendspark.functions.wordlists import stopwords
from trendspark.operators import (
    clustering,
    codes,
    dashboard,
    dedup,
    density,
    embedding,
    knn,
    language,
    reduce,
    search,
    spanning,
    summary,
    topics,
    translation,
    trends,
    validation,
)
from trendspark.plans import trend_run
from trendspark.plans.tables import document_posts, table, threads, vectors
from trendspark.session import materialize, shared_folder
from trendspark.sources import landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(values: Column | str) -> Column:
    """Arrays compare as text, whatever the engine returns them as."""
    return F.array_join(values, "|")


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(value, digits) + F.lit(0.0)


# ---- scalar text functions and predicates


@query
def clean_text(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("row_id"), F.lit(0).alias("turn"), "text"
    )
    turns = table(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("row_id"), "turn", "text"
    )
    rows = documents.unionByName(turns)
    return rows.select("kind", "row_id", "turn", tx.clean_text(F.col("text")).alias("cleaned"))


@query
def unified_text(spark, folder):
    return threads(spark, folder).select(
        "conv_id", "turn", tx.unified_text(F.col("title"), F.col("body")).alias("text")
    )


@query
def compose_text(spark, folder):
    return document_posts(spark, folder).select("id", tx.compose_text().alias("composed"))


PAGE_GROUPS = {"en": "english", "fr": "french"}
PAGE_KEYWORDS = {"english": ("blog", "thth"), "german": ("nicht", "für"), "query": ("utm_", "page=")}


@query
def infer_category(spark, folder):
    """Rules over web pages: language folder as group, address as title, page as text."""
    group = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    category = tx.infer_category(group, F.col("url"), F.col("html"), PAGE_GROUPS, PAGE_KEYWORDS)
    return table(spark, folder, "pages").select("page_id", category.alias("category"))


@query
def valid_ids(spark, folder):
    """Whole texts as ids."""
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("id"))
    return dedup.valid_ids(documents).select("doc_id", "id")


@query
def supported_language(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", tx.supported_language(F.col("lang")).alias("detected_language")
    )


@query
def word_set(spark, folder):
    distinct = F.array_sort(tx.word_set(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", joined(distinct).alias("words"))


@query
def popularity(spark, folder):
    value = tx.popularity(F.col("score"), F.col("num_comments"))
    return document_posts(spark, folder).select("id", value.alias("popularity"))


@query
def event_time_of_posts(spark, folder):
    posts = document_posts(spark, folder)
    return posts.select("id", event_time(F.col("created_utc"), F.col("published")).alias("seconds"))


@query
def published_dates(spark, folder):
    """Event times written as feed dates and read back."""
    stamp = F.concat(F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    parsed = F.unix_seconds(parse_published(F.concat(F.lit("Tue, "), stamp)))
    return table(spark, folder, "events").select("event_id", parsed.alias("seconds"))


@query
def truncate_tokens(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", tx.truncate_tokens(F.col("text"), 100).alias("head")
    )


@query
def chunk_tokens(spark, folder):
    cleaned = table(spark, folder, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    chunks = F.posexplode(tx.chunk_tokens(F.col("text"), 460, 50)).alias("chunk_no", "chunk")
    return cleaned.select("doc_id", chunks)


# ---- sources


@query
def latest_per_group(spark, folder):
    events = table(spark, folder, "events")
    recent = landing.latest_per_group(events, 50, "user_id", "ts", "event_id")
    return recent.select("user_id", "event_id")


@query
def drop_pinned(spark, folder):
    events = table(spark, folder, "events").withColumn("stickied", F.col("event_type") == "error")
    return landing.drop_pinned(events).select("event_id", "event_type")


@query
def combine_sources(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("part"), "lang", "n_chars"
    )
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("part"), "role"
    )
    return landing.combine_sources(documents, turns, order=("key", "part"))


# ---- deduplication and validation


@query
def dedup_first(spark, folder):
    """First document of each text."""
    documents = table(spark, folder, "documents").withColumn("digest", F.md5("text"))
    return dedup.dedup_first(documents, "digest", "doc_id").select("digest", "doc_id")


def json_lines(spark, folder):
    """Documents as JSON lines: German ones lose their brace, short ones a field."""
    whole = F.to_json(F.struct(F.md5("text").alias("id"), "source", "lang", "n_chars"))
    short = F.to_json(F.struct(F.md5("text").alias("id"), "source"))
    line = F.when(F.col("n_chars") < 500, short).otherwise(whole)
    broken = F.when(F.col("lang") == "de", F.expr("substring(line, 1, length(line) - 1)")).otherwise(
        F.col("line")
    )
    lines = table(spark, folder, "documents").withColumn("line", line).withColumn("value", broken)
    return validation.parsed_lines(lines.select(F.col("doc_id").alias("line"), "value"))


LINE_CONTRACTS = {f"src{i}": ("id", "source", "lang", "n_chars") for i in range(12)}


@query
def json_errors(spark, folder):
    return validation.json_errors(json_lines(spark, folder)).select("line", "rule")


@query
def missing_fields(spark, folder):
    return validation.missing_fields(json_lines(spark, folder), ["id", "lang", "n_chars", "url"])


@query
def duplicate_ids(spark, folder):
    return validation.duplicate_ids(json_lines(spark, folder)).select("line", "rule")


@query
def validate_mixed(spark, folder):
    return validation.validate_mixed(json_lines(spark, folder), LINE_CONTRACTS, ("id", "url"))


@query
def validation_report(spark, folder):
    parsed = materialize(json_lines(spark, folder))
    report = validation.validation_report(parsed, LINE_CONTRACTS)
    return validation.report_summary(parsed, report)


# ---- topics


def labelled_vectors(spark, folder):
    return vectors(spark, folder).select(
        "category", "topic", F.col("id").alias("ingest_seq"), F.concat(F.lit(" v"), "id", F.lit(" ")).alias("id")
    )


@query
def collect_members(spark, folder):
    return topics.topic_members(labelled_vectors(spark, folder)).select("topic", "position", "post_id")


@query
def posts_of_topics(spark, folder):
    """Sources as topics; the text digest is the id, so copies meet the last row of the text."""
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("category"),
        F.col("source").alias("topic"),
        F.md5("text").alias("id"),
        F.col("doc_id").alias("ingest_seq"),
    )
    matched = topics.posts_of_topics(topics.topic_members(rows), rows.drop("topic"))
    return matched.select("category", "topic", "id", "ingest_seq")


@query
def attach_topics(spark, folder):
    posts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("topic")
    )
    return topics.attach_topics(posts, labels)


@query
def check_alignment(spark, folder):
    posts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("topic")
    )
    return topics.check_alignment(posts, labels)


@query
def number_topics(spark, folder):
    numbered = topics.number_topics(document_posts(spark, folder))
    return numbered.select("category", "topic", "size", "number")


@query
def majority_label(spark, folder):
    """Most frequent language per source."""
    documents = table(spark, folder, "documents")
    return topics.majority_label(documents, ["source"], "lang", ["fr", "de", "es", "en"])


def weights(spark, folder, **options):
    return materialize(topics.ctfidf(document_posts(spark, folder), "text_en", **options))


@query
def ctfidf(spark, folder):
    return weights(spark, folder).select(
        "category", "topic", "term", "n", rounded("weight", 9).alias("weight")
    )


@query
def ctfidf_parity(spark, folder):
    found = weights(spark, folder, weighting="tfidf", stop=stopwords(parity=True))
    return found.select("category", "topic", "term", "n", rounded("weight", 9).alias("weight"))


@query
def topic_keywords(spark, folder):
    keywords = topics.topic_keywords(weights(spark, folder))
    return keywords.select("category", "topic", joined("keywords").alias("keywords"))


@query
def topic_titles(spark, folder):
    return topics.topic_titles(topics.topic_keywords(weights(spark, folder)))


@query
def topic_info(spark, folder):
    keywords = topics.topic_keywords(weights(spark, folder))
    return topics.topic_info(document_posts(spark, folder), keywords)


@query
def enrich_topics(spark, folder):
    """Topics of all conversations' roles and documents' sources; only the latter have keywords."""
    posts = document_posts(spark, folder)
    keywords = topics.topic_keywords(weights(spark, folder))
    known = posts.select("category", "topic").distinct()
    extra = table(spark, folder, "conversations").select(
        F.col("role").alias("category"), F.lit(0).alias("topic")
    ).distinct()
    found = topics.enrich_topics(known.unionByName(extra), keywords, topics.topic_titles(keywords))
    return found.select("category", "topic", "title", joined("keywords").alias("keywords"))


# ---- trends


def best_posts(spark, folder):
    return trends.top_posts(document_posts(spark, folder), 5)


@query
def top_posts(spark, folder):
    return best_posts(spark, folder).select("category", "topic", "rank", "id", "popularity")


@query
def top_titles(spark, folder):
    titles = trends.top_titles(best_posts(spark, folder))
    return titles.select("category", "topic", joined("top_titles").alias("top_titles"))


@query
def trend_dates(spark, folder):
    return trends.trend_dates(document_posts(spark, folder))


@query
def event_dates(spark, folder):
    """First and last day of each user's events."""
    return (
        table(spark, folder, "events")
        .withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
        .groupBy("user_id")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select(
            "user_id",
            utc_date(F.unix_micros("first") / 1e6).alias("start_date"),
            utc_date(F.unix_micros("last") / 1e6).alias("end_date"),
        )
    )


@query
def summary_input(spark, folder):
    return trends.summary_input(best_posts(spark, folder), 1024)


def summaries(spark, folder):
    inputs = trends.summary_input(best_posts(spark, folder), 1024)
    return summary.summarize(inputs, weights(spark, folder))


@query
def summarize(spark, folder):
    return summaries(spark, folder)


@query
def summarize_distinct(spark, folder):
    """Summaries that pass over sentences which repeat a better one."""
    inputs = trends.summary_input(best_posts(spark, folder), 1024)
    return summary.summarize(inputs, weights(spark, folder), overlap=0.6)


def trend_table(spark, folder):
    posts = document_posts(spark, folder)
    found = weights(spark, folder)
    top = best_posts(spark, folder)
    sums = summary.summarize(trends.summary_input(top, 1024), found)
    return trends.trend_rows(topics.topic_keywords(found), posts, trends.top_titles(top), sums)


def readable(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"keywords": joined("keywords"), "top_titles": joined("top_titles")}
    )


@query
def trend_rows(spark, folder):
    return readable(trends.order_trends(trend_table(spark, folder)))


# ---- dashboard

#: One language of the tables is left out, so that the filter has something to remove.
LISTED = ("en", "fr", "de")
LANGUAGES = (*LISTED, "es")


@query
def filter_trends(spark, folder):
    return readable(dashboard.filter_trends(trend_table(spark, folder), "All", LISTED))


@query
def search_trends(spark, folder):
    return readable(dashboard.search_trends(trend_table(spark, folder), "The EN"))


@query
def keyword_facet(spark, folder):
    return dashboard.keyword_facet(topics.topic_keywords(weights(spark, folder)))


@query
def filter_by_keyword(spark, folder):
    keywords = topics.topic_keywords(weights(spark, folder))
    found = dashboard.filter_by_keyword(keywords, "th")
    return found.select("category", "topic", joined("keywords").alias("keywords"))


@query
def best_title(spark, folder):
    found = trend_table(spark, folder)
    title = dashboard.best_title(F.col("summary"), F.col("top_titles"))
    return found.select("category", "cluster_id", title.alias("title"))


@query
def hot_trends(spark, folder):
    found = dashboard.filter_trends(trend_table(spark, folder), "All", LANGUAGES)
    return dashboard.hot_trends(found).select("category", "cluster_id", "total_posts", "is_hot")


@query
def hot_trends_parity(spark, folder):
    found = dashboard.filter_trends(trend_table(spark, folder), "All", LANGUAGES)
    hot = dashboard.hot_trends(found, parity=True)
    return hot.select("category", "cluster_id", "total_posts", "is_hot")


@query
def recent_trends(spark, folder):
    found = dashboard.filter_trends(trend_table(spark, folder), "en", LANGUAGES)
    return dashboard.recent_trends(found).select("category", "cluster_id", "end_date", "is_hot")


@query
def trend_cards(spark, folder):
    found = dashboard.filter_trends(trend_table(spark, folder), "All", LANGUAGES)
    cards = dashboard.trend_cards(dashboard.hot_trends(found))
    return cards.withColumn("other_titles", joined("other_titles"))


@query
def top_trends(spark, folder):
    """The whole way: clean, filter, deduplicate, weigh, rank and assemble trend cards."""
    rows = document_posts(spark, folder).withColumns(
        {"text_en": tx.clean_text(F.col("text_en")), "id": F.md5("text_en")}
    )
    posts = materialize(dedup.dedup_first(dedup.valid_ids(rows)))
    found = materialize(topics.ctfidf(posts, "text_en"))
    top = trends.top_posts(posts, 5)
    sums = summary.summarize(trends.summary_input(top, 1024), found)
    table_ = trends.trend_rows(topics.topic_keywords(found), posts, trends.top_titles(top), sums)
    cards = dashboard.trend_cards(dashboard.hot_trends(dashboard.filter_trends(table_, "All", LANGUAGES)))
    return cards.withColumn("other_titles", joined("other_titles"))


# ---- language and embedding


@query
def language_profile(spark, folder):
    profile = language.train_language_profile(table(spark, folder, "documents"))
    return profile.select("lang", "bucket", "n", rounded("logp", 9).alias("logp"))


@query
def detect_language(spark, folder):
    profile = language.train_language_profile(table(spark, folder, "documents"))
    turns = table(spark, folder, "conversations")
    found = language.detect_language(turns, profile, ["text"])
    return found.select("conv_id", "turn", "language")


@query
def language_report(spark, folder):
    """Document languages, all supported, and event types, which are not, as language codes."""
    known = table(spark, folder, "documents").select(F.col("lang").alias("language"))
    foreign = table(spark, folder, "events").select(F.col("event_type").alias("language"))
    return language.language_report(known.unionByName(foreign))


def lexicon(spark, folder):
    """Words of the foreign documents, each mapped to its reverse."""
    rows = table(spark, folder, "documents").filter(F.col("lang") != "en")
    pairs = rows.select("lang", F.explode(tx.word_set(F.col("text"))).alias("src")).distinct()
    return pairs.withColumn("dst", F.reverse("src"))


@query
def translate_lexicon(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("detected_language"), "text")
    done = translation.translate_lexicon(documents, lexicon(spark, folder), ("text",), seq="doc_id")
    return done.select("doc_id", "text_en")


def word_pairs(batches):
    """Distinct pairs of neighbouring words of each thousand texts ``(lang, words)``."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            lists = pc.split_pattern(part.column("words"), " ")
            words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            within = pa.array(of[1:] == of[:-1])
            pairs = pc.binary_join_element_wise(words[:-1], words[1:], " ").filter(within)
            langs = part.column("lang").take(pa.array(of[1:]).filter(within))
            found = pa.table([langs, pairs], names=["lang", "src"]).group_by(["lang", "src"]).aggregate([])
            yield from found.to_batches()


@query
def translate_phrases(spark, folder):
    """Pairs of neighbouring words of the foreign documents, a sixteenth of them, as one word; other words stay."""
    documents = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("detected_language"), "text")
    rows = documents.filter("detected_language != 'en'")
    rows = rows.select(F.col("detected_language").alias("lang"), F.lower(tx.clean_text(F.col("text"))).alias("words"))
    pairs = rows.mapInArrow(word_pairs, "lang string, src string").distinct()
    phrases = pairs.filter(F.md5("src").endswith("0")).withColumn("dst", F.replace("src", F.lit(" "), F.lit("_")))
    done = translation.translate_lexicon(documents, phrases, ("text",), seq="doc_id")
    return done.select("doc_id", "text_en")


@query
def translate_lexicon_parity(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("detected_language"), "text")
    done = translation.translate_lexicon(
        documents, lexicon(spark, folder), ("text",), seq="doc_id", parity=True
    )
    return done.select("doc_id", "text_en")


@query
def normalize_language(spark, folder):
    posts = threads(spark, folder).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ingest_seq"), "title", F.col("body").alias("selftext")
    )
    profile = language.train_language_profile(table(spark, folder, "documents"))
    done = translation.normalize_language(posts, profile, lexicon(spark, folder))
    return done.select("ingest_seq", "detected_language", "title_en", "selftext_en", "summary_en", "text_en")


@query
def embed_text(spark, folder):
    documents = table(spark, folder, "documents")
    idf = embedding.train_idf(documents, "text")
    vector = embedding.hashed_vector(F.col("text"), idf, 64)
    listed = documents.select("doc_id", F.posexplode(vector).alias("dim", "value"))
    return listed.filter(F.abs("value") > 1e-12).select("doc_id", "dim", rounded("value").alias("value"))


# ---- nearest neighbours


def query_vectors(spark, folder):
    return vectors(spark, folder).withColumnRenamed("id", "query_id")


@query
def vector_search(spark, folder):
    hits = search.vector_search(query_vectors(spark, folder), vectors(spark, folder), 5, metadata=["topic"])
    return hits.select("query_id", "id", "rank", "topic", rounded("distance").alias("distance"))


@query
def search_vector_table(spark, folder):
    """Search in a table written for it, pruned by cell."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    search.build_vector_table(vectors(spark, folder), path, cell_rows=64)
    hits = search.search_table(spark, path, query_vectors(spark, folder), 5, "all")
    return hits.select("query_id", "id", "rank", rounded("distance").alias("distance"))


@query
def search_code_table(spark, folder):
    """Approximate search in lists of codes: how many hits, and whether nine tenths are true neighbours."""
    path = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    base, asked = vectors(spark, folder), query_vectors(spark, folder)
    codes.build_code_table(base, path)
    found = codes.search_codes(spark, path, asked, 5, probes=32)
    true = search.vector_search(asked, base, 5).select("category", "query_id", "id", F.lit(1).alias("true"))
    met = found.join(true, ["category", "query_id", "id"], "left")
    return met.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_hits"), (F.sum(F.coalesce("true", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recalled")
    )


@query
def search_text(spark, folder):
    """Benchmark texts asked of the documents, encoded in the documents' space."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    documents = table(spark, folder, "documents").select(F.lit("all").alias("category"), F.col("doc_id").alias("id"), "text")
    idf = materialize(embedding.train_idf(documents, "text"))
    stored = documents.withColumn("vector", embedding.hashed_vector(F.col("text"), idf, 64)).drop("text")
    search.build_vector_table(stored, path, cell_rows=64)
    search.write_encoder(idf, path)
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search.search_text(spark, path, asked, 5)
    return hits.select("query_id", "id", "rank", rounded("distance").alias("distance"))


@query
def knn_graph(spark, folder):
    graph = knn.knn_graph(vectors(spark, folder), 5)
    return graph.select("src", "dst", "rank", rounded("d2").alias("d2"))


@query
def knn_graph_cells(spark, folder):
    """The same graph by the way a large table takes."""
    graph = knn.knn_graph(vectors(spark, folder), 5, broadcast_bytes=0, cell_rows=128, block_rows=128)
    return graph.select("src", "dst", "rank", rounded("d2").alias("d2"))


# ---- clustering


@query
def spanning_tree(spark, folder):
    tree = spanning.spanning_tree(vectors(spark, folder), 5)
    return tree.select("a", "b", rounded("w").alias("w"))


@query
def density_components(spark, folder):
    """Points linked at squared mutual reachability up to 1.35."""
    points = vectors(spark, folder)
    tree = materialize(spanning.spanning_tree(points, 5))
    return spanning.density_components(tree, points, 1.35**0.5).select("node", "component")


@query
def density_cluster(spark, folder):
    return density.density_cluster(vectors(spark, folder), 5, 5).select("id", "topic")


@query
def reduce_dims(spark, folder):
    flat = reduce.reduce_dims(vectors(spark, folder), ["all"], 5)
    return flat.select("id", F.posexplode("vector").alias("axis", "value"))


@query
def cluster_topics(spark, folder):
    found = clustering.cluster_topics(vectors(spark, folder), "topic", ["all"], 5, 5, 5)
    return found.select("id", "topic")


@query
def topic_regions(spark, folder):
    regions = clustering.topic_regions(vectors(spark, folder))
    first = F.get("centroid", F.lit(0))
    return regions.select("topic", "size", rounded(first).alias("first"), rounded("radius2").alias("radius2"))


@query
def assign_topics(spark, folder):
    points = vectors(spark, folder)
    placed = clustering.assign_topics(points, clustering.topic_regions(points))
    return placed.select("id", "topic", rounded("d2").alias("d2"))


@query
def members(spark, folder):
    points = vectors(spark, folder)
    placed = clustering.assign_topics(points, clustering.topic_regions(points))
    return topics.members(placed, 3).select("id")


@query
def topic_map(spark, folder):
    return reduce.topic_map(vectors(spark, folder), ["all"]).select("topic", "size", "x", "y")


@query
def topic_bars(spark, folder):
    bars = reduce.topic_bars(weights(spark, folder), 5)
    return bars.select("category", "topic", "rank", "term", rounded("weight", 9).alias("weight"))


@query
def find_trends(spark, folder):
    """Documents through embedding, topic clustering and summaries."""
    posts = document_posts(spark, folder).drop("topic")
    composed = materialize(posts.withColumn("text_for_embedding", tx.compose_text()))
    settings = Settings(categories=("en", "fr", "de", "es"))
    found = trend_run.find_trends(trend_run.embed_posts(composed, settings=settings), settings=settings)
    return readable(found.trends)
