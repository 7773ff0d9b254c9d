import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trendspark.operators import dashboard, summary, topics, trends
from trendspark.operators.trends import NO_SUMMARY
from trendspark.schemas import TREND

POST = (
    "category string, topic int, id string, ingest_seq bigint, source string, title string, title_en string, "
    "selftext_en string, summary_en string, text_en string, score bigint, num_comments bigint, "
    "created_utc double, published string"
)


def post(topic, seq, title, score, category="nba", text="", created=None):
    return (category, topic, f"p{seq}", seq, "reddit", title, title, text, None, text, score, 0, created, None)


def test_members_are_listed_and_rejoined(spark):
    df = spark.createDataFrame([("c", 0, f" {i} ", i) for i in (3, 1, 2, 7)], "category string, topic int, id string, ingest_seq bigint")
    lists = topics.topic_members(df)
    assert rows(lists) == [("c", 0, 0, "1"), ("c", 0, 1, "2"), ("c", 0, 2, "3"), ("c", 0, 3, "7")]
    assert rows(topics.fold_members(lists)) == [("c", 0, ["1", "2", "3", "7"])]
    meta = spark.createDataFrame([("c", "1", 10, "old"), ("c", "1", 11, "new"), ("c", " 7", 12, "x")], "category string, id string, ingest_seq bigint, v string")
    twice = lists.unionByName(lists)
    assert rows(topics.posts_of_topics(twice, meta), "v") == [("new",), ("new",), ("x",), ("x",)]


def test_alignment(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "id string")
    labels = spark.createDataFrame([("b", 1), ("z", 1)], "id string, topic int")
    assert rows(topics.check_alignment(posts, labels)) == [("labels_without_post", 1), ("unlabelled_posts", 1)]
    assert rows(topics.attach_topics(posts, labels)) == [("b", 1)]


def test_numbering_by_size(spark):
    data = [("c", t, i) for i, t in enumerate([5, 5, 9, 9, 7, -1, -1, -1])]
    df = spark.createDataFrame(data, "category string, topic int, ingest_seq bigint")
    assert rows(topics.number_topics(df), "topic", "number") == [(-1, -1), (5, 0), (7, 2), (9, 1)]
    assert topics.renumber(df).filter("topic = 0").count() == 2


def test_majority_label(spark):
    data = [(1, "nba"), (1, "soccer"), (2, "soccer"), (2, "Soccer"), (2, "nba"), (3, "x"), (4, None)]
    df = spark.createDataFrame(data, "k int, category string")
    assert rows(topics.majority_label(df, ["k"], "category", ["nba", "soccer"])) == [(1, "nba"), (2, "soccer"), (3, "nba"), (4, "nba")]


def test_terms_bridge_removed_words_and_vocabulary_ties(spark):
    df = spark.createDataFrame([("c", 0, "guard the injury a"), ("c", 1, "injury guard zz")], "category string, topic int, text_for_embedding string")
    counts = topics.term_counts(df)
    assert ("c", 0, "guard injury", 1) in rows(counts)
    assert {r.term for r in topics.vocabulary(counts, 3).collect()} == {"guard", "injury", "guard injury"}
    single = topics.ctfidf(df.filter("topic = 0"))
    assert single.count() == 3 and single.filter("weight <= 0").isEmpty()
    with pytest.raises(ValueError):
        topics.ctfidf(df, weighting="other")


def test_titles_and_enrichment(spark):
    kw = spark.createDataFrame([("c", 0, ["a", "b", "c", "d", "e"]), ("c", -1, ["n"])], "category string, topic int, keywords array<string>")
    assert rows(topics.topic_titles(kw), "title") == [("0_a_b_c_d",)]
    known = spark.createDataFrame([("c", 0), ("c", -1), ("c", 8)], "category string, topic int")
    found = topics.enrich_topics(known, kw, topics.topic_titles(kw))
    assert rows(found, "topic", "title", "keywords") == [(-1, "", ["n"]), (0, "0_a_b_c_d", ["a", "b", "c", "d", "e"]), (8, "", [])]


def test_top_posts_and_titles(spark):
    data = [post(0, 4, "d", 3), post(0, 1, "", 9), post(0, 2, "b", 3), post(0, 3, "c", 1), post(1, 5, "only", 0)]
    top = trends.top_posts(spark.createDataFrame(data, POST), 3)
    # An empty title inside the top three shortens the list.
    assert rows(trends.top_titles(top)) == [("nba", 0, ["b", "d"]), ("nba", 1, ["only"])]
    assert rows(trends.summary_input(top, 3)) == [("nba", 0, "b d"), ("nba", 1, "only")]


def test_trend_rows_keep_noise_and_empty_topics(spark):
    data = [post(-1, 1, "x", 1, created=86400.0 * 2), post(-1, 2, "y", 1, created=0.0), post(3, 3, "z", 1, created=None)]
    posts = spark.createDataFrame(data, POST)
    known = spark.createDataFrame([("nba", -1, ["k"]), ("nba", 3, []), ("nba", 9, None)], "category string, topic int, keywords array<string>")
    sums = spark.createDataFrame([("nba", -1, "s")], "category string, topic int, summary string")
    table = trends.trend_rows(known, posts, trends.top_titles(trends.top_posts(posts)), sums)
    found = [tuple(r) for r in trends.order_trends(table).collect()]
    assert found == [
        (-1, 2, "nba", ["k"], "s", ["x", "y"], "1970-01-03", "1970-01-03"),
        (3, 1, "nba", [], NO_SUMMARY, ["z"], None, None),
        (9, 0, "nba", [], NO_SUMMARY, [], None, None),
    ]
    assert table.schema.names == TREND.names


def test_summaries(spark):
    inputs = spark.createDataFrame([("c", 0, "Low one. Guard injury here! Other words."), ("c", 1, "")], "category string, topic int, summary_input string")
    weights = spark.createDataFrame([("c", 0, "guard", 1.0), ("c", 0, "injury", 0.5)], "category string, topic int, term string, weight double")
    assert rows(summary.summarize(inputs, weights, 3, 1)) == [("c", 0, "Guard injury here!"), ("c", 1, NO_SUMMARY)]
    assert rows(summary.summarize(inputs, weights, 6, 1))[0][2] == "Low one. Guard injury here!"

    def shouting():
        return str.upper

    def broken():
        raise RuntimeError("no model")

    assert rows(summary.summarize_with_model(inputs, shouting), "summary")[0][0].startswith("LOW ONE")
    assert set(rows(summary.summarize_with_model(inputs, broken), "summary")) == {("[Summary failed: no model]",), (NO_SUMMARY,)}


def test_summary_passes_over_repeats(spark):
    text = "Guard injury stops season today. Guard injury stops season tonight. Coach leaves club."
    inputs = spark.createDataFrame([("c", 0, text)], "category string, topic int, summary_input string")
    weights = spark.createDataFrame(
        [("c", 0, w, 1.0) for w in ("guard", "injury", "stops", "season")] + [("c", 0, "coach", 0.1)],
        "category string, topic int, term string, weight double",
    )
    assert rows(summary.summarize(inputs, weights, 10, 1))[0][2] == " ".join(text.split()[:10])
    found = rows(summary.summarize(inputs, weights, 10, 1, overlap=0.6))
    assert found == [("c", 0, "Guard injury stops season today. Coach leaves club.")]


@pytest.mark.parametrize("overlap", [0.0, 0.5, 1.0])
def test_distinct_sentences_by_brute_force(spark, overlap):
    rng = random.Random(5)
    names = ["guard", "coach", "club", "goal", "final", "the", "and"]
    given = []
    for topic in range(6):
        for pos in range(rng.randint(1, 14)):
            sentence = " ".join(rng.choice(names) for _ in range(rng.randint(1, 5)))
            given.append(("c", topic, pos, sentence, float(rng.randint(0, 3)), len(sentence.split())))
    scored = spark.createDataFrame(given, "category string, topic int, pos int, sentence string, score double, tokens int")
    want = []
    for topic in range(6):
        kept = []
        for row in sorted((r for r in given if r[1] == topic), key=lambda r: (-r[4], r[2])):
            own = set(row[3].split()) - {"the", "and"}
            if all(len(own & other) < overlap * len(own | other) for other, _ in kept):
                kept.append((own, row))
        want += [row for _, row in kept]
    found = summary.distinct_sentences(scored, overlap, ["the", "and"])
    assert found.columns == scored.columns
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert summary.distinct_sentences(scored.limit(0), overlap).count() == 0


def trend(cluster, n, category="nba", summary="about guard", titles=("One", "Guard talk"), end="2024-01-02", start="2024-01-01"):
    return (cluster, n, category, ["k1", "k2"], summary, list(titles), start, end)


def test_filters_and_search(spark):
    df = spark.createDataFrame([trend(-1, 9), trend(0, 5), trend(1, 4, "soccer", "100% sure", ["x_y"]), trend(2, 3, "other")], TREND)
    assert rows(dashboard.filter_trends(df), "cluster_id") == [(0,), (1,)]
    assert rows(dashboard.filter_trends(df, "other"), "cluster_id") == [(2,)]
    assert dashboard.search_trends(df, "  ").count() == 4
    assert rows(dashboard.search_trends(df, "0%"), "cluster_id") == [(1,)]
    assert rows(dashboard.search_trends(df, "X_Y"), "cluster_id") == [(1,)]
    assert dashboard.search_trends(df, " guard x").isEmpty()
    assert dashboard.search_trends(df, "GUARD TALK").count() == 3
    assert rows(dashboard.keyword_facet(df)) == [("k1",), ("k2",)]
    assert dashboard.filter_by_keyword(df, "k1").count() == 4 and dashboard.filter_by_keyword(df, "k").isEmpty()


@pytest.mark.parametrize("n,hot", [(2, 2), (39, 3), (40, 4)])
def test_hot_count(spark, n, hot):
    df = spark.createDataFrame([trend(i, 100 - i) for i in range(n)], TREND)
    found = dashboard.hot_trends(df).collect()
    assert [r.cluster_id for r in found] == list(range(n)) and sum(r.is_hot for r in found) == hot


def test_hot_badge_is_per_category_unless_parity(spark):
    df = spark.createDataFrame([trend(i, 100 - i) for i in range(4)] + [trend(0, 1, "soccer")], TREND)
    hot = lambda **k: {(r.category, r.cluster_id) for r in dashboard.hot_trends(df, **k).collect() if r.is_hot}
    assert hot() == {("nba", 0), ("nba", 1), ("nba", 2)}
    assert hot(parity=True) == hot() | {("soccer", 0)}


def test_recent_and_cards(spark):
    df = spark.createDataFrame([trend(0, 5, end=None), trend(1, 4, titles=()), trend(2, 3, end="2024-03-01")], TREND)
    recent = dashboard.recent_trends(df)
    assert [r.cluster_id for r in recent.collect()] == [2, 1, 0]
    cards = {r.cluster_id: r for r in dashboard.trend_cards(dashboard.hot_trends(df)).collect()}
    assert cards[0].header == "🔥 Guard talk (5 posts) "
    assert cards[1].header == "🔥 (No title) (4 posts) [2024-01-01 – 2024-01-02]"
    assert cards[2].other_titles == ["One"] and cards[2].keyword_line == "k1 | k2" and cards[2].category_label == "Nba"


def test_best_title_ties(spark):
    df = spark.createDataFrame([("a b", ["x", "b", "a"]), ("q", ["x", "y"])], "s string, t array<string>")
    assert [r[0] for r in df.select(dashboard.best_title(F.col("s"), F.col("t"))).collect()] == ["b", "x"]
