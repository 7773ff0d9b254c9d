import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trendspark.schemas import COMBINED, RAW_POST, TREND
from trendspark.session import top_per_group, with_position
from trendspark.sources import landing, sinks
from trendspark.streaming.landing import ingest_new_posts

POSTS = [
    dict(id="p1", subreddit="NBATalk", author=None, title="Late three", selftext="", score=0, num_comments=12, url="u1", created_utc=3.0, stickied=False),
    dict(id="p2", subreddit="NBATalk", author={"name": "ann"}, title="Pinned", selftext="x", score=1, num_comments=1, url="u2", created_utc=9.0, stickied=True),
    dict(id="p3", subreddit="chess", author={"name": "bob"}, title="Soccer?", selftext=None, score=5, num_comments=0, url="u3", created_utc=1.0),
    dict(id="p4", subreddit="NBATalk", author={"name": "cy"}, title="Old", selftext="", score=1, num_comments=1, url="u4", created_utc=2.0, stickied=False),
]
FEED = """<?xml version="1.0"?><rss><channel>
<item><guid>e1</guid><title>T1</title><description>Guard out</description><link>l1</link><pubDate>Mon, 05 Aug 2024 12:34:56 EST</pubDate></item>
<item><guid></guid><title>Second</title><link>l2</link></item>
</channel></rss>"""


@pytest.fixture()
def landed(tmp_path):
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.json").write_text("\n".join(json.dumps(p) for p in POSTS))
    (tmp_path / "feeds" / "nba").mkdir(parents=True)
    (tmp_path / "feeds" / "nba" / "news.xml").write_text(FEED)
    return tmp_path


def test_read_posts(spark, landed):
    posts = landing.read_posts(spark, str(landed / "posts"))
    assert rows(posts, "id", "author", "text", "category") == [
        ("p1", None, "Late three\n\n", "nba"),
        ("p3", "bob", "Soccer?\n\n", "soccer"),
        ("p4", "cy", "Old\n\n", "nba"),
    ]
    # The limit counts the pinned post, which is dropped afterwards.
    assert rows(landing.read_posts(spark, str(landed / "posts"), limit=2), "id") == [("p1",), ("p3",)]


def test_read_feed_and_combine(spark, landed):
    articles = landing.read_feed(spark, str(landed / "feeds" / "nba"))
    assert rows(articles, "id", "category", "title", "summary", "text", "link", "published") == [
        ("e1", "nba", "T1", "Guard out", "T1\n\nGuard out", "l1", "Mon, 05 Aug 2024 12:34:56 EST"),
        ("l2", "nba", "Second", "", "Second\n\n", "l2", ""),
    ]
    parity = landing.read_feed(spark, str(landed / "feeds" / "nba"), parity=True)
    assert {r.category for r in parity.collect()} == {"NBA"}
    combined = landing.combine_sources(landing.read_posts(spark, str(landed / "posts")), articles)
    assert set(combined.columns) == set(COMBINED.names) | {"ingest_seq"}
    found = {r.id: r.ingest_seq for r in combined.collect()}
    assert found == {"p1": 0, "p3": 1, "p4": 2, "e1": 3, "l2": 4}


def test_several_feeds_in_one_call(spark, landed):
    (landed / "feeds" / "soccer").mkdir()
    (landed / "feeds" / "soccer" / "news.xml").write_text(FEED)
    both = landing.read_feed(spark, [str(landed / "feeds" / n) for n in ("nba", "soccer")])
    assert sorted(r.category for r in both.collect()) == ["nba", "nba", "soccer", "soccer"]


def test_broken_lines_are_never_silent(spark, landed):
    (landed / "posts" / "b.json").write_text('{"id": "x", "score": 1}\n{"id": "y", \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed|FAILED_READ"):
        landing.read_posts(spark, str(landed / "posts")).collect()
    good, broken = landing.split_jsonl(spark, str(landed / "posts"), RAW_POST)
    assert good.count() == 5 and rows(broken, "line") == [('{"id": "y", ',)]


def test_jsonl_keeps_nulls_and_unicode(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("é", "x")], "k string, v string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '{"k":"a","v":null}' in lines and '{"k":"é","v":"x"}' in lines
    assert rows(landing.read_jsonl(spark, str(tmp_path / "out"), df.schema), "k", "v") == rows(df)


def test_trend_document_round_trip(spark, tmp_path):
    trends = spark.createDataFrame(
        [(1, 5, "nba", ["é"], "s", ["t"], None, None), (0, 9, "nba", [], "s", [], "2024-01-01", "2024-01-02")], TREND
    )
    sinks.write_trends(trends, str(tmp_path / "trends"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "trends").glob("part-*")))
    document = json.loads(text.strip())
    assert [t["cluster_id"] for t in document] == [0, 1] and "\\u00e9" in text.lower()
    assert document[1]["start_date"] is None
    assert rows(landing.read_trends(spark, str(tmp_path / "trends"), multi_line=True)) == rows(trends)
    sinks.write_trend_lines(trends, str(tmp_path / "lines"))
    assert rows(landing.read_trends(spark, str(tmp_path / "lines"))) == rows(trends)
    sinks.write_trends(trends.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    assert landing.read_trends(spark, str(tmp_path / "absent")).count() == 0


def test_partitioned_sinks(spark, tmp_path):
    df = spark.createDataFrame([("nba", 1), ("soccer", 2)], "category string, id int")
    sinks.write_embeddings(df, str(tmp_path / "e"))
    sinks.write_topics(df, str(tmp_path / "t"))
    assert (tmp_path / "e" / "category=nba").exists() and (tmp_path / "t" / "category=soccer").exists()


def test_positions_and_top_rows_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("k"), (-F.col("id")).alias("v"))
    placed = with_position(df, ["v"], ["k"])
    wrong = placed.filter(F.col("pos") != F.when(F.col("k") == "hot", 1999 + F.col("v")).otherwise(2999 + F.col("v")))
    assert placed.count() == 3000 and wrong.isEmpty()
    best = top_per_group(df, ["k"], ["v"], 1500)
    assert sorted((r.k, r.n) for r in best.groupBy("k").agg(F.count("*").alias("n")).collect()) == [("cold", 1000), ("hot", 1500)]
    assert best.filter("k = 'hot'").agg(F.max("v")).first()[0] == -500


def test_incremental_landing(spark, landed, tmp_path):
    where = [str(tmp_path / n) for n in ("table", "progress")]
    for _ in range(2):
        ingest_new_posts(spark, str(landed / "posts"), *where).awaitTermination()
    assert spark.read.parquet(where[0]).count() == 3
    (landed / "posts" / "b.json").write_text(json.dumps(dict(POSTS[0], id="p9")))
    ingest_new_posts(spark, str(landed / "posts"), *where).awaitTermination()
    assert spark.read.parquet(where[0]).count() == 4
