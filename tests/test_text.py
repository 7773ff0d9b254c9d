from pyspark.sql import functions as F

from trendspark.config import safe_input_tokens
from trendspark.functions import text as tx
from trendspark.functions.dates import event_time, utc_date
from trendspark.functions.wordlists import BASE_STOPWORDS, STOPWORDS, stopwords


def one(spark, expression, schema="x string", *values):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_clean_text_follows_unicode_rules(spark):
    given = [
        None, "a\rb", "a‍b", "a b", "a b", "ＡＢ", "x \U0001fae0 y", "\x00\x07",
        "  a\t\n b  ", "k", "plain", "",
    ]
    wanted = ["", "ab", "ab", "a b", "a b", "AB", "x \U0001fae0 y", "", "a b", "k", "plain", ""]
    assert one(spark, tx.clean_text(F.col("x")), "x string", *given) == wanted


def test_unified_text_keeps_the_gap(spark):
    found = one(spark, tx.unified_text(F.col("a"), F.col("b")), "a string, b string", ("t", None), ("t", ""), ("t", "b"))
    assert found == ["t\n\n", "t\n\n", "t\n\nb"]


def test_compose_text_by_source(spark):
    schema = "source string, title_en string, selftext_en string, summary_en string, text_en string"
    given = [
        ("reddit", "t", None, "s", "x"),
        ("espn", "t", "z", "s", "x"),
        ("other", "t", "z", "s", None),
        ("reddit", None, "", None, "x"),
    ]
    assert one(spark, tx.compose_text(), schema, *given) == ["t", "t\n\ns\n\nx", "", ""]


def test_infer_category_precedence(spark):
    schema = "g string, t string, x string"
    given = [
        ("NBATalk", "football", ""),
        ("MyBasketballClub", "", ""),
        ("footballnews", "nba", ""),
        ("misc", "", "the Premier League"),
        ("misc", "soccer and NBA", ""),
        ("misc", "chess", None),
        (None, None, None),
        ("SerieA", "", ""),
    ]
    found = one(spark, tx.infer_category(F.col("g"), F.col("t"), F.col("x")), schema, *given)
    assert found == ["nba", "nba", "soccer", "soccer", "nba", "other", "other", "soccer"]


def test_words_and_sets(spark):
    assert one(spark, tx.word_set(F.col("x")), "x string", "Hé hé llo_1, X!")[0] == ["hé", "llo_1", "x"]


def test_supported_language(spark):
    assert one(spark, tx.supported_language(F.col("x")), "x string", "en", "fr", "xx") == ["en", "fr", "unsupported"]


def test_truncate_and_chunks(spark):
    assert one(spark, tx.truncate_tokens(F.col("x"), 2), "x string", "a b  c", "a", "") == ["a b", "a", ""]
    found = one(spark, tx.chunk_tokens(F.col("x"), 4, 2), "x string", "", "a b c d", "a b c d e", "a b c d e f g")
    assert found == [[""], ["a b c d"], ["a b c d", "c d e"], ["a b c d", "c d e f", "e f g"]]


def test_popularity_falls_through_zero(spark):
    schema = "s bigint, c bigint"
    given = [(0, 7), (0, 0), (None, None), (-3, 9), (None, 4)]
    assert one(spark, tx.popularity(F.col("s"), F.col("c")), schema, *given) == [7, 0, 0, -3, 4]


def test_event_time(spark):
    schema = "c double, p string"
    given = [
        (0.0, "Mon, 05 Aug 2024 12:34:56 EST"),
        (None, "Mon, 5 Aug 2024 12:34:56 +0200"),
        (None, "2024-08-05T12:34:56Z"),
        (None, "soon"),
        (None, ""),
        (1722816000.5, "x"),
        (None, None),
    ]
    found = one(spark, event_time(F.col("c"), F.col("p")), schema, *given)
    assert found == [1722879296.0, 1722854096.0, 1722861296.0, None, None, 1722816000.5, None]
    assert one(spark, utc_date(F.col("c")), schema, (1722816000.5, ""), (-1.0, "")) == ["2024-08-05", "1969-12-31"]


def test_dates_without_zone_are_utc_in_any_session(spark):
    given = [(None, "2024-08-05"), (None, "Mon, 5 Aug 2024 00:00:00"), (None, "2024-08-05T00:00:00Z"), (None, "Aug 5, 2024")]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = one(spark, event_time(F.col("c"), F.col("p")), "c double, p string", *given)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [1722816000.0] * 4


def test_stopword_lists():
    assert len(set(BASE_STOPWORDS)) == 131
    assert len(set(stopwords(parity=True))) == 249
    assert {"thread", "watch"} <= set(STOPWORDS)
    assert not {"thread", "watch"} & set(stopwords(parity=True))


def test_input_limits():
    assert safe_input_tokens("facebook/bart-large-cnn") == 1024
    assert safe_input_tokens("google/pegasus-xsum") == 512
    assert safe_input_tokens("other", 100_000) == 4096
