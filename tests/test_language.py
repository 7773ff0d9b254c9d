import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from trendspark.operators import embedding, language, translation


def labelled(spark):
    return spark.createDataFrame(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("", "xx")],
        "text string, lang string",
    )


def test_detection_reads_the_head_only(spark):
    profile = language.train_language_profile(labelled(spark))
    assert profile.filter("lang = 'xx'").isEmpty()
    french = "le chat et le chien " * 10
    df = spark.createDataFrame([("a", " ‍ "), ("b", None), ("c", "der hund"), ("d", french + "the cat and the dog " * 50)], "id string, title string")
    found = language.detect_language(df, profile, ["title"])
    assert rows(found, "id", "language") == [("a", "en"), ("b", "en"), ("c", "de"), ("d", "fr")]
    assert rows(language.language_report(spark.createDataFrame([("fr",), ("xx",), ("xx",), ("en",), (None,)], "language string"))) == [("xx", 2)]


LEXICON = [("fr", "chat", "cat"), ("fr", "le", "the"), ("fr", "Chat", "kat")]


def posts(spark):
    return spark.createDataFrame(
        [(1, "fr", "Le chat dort", None), (2, "en", "le chat", "x"), (3, "unsupported", "le", ""), (4, "fr", "", "le")],
        "ingest_seq bigint, detected_language string, title string, selftext string",
    )


def test_lexicon_translation(spark):
    lexicon = spark.createDataFrame(LEXICON, "lang string, src string, dst string")
    found = translation.translate_lexicon(posts(spark), lexicon)
    assert rows(found, "ingest_seq", "title_en", "selftext_en", "text_en") == [
        (1, "the cat dort", "", ""), (2, "le chat", "x", ""), (3, "le", "", ""), (4, "", "the", ""),
    ]
    long = spark.createDataFrame([(1, "fr", "le a b c d")], "ingest_seq bigint, detected_language string, text string")
    twice = translation.translate_lexicon(long, lexicon, ("text",), size=4, overlap=2, parity=True)
    assert rows(twice, "text_en") == [("the a b c b c d",)]


def test_phrases_leftmost_longest(spark):
    entries = [
        ("fr", "pomme de", "apple-of"), ("fr", "Pomme  de\tterre", "potato"), ("fr", "terre cuite", "terracotta"),
        ("fr", "de", "of"), ("fr", "a b", "ab"), ("fr", "b c", "bc"), ("de", "pomme de", "never"), ("fr", " ", "blank"),
    ]
    lexicon = spark.createDataFrame(entries, "lang string, src string, dst string")
    texts = ["la POMME de terre cuite", "pomme de pin de", "a b c a b", "b c b", "pomme", "", None, "x " * 3_000 + "a b"]
    rows_in = [(i, "fr", t) for i, t in enumerate(texts)] + [(90, "en", "a b"), (91, "fr", "terre")]
    df = spark.createDataFrame(rows_in, "ingest_seq bigint, detected_language string, text string")
    found = dict(rows(translation.translate_lexicon(df, lexicon, ("text",)), "ingest_seq", "text_en"))
    assert [found[i] for i in range(7)] == ["la potato cuite", "apple-of pin of", "ab c ab", "bc b", "pomme", "", ""]
    assert found[7] == "x " * 3_000 + "ab" and found[90] == "a b" and found[91] == "terre"


def test_model_translation_falls_back(spark):
    def load(lang):
        def run(texts):
            if any("dort" in t for t in texts):
                raise ValueError("cannot")
            return [t.upper() for t in texts]

        return run

    found = translation.translate_with_model(posts(spark), load)
    assert rows(found, "ingest_seq", "title_en", "selftext_en") == [
        (1, "Le chat dort", ""), (2, "le chat", "x"), (3, "le", ""), (4, "", "LE"),
    ]


def test_normalize_keeps_duplicate_rows(spark):
    profile = language.train_language_profile(labelled(spark))
    lexicon = spark.createDataFrame(LEXICON, "lang string, src string, dst string")
    df = spark.createDataFrame([("a", 1, "le chat et le chien"), ("a", 2, "the dog")], "id string, ingest_seq bigint, title string")
    found = translation.normalize_language(df, profile, lexicon)
    assert rows(found, "ingest_seq", "detected_language", "title_en", "summary_en") == [
        (1, "fr", "the cat et the chien", ""), (2, "en", "the dog", ""),
    ]


def test_embedding_is_normed_and_hookable(spark):
    df = spark.createDataFrame([("guard injury",), ("guard injury",), ("other",), ("",), (None,)], "text_for_embedding string")
    idf = embedding.train_idf(df)
    found = [np.array(r.embedding) for r in embedding.embed_text(df, idf, dim=16).collect()]
    assert np.allclose(found[0], found[1]) and abs(np.linalg.norm(found[0]) - 1) < 1e-6
    assert not found[3].any() and not found[4].any()

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    hooked = embedding.embed_with_model(df.filter(F.col("text_for_embedding") != ""), load)
    assert sorted(r.embedding[0] for r in hooked.collect()) == [5.0, 12.0, 12.0]


def test_any_number_of_languages(spark, monkeypatch):
    texts = spark.createDataFrame([("le chat et le chien",), ("the dog",), ("",), (None,), ("zzz",)], "text string")
    profile = language.train_language_profile(labelled(spark))
    wanted = rows(language.detect_language(texts, profile, ["text"]))
    monkeypatch.setattr(language, "MATRIX_LANGUAGES", 1)
    assert rows(language.detect_language(texts, profile, ["text"])) == wanted


def test_profile_counts_whole_texts(spark):
    samples = spark.createDataFrame([("a" * 300 + "xyz", "en")], "text string, lang string")
    assert language.train_language_profile(samples).agg(F.sum("n")).first()[0] == 301


def test_trigrams_of_a_very_long_text(spark):
    """One text of a million characters, most of them of several bytes, is trained on whole."""
    text = "äöü😀 中文 " * 125_000
    profile = language.train_language_profile(spark.createDataFrame([(text, "xx"), ("ab", "yy")], "text string, lang string"))
    totals = {r["lang"]: r["n"] for r in profile.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"xx": 125_000 * 8 - 3, "yy": 1}
    grams = spark.createDataFrame([("ä😀b",), ("a",), ("",), (None,)], "t string").select(language.trigrams(F.col("t"), None).alias("g"))
    assert [r["g"] for r in grams.collect()] == [["ä😀b"], ["a"], [""], None]


def test_a_slice_asks_once_and_only_for_what_may_be_listed(spark):
    entries = spark.createDataFrame(
        [("fr", "pomme de", "apple", 2), ("fr", "de", "of", 1), ("de", "le chat", "never", 2)], "lang string, src string, dst string, length int"
    )
    texts = pa.array(["pomme de terre de pomme de", "", "le chat", "pomme", "de"])
    asked = translation._asked(translation._marked(entries), "fr", [1, 2], texts)
    assert sorted(asked.to_pylist()) == ["de", "pomme de"]


def test_repeated_and_null_keys_are_translated_as_one_text_and_not_at_all(spark):
    data = [(1, "fr", "le chat noir"), (1, "fr", "le chat"), (None, "fr", "le chat"), (2, "de", "le chat"), (3, "fr", "chat")]
    rows_ = spark.createDataFrame(data, "ingest_seq bigint, detected_language string, text string")
    entries = [("fr", "le chat", "the cat"), ("fr", "chat", None), ("fr", "noir", "black")]
    found = translation.translate_lexicon(rows_, spark.createDataFrame(entries, "lang string, src string, dst string"), ("text",))
    assert rows(found, "ingest_seq", "text_en") == [
        (1, "the cat chat chat black"), (1, "the cat chat chat black"), (2, "le chat"), (3, "chat"), (None, "le chat"),
    ]
