import random

import pytest
from conftest import rows

from trendspark.functions.wordlists import stopwords
from trendspark.operators import topics


@pytest.fixture(scope="module")
def posts(spark):
    """Words of falling frequency in two categories, odd ones among them, and null keys and texts."""
    draw = random.Random(5)
    words = ["Guard", "injury", "ÉCOLE", "a", "the", "x2", "snake_case", "日本", "İx", *(f"w{i}" for i in range(200))]
    text = lambda: "".join(draw.choice(words[: draw.choice((8, 30, 209))]) + draw.choice((" ", ", ", "\n")) for _ in range(40))
    data = [(draw.choice("cd"), draw.choice((0, 1, -1, None)), text()) for _ in range(60)]
    data += [(None, 1, "lost words"), ("c", 0, None), ("e", 0, "one two one"), ("f", 3, "")]
    return spark.createDataFrame(data, "category string, topic int, text string")


@pytest.mark.parametrize("ngrams, size", [((1, 2), 20), ((1, 3), 30), ((1, 1), 5), ((1, 2), 1000)])
def test_vocabulary_is_counted_without_all_other_terms(posts, monkeypatch, ngrams, size):
    every = topics.term_counts(posts, "text", ngrams)
    chosen = topics.vocabulary(every, size)
    monkeypatch.setattr(topics, "COUNTED", 50)
    # Counting every term of every topic is no longer part of the way.
    monkeypatch.setattr(topics, "term_counts", None)
    found = topics.vocabulary_counts(posts, "text", ngrams, stopwords(), size)
    of = ["category", "topic", "term", "n"]
    assert rows(found, *of) == rows(every.join(chosen, ["category", "term"]), *of)
    # Rows without category have no weights.
    assert rows(topics.vocabulary(found, size)) == rows(chosen.filter("category IS NOT NULL"))


def test_many_ties_are_counted_as_before(posts, monkeypatch):
    monkeypatch.setattr(topics, "ASKED", 3)
    found = topics.vocabulary_counts(posts, "text", (1, 2), stopwords(), 20)
    assert rows(found) == rows(topics.term_counts(posts, "text", (1, 2), stopwords()))


def test_rare_ngrams_of_frequent_words_do_not_travel(spark):
    """Each pair but one occurs once; the vocabulary asks for ten, and a task holds all texts."""
    text = " ".join(["aa bb"] * 10 + ["cc aa cc bb dd cc"])
    texts = spark.createDataFrame([("c", 0, text)], "category string, topic int, words string").coalesce(1)
    words = {"c": ["aa", "bb", "cc", "dd"]}
    found = topics._longer(texts, (1, 2), [], words, {"c": (10, 26)})
    assert rows(found, "term", "n") == [("aa bb", 10)]
    every = topics._longer(texts, (1, 2), [], words, None)
    assert ("bb aa", 9) in rows(every, "term", "n") and ("dd cc", 1) in rows(every, "term", "n")


def test_texts_are_coded_once_and_odd_characters_part_words_as_before(spark, monkeypatch):
    """All passes over the posts read slices in which every distinct word of a slice stands once."""
    odd = ["one×two÷two", "µm ªa º² x", "ÀÉ straße İstanbul", "naïve—dash 日本語、日本語", "٣٤ ab́c", "the a  b!!cc cc", "", None]
    posts = spark.createDataFrame([("c", i % 2, t) for i, t in enumerate(odd * 3)], "category string, topic int, text string")
    made, coded = [], topics._coded
    monkeypatch.setattr(topics, "_coded", lambda *args: made.append(coded(*args)) or made[-1])
    found = topics.vocabulary_counts(posts, "text", (1, 2), stopwords(), 1000)
    of = ["category", "topic", "term", "n"]
    assert rows(found, *of) == rows(topics.term_counts(posts, "text", (1, 2), stopwords()), *of)
    assert len(made) == 1
    for terms in (row["terms"].split(" ") for row in made[0].collect()):
        assert len(set(terms)) == len(terms) and not {"the", "a", ""} & set(terms)
