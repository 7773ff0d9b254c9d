"""Scalar text expressions. Everything but Unicode normalisation stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendspark.functions.wordlists import CATEGORY_KEYWORDS, GROUP_CATEGORY, SUPPORTED_LANGUAGES

# Java's and RE2's \w is ASCII-only, so the Unicode word class is spelled out.
WORD = r"[\p{L}\p{N}_]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda that names an outer expression computes it again for every element.
    """
    return F.transform(F.array(value), use)[0]


def _normalized(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    dropped = {
        ord(ch): None
        for ch in set(text)
        if ch not in "\n\t" and unicodedata.category(ch).startswith("C")
    }
    return text.translate(dropped) if dropped else text


@F.pandas_udf(StringType())
def _unicode_normalized(texts: pd.Series) -> pd.Series:
    return texts.map(_normalized, na_action="ignore")


def clean_text(text: Column) -> Column:
    """NFKC, control and format characters dropped, blanks squeezed; null gives ``""``.

    Only rows with a non-ASCII character travel to Python; its Unicode tables
    are newer than Java 17's, which would delete recent emoji as unassigned.
    """
    wide = text.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    kept = F.when(wide, _unicode_normalized(F.when(wide, text))).otherwise(plain)
    return F.coalesce(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(""))


def strip(text: Column) -> Column:
    """Trim all Unicode blanks, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unified_text(title: Column, body: Column) -> Column:
    """Title and body with a blank line between, kept when the body is missing."""
    return F.concat(blank(title), F.lit("\n\n"), blank(body))


def compose_text(
    source: str = "source",
    title: str = "title_en",
    selftext: str = "selftext_en",
    summary: str = "summary_en",
    text: str = "text_en",
) -> Column:
    """Text a post is embedded and summarised by, chosen by its source."""
    parts = {name: blank(F.col(name)) for name in (title, selftext, summary, text)}
    gap = F.lit("\n\n")
    return (
        F.when(F.col(source) == "reddit", strip(F.concat(parts[title], gap, parts[selftext])))
        .when(
            F.col(source) == "espn",
            strip(F.concat(parts[title], gap, parts[summary], gap, parts[text])),
        )
        .otherwise(parts[text])
    )


def infer_category(
    group: Column,
    title: Column,
    text: Column,
    groups: Mapping[str, str] = GROUP_CATEGORY,
    keywords: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS,
    default: str = "other",
) -> Column:
    """Category by known group name, then keyword in the group, then in title or text."""
    group, title, text = (F.lower(blank(c)) for c in (group, title, text))

    def mentions(where: Column, words: Sequence[str]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda word: F.contains(where, word))

    names_of: dict[str, list[str]] = {}
    for name, category in groups.items():
        names_of.setdefault(category, []).append(name)
    steps = [(group.isin(names), category) for category, names in names_of.items()]
    steps += [(mentions(group, words), category) for category, words in keywords.items()]
    steps += [
        (mentions(title, words) | mentions(text, words), category)
        for category, words in keywords.items()
    ]
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for test, category in steps:
        result = result.when(test, category)
    return result.otherwise(default)


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def words(text: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_text(text: Column) -> Column:
    """The tokens of ``words`` with blanks between, and maybe a blank before and after."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def word_text_ascii(text: Column) -> Column:
    """Lower-case text in which the tokens of ``words`` only have ASCII characters between.

    Latin letters are told from other characters in one look; only texts with others are replaced in.
    """
    lowered = F.lower(text)
    # Not the complement of the letters: Java takes many times as long to look for that.
    others = r"[\u0080-\u00BF\u00D7\u00F7\u0250-\x{10FFFF}]"
    return F.when(lowered.rlike(others), word_text(text)).otherwise(lowered)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def supported_language(language: Column) -> Column:
    return F.when(language.isin("en", *SUPPORTED_LANGUAGES), language).otherwise("unsupported")


def blank_tokens(text: Column) -> Column:
    """Blank-separated tokens; the empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda token: token != "")


def truncate_tokens(text: Column, n: int | Column) -> Column:
    """First ``n`` blank-separated tokens."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(blank_tokens(text), F.lit(1), n), " ")


def chunk_tokens(text: Column, size: int = 460, overlap: int = 50) -> Column:
    """Overlapping chunks covering all of a cleaned text; the empty text gives ``[""]``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be smaller than the chunk size")

    def cut(tokens: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(tokens) - F.lit(overlap + 1))
        starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
        return F.transform(
            starts, lambda start: F.array_join(F.slice(tokens, start + 1, F.lit(size)), " ")
        )

    return bound(blank_tokens(text), cut)


def popularity(score: Column, comments: Column) -> Column:
    """Score, or the comment count where the score is zero or missing."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(score, zero), F.nullif(comments, zero), zero).cast("bigint")


def shown_title(title_en: Column, title: Column) -> Column:
    """Translated title, else the original, else null."""
    return first_nonempty(title_en, title)
