"""Language identification with hashed trigram profiles."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendspark.functions.text import blank, bound, clean_text, supported_language
from trendspark.functions.wordlists import SUPPORTED_LANGUAGES
from trendspark.session import materialize

# A profile has at most languages x BUCKETS rows, whatever the training text. Up to so many
# languages it is broadcast, 128 MB at most; beyond, texts and profile are joined.
BUCKETS = 65_536
MATRIX_LANGUAGES = 256
SLICE_ROWS = 256


def trigrams(text: Column, chars: int | None = 200) -> Column:
    """Trigrams of the first ``chars`` characters of a cleaned text, or of all."""

    def cut(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - 3)
        grams = F.transform(starts, lambda i: F.concat(*(F.get(letters, i + k) for k in range(3))))
        return F.when(F.size(letters) < 3, F.array(F.array_join(letters, ""))).otherwise(grams)

    # Split once: a position in a string is found by walking to it, one in an array is not.
    return bound(F.split(F.lower(text if chars is None else F.substring(text, 1, chars)), ""), cut)


def trigram_bucket(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 4), 16, 10).cast("int")


def train_language_profile(
    labelled: DataFrame, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Add-one smoothed log probability per language and seen bucket, counted over whole texts.

    ``floor_logp`` is the value of every bucket the language never showed.
    """
    cleaned = labelled.select(F.col(lang).alias("lang"), clean_text(F.col(text)).alias("text"))
    usable = cleaned.filter((F.col("text") != "") & F.col("lang").isNotNull())
    # Counted before they are hashed: there are few distinct trigrams.
    grams = (
        usable.select("lang", F.explode(trigrams(F.col("text"), None)).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = grams.groupBy("lang", trigram_bucket(F.col("gram")).alias("bucket")).agg(
        F.sum("n").alias("n")
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    denominator = F.col("total") + BUCKETS
    return counts.join(totals, "lang").select(
        "lang",
        "bucket",
        "n",
        F.log((F.col("n") + 1) / denominator).alias("logp"),
        F.log(1 / denominator).alias("floor_logp"),
    )


def _profile_matrix(profile: DataFrame, langs: list[str]) -> np.ndarray:
    rows = profile.select("lang", "bucket", "logp", "floor_logp").toPandas()
    matrix = np.empty((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        matrix[i] = own["floor_logp"].iloc[0]
        matrix[i, own["bucket"].to_numpy()] = own["logp"].to_numpy()
    return matrix


def head_buckets(text: Column, chars: int = 200) -> Column:
    """Trigram buckets of a cleaned text's head, all in the JVM."""
    return F.transform(trigrams(text, chars), trigram_bucket)


def _best_by_matrix(profile: DataFrame, langs: list[str], text: Column, chars: int) -> Column:
    shared = profile.sparkSession.sparkContext.broadcast((langs, _profile_matrix(profile, langs)))

    @F.pandas_udf(StringType())
    def best(heads: pd.Series) -> pd.Series:
        names, logp = shared.value
        bucket_of: dict[str, int] = {}

        def buckets(head: str) -> list[int]:
            found = []
            for i in range(max(len(head) - 2, 1)):
                gram = head[i : i + 3]
                if gram not in bucket_of:
                    bucket_of[gram] = int(md5(gram.encode()).hexdigest()[:4], 16)
                found.append(bucket_of[gram])
            return found

        language = pd.Series("en", index=heads.index, dtype="object")
        scored = heads[heads != ""]
        for start in range(0, len(scored), SLICE_ROWS):
            part = scored.iloc[start : start + SLICE_ROWS].map(buckets)
            edges = np.cumsum([0] + [len(b) for b in part.iloc[:-1]])
            sums = np.add.reduceat(logp[:, np.concatenate(list(part))], edges, axis=1)
            language.loc[part.index] = [names[i] for i in sums.round(9).argmax(axis=0)]
        return language

    return best(F.lower(F.substring(text, 1, chars)))


def _best_by_join(rows: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """``key, language`` by joins, for profiles of any number of languages."""
    floors = profile.select("lang", "floor_logp").distinct()
    counted = rows.select(key, F.explode("_buckets").alias("bucket")).groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = counted.groupBy(key).agg(F.sum("_n").alias("_total"))
    gained = counted.join(profile, "bucket").groupBy(key, "lang").agg(
        F.sum(F.col("_n") * (F.col("logp") - F.col("floor_logp"))).alias("_gain")
    )
    # A language that shares no bucket with a text has its floor alone: the best of these stands for all.
    best_floor = floors.orderBy(F.desc("floor_logp"), "lang").limit(1)
    base = totals.crossJoin(F.broadcast(best_floor)).select(key, "lang", F.lit(0.0).alias("_gain"))
    scored = (
        gained.unionByName(base)
        .groupBy(key, "lang").agg(F.max("_gain").alias("_gain"))
        .join(floors, "lang")
        .join(totals, key)
        .withColumn("_score", F.round(F.col("_gain") + F.col("_total") * F.col("floor_logp"), 9))
    )
    order = F.struct((-F.col("_score")).alias("s"), F.col("lang").alias("lang"))
    return scored.groupBy(key).agg(F.min(order)["lang"].alias("_language"))


def language_text(fields: list[str]) -> Column:
    """Cleaned fields joined by a blank, the text a language is read from."""
    return F.concat_ws(" ", *(clean_text(F.col(f)) for f in fields))


def detect_language(
    df: DataFrame, profile: DataFrame, fields: list[str], chars: int = 200, out: str = "language"
) -> DataFrame:
    """Language of each row by its cleaned fields; blank rows are English."""
    text = F.trim(language_text(fields))
    staged = df.withColumn("_joined", text)
    kept = materialize(profile)
    langs = sorted(r["lang"] for r in kept.select("lang").distinct().limit(MATRIX_LANGUAGES + 1).collect())
    if not langs:
        found = staged.withColumn(out, F.lit("en"))
    elif len(langs) <= MATRIX_LANGUAGES:
        found = staged.withColumn(out, _best_by_matrix(kept, langs, F.col("_joined"), chars))
    else:
        staged = materialize(staged.withColumn("_key", F.monotonically_increasing_id()))
        heads = staged.filter("_joined != ''").withColumn("_buckets", head_buckets(F.col("_joined"), chars))
        found = staged.join(_best_by_join(heads, kept, "_key"), "_key", "left")
        found = found.withColumn(out, F.coalesce("_language", F.lit("en"))).drop("_key", "_language")
    return found.drop("_joined")


def language_report(df: DataFrame, language: str = "language") -> DataFrame:
    """Rows per language that no translation covers."""
    code = F.col(language)
    unknown = df.filter(code.isNotNull() & ~code.isin("en", *SUPPORTED_LANGUAGES))
    return unknown.groupBy(code.alias("language")).agg(F.count(F.lit(1)).alias("n"))


def with_supported_language(df: DataFrame, language: str = "language") -> DataFrame:
    return df.withColumn("detected_language", supported_language(blank(F.col(language))))
