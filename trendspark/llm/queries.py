"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import remainder, table

#: The rules of the url query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.decontaminate import decontaminate, with_digest

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return with_digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm import warc

    records = warc.page_records(table(spark, sf_dir, "pages"))
    manifest = warc.write_archives(records, warc.new_folder(spark))
    found = warc.read_archives(manifest, with_payload=False)

    def page(column: str):
        return F.expr(f"try_cast(substring({column}, {len(warc.ID) + 1}) AS bigint)")

    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.quality_classifier import classify

    scored = classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1
    )
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trendspark.llm.bpe import round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.substring_dedup import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.quality_rules import BASE, judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.jaccard_join import components

    return components(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def planted_repeats(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the ids, the tail replaced by repeats of its first words."""
    import zlib

    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.periodic_runs import find_runs, with_digest

    return with_digest(find_runs(table(spark, sf_dir, "documents"), change=planted_repeats))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.mixing import Mix

    return Mix(table(spark, sf_dir, "documents")).taken().withColumnRenamed("key", "doc_id")


def dropped_letters(doc_id: object) -> Callable[[str], str]:
    """A letter goes from one in 31 of a document's words."""
    import zlib

    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        at = h % len(word)
        return word if h % 31 else word[:at] + word[at + 1:]

    return change


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendspark.llm.spelling_variants import group_variants, word_counts

    return group_variants(word_counts(table(spark, sf_dir, "documents"), change=dropped_letters))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_mixing": op12_mixing,
    "op13_spelling_variants": op13_spelling_variants,
}
