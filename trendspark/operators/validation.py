"""Data-quality checks over JSON lines."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import with_position
from trendspark.sources.landing import scan_order

# Fields each source has to carry.
POST_FIELDS = (
    "id", "source", "subreddit", "author", "title", "text", "score", "num_comments",
    "url", "created_utc", "category",
)
ARTICLE_FIELDS = ("id", "source", "category", "title", "summary", "text", "link", "published")
RAW_CONTRACT = {"reddit": POST_FIELDS, "espn": ARTICLE_FIELDS}
NORMALIZED_COMMON = ("id", "source", "detected_language")
NORMALIZED_CONTRACT = {
    "reddit": ("title_en", "selftext_en", "text_en"),
    "espn": ("title_en", "summary_en", "text_en"),
}

PARSED = "error string, fields array<string>, id string, source string"


def _parse(line: str | None, id_field: str) -> tuple:
    try:
        value = json.loads(line if line is not None else "")
    except (ValueError, RecursionError) as error:
        return str(error), None, None, None
    if not isinstance(value, dict):
        return "not a JSON object", None, None, None
    key, source = value.get(id_field), value.get("source")
    return (
        None,
        list(value),
        None if key is None else json.dumps(key, sort_keys=True),
        source if isinstance(source, str) else None,
    )


def parse_lines(line: Column, id_field: str = "id") -> Column:
    """Strict JSON check of a text column; Spark's JSON functions accept trailing text."""

    @F.pandas_udf(PARSED)
    def parse(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_parse(text, id_field) for text in lines], columns=["error", "fields", "id", "source"]
        )

    return parse(line)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` with 1-based line numbers per file."""
    text = scan_order(spark.read.text(path))
    numbered = with_position(text, ["_block", "_row"], keys=["_file"], name="line")
    return numbered.select(F.col("_file").alias("file"), (F.col("line") + 1).alias("line"), "value")


def parsed_lines(lines: DataFrame, id_field: str = "id") -> DataFrame:
    keys = [c for c in lines.columns if c != "value"]
    return lines.select(*keys, parse_lines(F.col("value"), id_field).alias("p")).select(*keys, "p.*")


def json_errors(parsed: DataFrame, keys: Sequence[str] = ("line",)) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select(
        *keys, F.lit("json").alias("rule"), F.col("error").alias("detail")
    )


def missing_fields(
    parsed: DataFrame, required: Sequence[str] | Column, keys: Sequence[str] = ("line",)
) -> DataFrame:
    """Required fields that are absent; a null value counts as present."""
    wanted = required if isinstance(required, Column) else F.array(*map(F.lit, required))
    return parsed.filter(F.col("fields").isNotNull()).select(
        *keys,
        F.lit("missing").alias("rule"),
        F.explode(F.array_except(wanted, "fields")).alias("detail"),
    )


def duplicate_ids(
    parsed: DataFrame, keys: Sequence[str] = ("line",), scope: Sequence[str] = ()
) -> DataFrame:
    """Every line after the first with the same id; absent ids are one id.

    First lines come from a map-side aggregate and are then removed by line number,
    which is unique, so no task ever holds all lines of a hot id.
    """
    readable = parsed.filter(F.col("fields").isNotNull())
    order = [k for k in keys if k not in scope]
    first = readable.groupBy(*scope, "id").agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(*scope, "_first.*")
    return readable.join(first, list(keys), "left_anti").select(
        *keys, F.lit("duplicate").alias("rule"), F.coalesce("id", F.lit("null")).alias("detail")
    )


def validate_mixed(
    parsed: DataFrame,
    contracts: Mapping[str, Sequence[str]] = RAW_CONTRACT,
    common: Sequence[str] = (),
    keys: Sequence[str] = ("line",),
) -> DataFrame:
    """Missing fields by source, and lines whose source has no contract."""
    source = F.lower(F.coalesce("source", F.lit("")))
    wanted = F.when(F.lit(False), F.array(F.lit("")))
    for name, fields in contracts.items():
        wanted = wanted.when(source == name, F.array(*map(F.lit, [*common, *fields])))
    default = F.array(*map(F.lit, common)) if common else F.array().cast("array<string>")
    missing = missing_fields(parsed, wanted.otherwise(default), keys)
    unknown = parsed.filter(F.col("fields").isNotNull() & ~source.isin(list(contracts))).select(
        *keys, F.lit("unknown_source").alias("rule"), source.alias("detail")
    )
    return missing.unionByName(unknown)


def validation_report(
    parsed: DataFrame,
    contracts: Mapping[str, Sequence[str]] = RAW_CONTRACT,
    common: Sequence[str] = (),
    keys: Sequence[str] = ("line",),
    scope: Sequence[str] = (),
) -> DataFrame:
    """All findings as ``keys, rule, detail``; findings never raise."""
    return (
        json_errors(parsed, keys)
        .unionByName(validate_mixed(parsed, contracts, common, keys))
        .unionByName(duplicate_ids(parsed, keys, scope))
    )


def report_summary(parsed: DataFrame, report: DataFrame, fail: bool = False) -> DataFrame:
    """Lines checked and findings per rule; ``fail`` raises when there is any finding."""
    if fail and not report.isEmpty():
        raise ValueError("validation found errors")
    lines = parsed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("rule"), "n")
    return lines.unionByName(report.groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
