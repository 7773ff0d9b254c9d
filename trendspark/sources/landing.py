"""Readers of landed files: forum posts, feeds, JSON lines and trend documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendspark.functions.text import first_nonempty, infer_category, unified_text
from trendspark.schemas import RAW_ITEM, RAW_POST, TREND
from trendspark.session import top_per_group, with_position

# Folder of a feed -> category as the feed table spells it.
FEED_CATEGORY = {"nba": "NBA", "soccer": "Soccer"}

SCAN_ORDER = ("_file", "_block", "_row")


def scan_order(df: DataFrame) -> DataFrame:
    """Columns that order the rows of a file scan as the files hold them."""
    return df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id(),
        }
    )


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Rows of JSON lines; a line that is no object of the schema fails the read."""
    return scan_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def split_jsonl(
    spark: SparkSession, path: str | list[str], schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the broken lines as ``line`` with their place, for reads that must go on."""
    marked = StructType([*schema.fields, StructField("_broken", StringType())])
    lines = scan_order(spark.read.text(path)).filter(F.trim("value") != "")
    parsed = F.from_json("value", marked, {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.withColumn("_parsed", parsed)
    good = rows.filter("_parsed._broken IS NULL").select("_parsed.*", *SCAN_ORDER).drop("_broken")
    return good, rows.filter("_parsed._broken IS NOT NULL").select(F.col("value").alias("line"), *SCAN_ORDER)


def read_trends(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Trend rows, from one array or object per line; empty when the path is absent.

    ``multi_line`` reads a file that holds one indented array.
    """
    try:
        return spark.read.schema(TREND).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], TREND)


def latest_per_group(
    df: DataFrame, n: int, group: str = "subreddit", time: str = "created_utc", id: str = "id"
) -> DataFrame:
    """Newest ``n`` rows per group, ties by id."""
    return top_per_group(df, [group], [F.col(time).desc(), F.col(id)], n).drop("rank")


def drop_pinned(df: DataFrame, pinned: str = "stickied") -> DataFrame:
    return df.filter(~F.coalesce(F.col(pinned), F.lit(False)))


def shape_posts(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw post dump to the post schema; the newest-N limit counts pinned posts too."""
    recent = latest_per_group(raw, limit) if limit is not None else raw
    text = unified_text(F.col("title"), F.col("selftext"))
    extra = [c for c in SCAN_ORDER if c in raw.columns]
    return drop_pinned(recent).select(
        "id",
        F.lit("reddit").alias("source"),
        "subreddit",
        F.col("author.name").alias("author"),
        "title",
        "selftext",
        text.alias("text"),
        "score",
        "num_comments",
        "url",
        "created_utc",
        infer_category(F.col("subreddit"), F.col("title"), text).alias("category"),
        *extra,
    )


def read_posts(
    spark: SparkSession, path: str | list[str], limit: int | None = None
) -> DataFrame:
    return shape_posts(read_jsonl(spark, path, RAW_POST), limit)


def feed_category(path: Column, feeds: Mapping[str, str], parity: bool) -> Column:
    """Category of a feed by the folder or file name it landed under."""
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, category in feeds.items():
        label = category if parity else category.lower()
        result = result.when(F.lower(path).rlike(rf"(^|[/_.=-]){name.lower()}([/_.-]|$)"), label)
    return result


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    feeds: Mapping[str, str] = FEED_CATEGORY,
    parity: bool = False,
) -> DataFrame:
    """Landed feed XML as articles; absent elements become ``""``.

    The category is lower-cased so that articles meet the posts of their category;
    ``parity`` keeps the feed table's spelling.
    """
    reader = spark.read.format("xml").option("rowTag", "item").schema(RAW_ITEM)
    paths = path if isinstance(path, list) else [path]
    items = scan_order(reader.load(paths))
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    return items.select(
        F.coalesce(first_nonempty(F.col("guid")), F.col("link")).alias("id"),
        F.lit("espn").alias("source"),
        feed_category(F.col("_file"), feeds, parity).alias("category"),
        title.alias("title"),
        summary.alias("summary"),
        unified_text(title, summary).alias("text"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("pubDate", F.lit("")).alias("published"),
        *SCAN_ORDER,
    )


def combine_sources(
    *frames: DataFrame, order: Sequence[str] = SCAN_ORDER, name: str = "ingest_seq"
) -> DataFrame:
    """All rows of all sources, first source first, with a dense row number.

    Columns a source lacks are null. ``order`` orders the rows inside a source.
    """
    ranked = [df.withColumn("_rank", F.lit(rank)) for rank, df in enumerate(frames)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    numbered = with_position(union, ["_rank", *order], name=name)
    return numbered.drop("_rank", *SCAN_ORDER)
