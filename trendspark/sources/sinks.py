"""Writers. Everything large is written by the executors, partitioned by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.session import with_position

ASCII_JSON = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, UTF-8 unescaped, null keys kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_trend_lines(trends: DataFrame, path: str, mode: str = "error") -> None:
    """One trend per line, ASCII-escaped, largest first."""
    ordered = trends.withColumn("_smaller", -F.col("total_posts"))
    ordered = ordered.repartitionByRange("_smaller", "category", "cluster_id")
    ordered = ordered.sortWithinPartitions("_smaller", "category", "cluster_id").drop("_smaller")
    writer = ordered.write.mode(mode)
    for key, value in ASCII_JSON.items():
        writer = writer.option(key, value)
    writer.json(path)


def trend_document(trends: DataFrame) -> DataFrame:
    """The lines of one JSON array of all trends, largest first: ``pos, line``."""
    keyed = trends.withColumn("_smaller", -F.col("total_posts"))
    numbered = with_position(keyed, ["_smaller", "category", "cluster_id"])
    row = F.to_json(F.struct(*trends.columns), ASCII_JSON)
    opening = F.when(F.col("pos") == 0, "[").otherwise(",")
    end = trends.sparkSession.range(1).select(
        F.lit((1 << 63) - 1).alias("pos"), F.lit("]").alias("line")
    )
    begin = end.select(F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("line"))
    lines = numbered.select("pos", F.concat(opening, row).alias("line"))
    start = begin.join(trends.limit(1).select(F.lit(1).alias("_any")), how="left").select(
        "pos", F.when(F.col("_any").isNull(), "[").otherwise("").alias("line")
    )
    return start.unionByName(lines).unionByName(end)


def write_trends(trends: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON array in one file, as ``read_trends(multi_line=True)`` reads it.

    The file is written line by line, so its size is bounded by no task's memory; a table too
    large for one file goes to :func:`write_trend_lines`.
    """
    document = trend_document(trends).repartitionByRange(1, "pos").sortWithinPartitions("pos")
    document.select("line").write.mode(mode).text(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("category").parquet(path)


def write_topics(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("category").parquet(path)
