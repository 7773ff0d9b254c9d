"""URL rules by a sort-merge range join.

A rule names a host, with all its subdomains, and a path prefix. Under reversed host labels every
host rule is a prefix, and so an interval of the sorted keys; path prefixes are intervals below
their host. One sweep over the sorted keys of rules and points keeps the stack of rules that are
still open: first over hosts, then over the paths below each open host. Only DataFrame functions.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; of equal
rules ``block`` wins; of several rules that fit, the longest ``host + path``; where none fits, the
default verdict. Repeated rows and extra columns stay as they are, but for columns named ``host``,
``path``, ``rule`` or ``verdict``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import free
from trendspark.session import materialize

#: Sorted keys in one step of the sweep.
BLOCK_ROWS = 1024

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return pages.withColumns(
        {
            "host": F.translate(host, ASCII_UPPER, ASCII_LOWER),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot: subdomains start with their parent's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def open_intervals(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Every key of ``points`` with the stack of ``prefixes`` it starts with, outermost first.

    Both frames have one string column ``key`` of distinct values. The sorted union is cut into
    blocks of bounded size; the stack open at a block's first key is looked up by that key's own
    prefixes of the length of any of ``prefixes``, so blocks are swept independently. A stack is as
    deep as its key is long at most.
    """
    events = points.select("key", F.lit(False).alias("is_rule")).unionByName(
        prefixes.select("key", F.lit(True).alias("is_rule"))
    )
    # A rule sorts before a point of the same key.
    ordered = events.withColumn("_rank", F.when(F.col("is_rule"), 0).otherwise(1))
    ordered = ordered.repartitionByRange("key", "_rank").sortWithinPartitions("key", "_rank")
    row = F.monotonically_increasing_id()
    blocks = materialize(
        ordered.withColumn("_row", row)
        .withColumn("block", F.expr(f"_row div {BLOCK_ROWS}"))
        .groupBy("block")
        .agg(
            F.min("key").alias("first_key"),
            F.sort_array(F.collect_list(F.struct("key", "_rank"))).alias("events"),
        )
    )
    # Only lengths that a rule has: a long first key is not cut at each of its characters.
    lengths = prefixes.select(F.length("key").alias("_length")).filter("_length > 0").distinct()
    before = (
        blocks.select("block", "first_key")
        .join(F.broadcast(lengths), F.length("first_key") >= F.col("_length"))
        .select("block", F.expr("substring(first_key, 1, _length)").alias("key"))
        .join(prefixes.select("key"), "key")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list("key")).alias("open"))
    )

    def step(state: Column, event: Column) -> Column:
        still = F.filter(state["open"], lambda prefix: F.startswith(event["key"], prefix))
        found = F.struct(event["key"].alias("key"), still.alias("open"))
        is_rule = event["_rank"] == 0
        return F.struct(
            F.when(is_rule, F.array_union(still, F.array(event["key"]))).otherwise(still).alias("open"),
            F.when(is_rule | (F.size(still) == 0), state["found"])
            .otherwise(F.concat(state["found"], F.array(found)))
            .alias("found"),
        )

    none = F.expr("CAST(array() AS array<string>)")
    start = F.struct(
        F.coalesce(F.col("open"), none).alias("open"),
        F.expr("CAST(array() AS array<struct<key:string,open:array<string>>>)").alias("found"),
    )
    swept = blocks.join(before, "block", "left").select(
        F.aggregate("events", start, step, lambda state: state["found"]).alias("found")
    )
    return swept.select(F.explode("found").alias("_hit")).select("_hit.key", "_hit.open")


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``, the path from its slash on.
    """
    parted = with_url_parts(pages, url)
    (found,) = free(parted, "_best")
    rules = (
        rules.filter(F.col("host").isNotNull())
        .select(
            F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            "action",
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))  # block sorts after allow
        .withColumn("host_key", host_key(F.col("rule_host")))
        .withColumn("key", F.concat("host_key", "rule_path"))
    )
    urls = parted.select("host", "path").distinct()
    hosts = urls.select(host_key(F.col("host")).alias("key")).distinct()
    open_hosts = open_intervals(hosts, rules.select(F.col("host_key").alias("key")).distinct())
    below = (
        urls.withColumn("key", host_key(F.col("host")))
        .join(open_hosts, "key")
        .select("host", "path", F.explode("open").alias("host_key"))
        .withColumn("key", F.concat("host_key", "path"))
    )
    below = materialize(below)
    open_paths = open_intervals(below.select("key").distinct(), rules.select("key"))
    # The stack may hold rules of other hosts only if a path looks like one: the host has to match.
    fitting = (
        below.join(open_paths, "key")
        .select("host", "path", "host_key", F.explode("open").alias("key"))
        .join(rules.select("host_key", "key", "rule_host", "rule_path", "action"), ["host_key", "key"])
    )
    rule = F.concat("rule_host", "rule_path")
    best = fitting.groupBy("host", "path").agg(
        F.max_by(F.struct(rule.alias("rule"), "action"), F.struct(F.length(rule), rule)).alias(found)
    )
    return (
        parted.join(best, ["host", "path"], "left")
        .withColumn("rule", F.col(f"{found}.rule"))
        .withColumn("verdict", F.coalesce(F.col(f"{found}.action"), F.lit(default)))
        .drop(found)
    )
