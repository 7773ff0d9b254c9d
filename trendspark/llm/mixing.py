"""Mix sources to target weights: block quotas, a splitting tree over output shards, permuted blocks.

A source's texts in order of a hash are one stream of words, cut into blocks of equal size. Its target
says how many words the mix takes: whole passes over the stream, then a part of a pass, to the word.
In each pass a keyed permutation gives every block a slot, and slots are drawn in order, so the draws
of a pass are disjoint. The draws of all sources are dealt to output shards by a splitting tree: a node
halves its shards, and a multivariate hypergeometric draw says how many of each source's blocks go to
the left half, as if all blocks had been shuffled together; quotas stay exact at every node. A shard
then holds a stretch of each source's draws, and shuffles its own blocks.

The tree is walked in Spark, ``LEVELS`` levels a round, a node at a time; a node has a row per source.
Words of a source are counted along its stream by ranges of rows, so a hot source has many tasks.

Defined results: null, empty and blank texts have size 0 and nothing is taken from them; a null source
is a source of its own, the last one; repeated rows are rows of their own; without any words all
targets are 0; columns beside key, source and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes
from trendspark.llm.hashing import mix as mixed_bits
from trendspark.session import materialize, with_position

WEIGHTS, PERCENT, MOST, SEED = (3, 1, 2), 150, 2, 7
#: Words of a block; more where there would be over ``MOST_DRAWS`` blocks to draw.
BLOCK_WORDS, MOST_DRAWS = 1024, 500_000_000
#: Words of an output shard, about.
SHARD_WORDS = 1 << 24
#: Levels of the tree that one task walks below a node.
LEVELS = 6
#: Draws of a source that are looked up under one key at most.
LOOKED_UP = 4096

NODE = "node bigint, n_shards bigint, source_id bigint, first bigint, quota bigint"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST
) -> DataFrame:
    """Adds ``source_id`` and ``target`` to rows ``source, source_size``, one per source.

    Sources in order, null last, weigh ``weights`` in turn and share ``percent`` of all sizes. What a
    target has above ``most`` times its source's size is shared again by weight until none is above.
    """
    if percent > 100 * most:
        raise ValueError("targets cannot share more than `most` times all sizes")
    ranked = with_position(
        totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"], name="source_id"
    )
    weight = F.array(*map(F.lit, weights))[F.pmod("source_id", F.lit(len(weights))).cast("int")]
    ranked = materialize(ranked.drop("_last").withColumn("_weight", weight.cast("bigint")))
    limit = F.col("source_size") * most
    every = ranked.agg(F.sum("source_size").alias("n"), F.sum("_weight").alias("w")).first()
    if not every["n"]:
        return ranked.drop("_weight").withColumn("target", F.lit(0.0))
    left, share, stopped = every["n"] * percent / 100, every["w"], 0
    while True:
        level = left / share
        full = F.col("_weight") * F.lit(level) >= limit
        now = ranked.filter(full).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(limit).alias("n"), F.sum("_weight").alias("w")
        ).first()
        # The level only rises, so sources that are full stay full.
        if now["rows"] == stopped or now["w"] == every["w"]:
            break
        stopped = now["rows"]
        left, share = every["n"] * percent / 100 - now["n"], every["w"] - now["w"]
    return ranked.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.col("_weight") * level)).drop(
        "_weight"
    )


def quotas(sources: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """Adds how a source is drawn: ``full`` blocks and a ``tail`` of words in a pass, ``passes`` whole
    passes, then ``whole`` blocks and ``cut`` words of the next slot; ``quota`` draws in all."""
    size, full = F.col("source_size"), F.expr(f"source_size div {block}")
    wanted = F.least(F.round("target").cast("bigint"), size * most)
    some = size > 0
    return (
        sources.withColumn("_wanted", wanted)
        .withColumn("full", full)
        .withColumn("tail", size - F.col("full") * block)
        .withColumn("slots", F.col("full") + (F.col("tail") > 0).cast("bigint"))
        .withColumn("passes", F.when(some, F.expr("_wanted div source_size")).otherwise(0).cast("bigint"))
        .withColumn("_rest", F.col("_wanted") - F.col("passes") * size)
        .withColumn("whole", F.least(F.expr(f"_rest div {block}"), "full"))
        .withColumn("cut", F.col("_rest") - F.col("whole") * block)
        .withColumn("quota", F.col("passes") * F.col("slots") + F.col("whole") + (F.col("cut") > 0).cast("bigint"))
        .drop("_wanted", "_rest")
    )


def split(node: int, n_shards: int, quota: np.ndarray, seed: int) -> np.ndarray:
    """How many of each source's draws go to the left half of a node's shards."""
    draws = int(quota.sum()) * (n_shards // 2) // n_shards
    rng = np.random.Generator(np.random.PCG64([seed, node, n_shards]))
    return rng.multivariate_hypergeometric(quota, draws, method="marginals")


def walk(table: pd.DataFrame, seed: int, levels: int = LEVELS) -> pd.DataFrame:
    """The nodes ``levels`` below one, or its shards. A node is named by its first shard."""
    table = table.sort_values("source_id")
    waiting = [
        (int(table["node"].iloc[0]), int(table["n_shards"].iloc[0]), *(
            table[c].to_numpy(np.int64) for c in ("source_id", "first", "quota")
        ))
    ]
    for _ in range(levels):
        following = []
        for node, n, ids, first, quota in waiting:
            if n == 1:
                following.append((node, n, ids, first, quota))
                continue
            left = split(node, n, quota, seed)
            halves = ((node, n // 2, first, left), (node + n // 2, n - n // 2, first + left, quota - left))
            for begin, many, start, own in halves:
                some = own > 0
                if some.any():
                    following.append((begin, many, ids[some], start[some], own[some]))
        waiting = following
    return pd.concat(
        [
            pd.DataFrame({"node": node, "n_shards": n, "source_id": ids, "first": first, "quota": quota})
            for node, n, ids, first, quota in waiting
        ]
    )


def deal(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``source_id, shard, first, quota``: the stretch of a source's draws that each shard gets."""
    nodes = sources.filter("quota > 0").select(
        F.lit(0).cast("bigint").alias("node"), F.lit(shards).cast("bigint").alias("n_shards"), "source_id",
        F.lit(0).cast("bigint").alias("first"), "quota",
    )
    deep = 0
    while 1 << deep < shards:
        nodes = materialize(nodes.groupBy("node").applyInPandas(lambda t: walk(t, seed), NODE))
        deep += LEVELS
    return nodes.select("source_id", F.col("node").alias("shard"), "first", "quota")


def slot_of(block: np.ndarray, full: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of the blocks 0 to ``full - 1``: a Feistel network over the next even power of
    two, applied again to what falls outside."""
    block, full, key = (np.asarray(x).astype(np.uint64) for x in (block, full, key))
    bits = np.frexp(np.maximum(full, 2).astype(np.float64) - 1)[1]
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    found, todo = block.copy(), np.arange(len(block))
    while len(todo):
        left, right = found[todo] >> half[todo], found[todo] & mask[todo]
        for turn in range(4):
            noise = mixed_bits(mixed_bits(right + key[todo]) + np.uint64(turn + 1))
            left, right = right, left ^ (noise >> np.uint64(20) & mask[todo])
        found[todo] = left << half[todo] | right
        todo = todo[found[todo] >= full[todo]]
    return found.astype(np.int64)


def draw_pieces(rows: DataFrame, block: int, most: int, seed: int, with_text: bool) -> DataFrame:
    """Pieces of texts that are drawn: ``row, source_id, pass, draw, at, first_word, words``, and
    ``piece``; ``at`` is the place in the source's stream."""
    columns = ["row", "source_id", "size", "begin", "full", "slots", "passes", "whole", "cut"]
    schema = "row bigint, source_id bigint, pass bigint, draw bigint, at bigint, first_word bigint, words bigint"
    schema += ", piece string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in columns}
            low, high = own["begin"] // block, (own["begin"] + own["size"] - 1) // block
            many = np.where(own["size"] > 0, high - low + 1, 0)
            at = np.repeat(np.arange(len(many)), many)
            number = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            here = {c: values[at] for c, values in own.items()}
            start = np.maximum(number * block, here["begin"])
            stop = np.minimum((number + 1) * block, here["begin"] + here["size"])
            for turn in range(most):
                key = mixed_bits(here["source_id"].astype(np.uint64) * np.uint64(most + 1) + np.uint64(turn + (seed << 32)))
                inner, slot = number < here["full"], here["full"].copy()
                slot[inner] = slot_of(number[inner], here["full"][inner], key[inner])
                last = (turn == here["passes"]) & (slot == here["whole"])
                drawn = (turn < here["passes"]) | (turn == here["passes"]) & (slot < here["whole"]) | last
                end = np.where(last, np.minimum(stop, number * block + here["cut"]), stop)
                some = np.flatnonzero(drawn & (end > start))
                if not len(some):
                    continue
                first, words = (start - here["begin"])[some], (end - start)[some]
                arrays = [
                    here["row"][some], here["source_id"][some], np.full(len(some), turn),
                    (turn * here["slots"] + slot)[some], start[some], first, words,
                ]
                arrays = [pa.array(a, pa.int64()) for a in arrays]
                if with_text:
                    texts, split_of = as_bytes(batch.column("text")), {}
                    pieces = []
                    for i, a, n in zip(at[some].tolist(), first.tolist(), words.tolist(), strict=True):
                        if i not in split_of:
                            split_of = {i: texts[i].split()}
                        pieces.append(b" ".join(split_of[i][a:a + n]))
                    arrays.append(pa.array(pieces, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return rows.select(*columns, *(["text"] if with_text else [])).mapInArrow(run, schema)


def _along_stream(rows: DataFrame) -> DataFrame:
    """Adds ``begin``, the words of a source before a row; by ranges of rows, none for a whole source."""
    order = ["_hash", "row"]
    ranged = materialize(
        rows.repartitionByRange("source", *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("source", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("source", "_part").agg(F.sum("size").alias("_size")).select(
        F.col("source").alias("_source"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )
    own = ranged.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = own.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("begin", F.col("_inside") + F.col("_before")).select(*rows.columns, "begin")


class Mix:
    """A mix of ``docs``, worked out once: ``sources``, ``rows`` and the drawn ``pieces``."""

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        source: str = "source",
        text: str = "text",
        weights: Sequence[int] = WEIGHTS,
        percent: int = PERCENT,
        most: int = MOST,
        shards: int | None = None,
        seed: int = SEED,
        with_text: bool = False,
    ) -> None:
        chosen = [F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")]
        # Rows in an order that does not depend on how they are read.
        chosen.append(F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_hash"))
        chosen += [F.col(text).alias("text")] if with_text else []
        # Written, so that a row keeps its number.
        self.rows = materialize(docs.select(*chosen, F.monotonically_increasing_id().alias("row")))
        totals = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        aimed = materialize(targets(totals, weights, percent, most))
        words = aimed.agg(F.sum("target").alias("n")).first()["n"] or 0
        self.block = max(BLOCK_WORDS, -int(-words // MOST_DRAWS))
        self.sources = materialize(quotas(aimed, self.block, most))
        self.shards = shards or max(1, -int(-words // SHARD_WORDS))
        self.dealt = deal(self.sources, self.shards, seed)
        placed = _along_stream(self.rows.select("row", "source", "size", "_hash")).drop("_hash")
        drawn = self.sources.withColumnRenamed("source", "_source")
        placed = placed.join(drawn, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        if with_text:
            placed = placed.join(self.rows.select("row", "text"), "row")
        self.pieces = self._with_shard(draw_pieces(placed, self.block, most, seed, with_text), seed)

    def _with_shard(self, pieces: DataFrame, seed: int) -> DataFrame:
        """Adds ``shard`` and the order in it. A source's draws are looked up by short stretches."""
        span = F.least(F.lit(LOOKED_UP), F.greatest(F.lit(1), F.ceil(F.col("total") / self.shards))).cast("bigint")
        spans = self.sources.select("source_id", F.col("quota").alias("total")).withColumn("span", span)
        spans = spans.select("source_id", "span")
        reach = F.expr("explode(sequence(first div span, (first + quota - 1) div span))")
        dealt = self.dealt.join(spans, "source_id").withColumn("stretch", reach).drop("span")
        asked = pieces.join(spans, "source_id").withColumn("stretch", F.expr("draw div span")).drop("span")
        met = asked.join(dealt, ["source_id", "stretch"]).filter("draw >= first and draw < first + quota")
        shuffled = Window.partitionBy("shard").orderBy(
            F.xxhash64(F.lit(seed), "source_id", "draw"), "source_id", "draw", "at"
        )
        return met.drop("stretch", "first", "quota").withColumn("place", F.row_number().over(shuffled))

    def taken(self) -> DataFrame:
        """``key, size, source_size, target, taken`` of every row."""
        drawn = self.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
        aims = self.sources.select(F.col("source").alias("_source"), "source_size", "target")
        return (
            self.rows.select("row", "key", "source", "size").join(drawn, "row", "left")
            .join(aims, F.col("source").eqNullSafe(F.col("_source")))
            .select("key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
        )

    def write_shards(self, path: str) -> None:
        """The shuffled pieces, a folder per shard; needs ``with_text``."""
        keys = self.rows.select("row", "key", "source")
        ready = self.pieces.join(keys, "row").select("shard", "place", "source", "key", "pass", "first_word", "words", "piece")
        ready.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
