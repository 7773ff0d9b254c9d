"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted or deleted letter moves a word's vector of letter counts by 1 in L1 distance, a replaced
one by 2. So the words near a word are searched per pair of lengths: among words as long within a
distance of 2, among words a letter longer within 1, in k-d trees whose boxes that are farther off are
pruned. What is left is verified letter by letter.

A length with many words is parted by a tree of its own into cells; it only deals out the work, so it is
built from a bounded sample. A word is sent to every cell whose box it may reach. Cells are cut into
blocks of words, and the words that ask a cell into parts, by hash: a task holds one block and one
part, however many words share their letters. Pairs stay within a task; what leaves it is a number and
the best partner per word.

Defined results: null and empty texts have no words; words that occur too rarely or are too short are
not grouped; repeated rows count as often as they occur; ties go to the first word in code-point order;
columns beside key and text are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size
from trendspark.session import materialize

LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: Words of a block, and words that ask it at once; fewer where words are very long.
CELL, ASKING = 1 << 14, 1 << 16
LONG = 1 << 7
#: Sampled words per length for the tree that parts it, and its deepest level.
SAMPLE, DEEPEST = 1 << 16, 12
LEAF = 64
#: Distances that are held at once.
MATRIX = 1 << 20
#: Distinct words that a task counts before it hands them on.
WAITING = 300_000
SLICE_BYTES = 1 << 22

#: Letters a-z and U+00C0 to U+00FF by number.
DIMENSIONS = 26 + 64
_NUMBER = np.full(256, 255, np.uint8)
_NUMBER[ord("a"):ord("z") + 1] = np.arange(26)
_NUMBER[0xC0:0x100] = np.arange(26, DIMENSIONS)

NOBODY = np.iinfo(np.int64).max


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LETTERS,
    change: Callable[[object], Callable[[str], str]] | None = None,
) -> DataFrame:
    """``word, n``: maximal runs of letters of whole texts, A-Z in lower case, of at least ``least``
    letters. ``change(key)`` gives a function that may shorten a row's words."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in batches_by_size(iter([batch]), text, SLICE_BYTES):
                keys = part.column(key).to_pylist() if change else [None] * part.num_rows
                for name, data in zip(keys, as_bytes(part.column(text)), strict=True):
                    # Bytes lower A-Z only.
                    own = Counter(pattern.findall(data.lower().decode()))
                    if change:
                        changed = change(name)
                        for word, n in own.items():
                            counts[changed(word)] += n
                    else:
                        counts.update(own)
                if len(counts) > WAITING:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    partial = docs.select(key, text).mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") >= least)


def codes_of(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row per word."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _NUMBER[flat].reshape(len(words), -1)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """Letter counts, a row per word."""
    n, length = codes.shape
    cell = np.arange(n)[:, None] * DIMENSIONS + codes
    counts = np.bincount(cell.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return counts.astype(np.int16 if length < 16_000 else np.int32)


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """Dimension and bound that part vectors most evenly; nothing for equal vectors."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    best, found = 0, None
    for d in np.flatnonzero(low < high).tolist():
        middle = int(np.partition(vectors[:, d], len(vectors) // 2)[len(vectors) // 2])
        for bound in (middle - 1, middle):
            left = int((vectors[:, d] <= bound).sum())
            if min(left, len(vectors) - left) > best:
                best, found = min(left, len(vectors) - left), (d, bound)
    return found


class Cells:
    """A tree that parts the words of one length: splits by node, and leaves as cells."""

    def __init__(self, vectors: np.ndarray, deepest: int) -> None:
        self.splits: dict[int, tuple[int, int]] = {}
        waiting = [(1, vectors)]
        while waiting:
            node, own = waiting.pop()
            split = best_split(own) if len(own) > 1 and node < 1 << deepest else None
            if split:
                self.splits[node] = split
                right = own[:, split[0]] > split[1]
                waiting += [(2 * node, own[~right]), (2 * node + 1, own[right])]

    def reach(self, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a cell whose box is at most ``radius`` off; its own cell for 0."""
        rows, cells, by_letter = [], [], np.ascontiguousarray(vectors.T).astype(np.int32)
        most = np.iinfo(np.int32).max
        limits = np.full(len(by_letter), -1, np.int32), np.full(len(by_letter), most, np.int32)
        everyone = np.arange(len(vectors))
        waiting = [(1, everyone, np.zeros(len(vectors), np.int32), *limits)]

        def beyond(x: np.ndarray, low: int, high: int) -> np.ndarray:
            return np.maximum(low - x, 0) + np.maximum(x - high, 0)

        while waiting:
            node, own, off, low, high = waiting.pop()
            if node not in self.splits:
                rows.append(own)
                cells.append(np.full(len(own), node))
                continue
            d, bound = self.splits[node]
            x = by_letter[d, own]
            # A box differs from the one around it in one letter only.
            rest = off - beyond(x, low[d], high[d])
            below, above = high.copy(), low.copy()
            below[d], above[d] = min(high[d], bound), max(low[d], bound + 1)
            for child, least, greatest in ((2 * node, low, below), (2 * node + 1, above, high)):
                now = rest + beyond(x, least[d], greatest[d])
                near = np.flatnonzero(now <= radius)
                if len(near):
                    waiting.append((child, own[near], now[near], least, greatest))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows or empty), np.concatenate(cells or empty)


def block_words(length: int) -> int:
    """Words of a block; longer words are fewer."""
    return max(1, CELL * LONG // max(length, LONG))


def part_lengths(words: DataFrame) -> dict[int, Cells]:
    """A tree for each length that has more words than a block."""
    many = words.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).collect()
    if not many:
        return {}
    # So many of a million hash values are sampled per length.
    share = {r["length"]: max(1, min(1_000_000, SAMPLE * 1_000_000 // r["n"])) for r in many}
    shares = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    drawn = words.filter(F.col("length").isin(list(share))).filter(
        F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < shares[F.col("length")]
    )
    sampled: dict[int, list[str]] = {}
    for r in drawn.select("length", "word").collect():
        sampled.setdefault(r["length"], []).append(r["word"])
    return {
        length: Cells(
            vectors_of(codes_of(sorted(own))),
            min(DEEPEST, (next(r["n"] for r in many if r["length"] == length) // block_words(length)).bit_length()),
        )
        for length, own in sampled.items()
    }


def routed(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """Rows ``length, cell, asks, word, n``: every word as one of its cell, and as one that asks the
    cells of its length and of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                own = batch.take(pa.array(here))
                vectors = None
                for other, asks, radius in ((length, False, 0), (length, True, 2), (length + 1, True, 1)):
                    if other in trees:
                        if vectors is None:
                            vectors = vectors_of(codes_of(own.column("word").to_pylist()))
                        rows, cells = trees[other].reach(vectors, radius)
                    else:
                        rows, cells = np.arange(len(here)), np.ones(len(here), np.int64)
                    found = own.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), other), pa.int64()), pa.array(cells, pa.int64()),
                            pa.array([asks] * len(rows), pa.bool_()), found.column("word"), found.column("n"),
                        ],
                        names=["length", "cell", "asks", "word", "n"],
                    )

    return words.select("length", "word", "n").mapInArrow(run, "length bigint, cell bigint, asks boolean, word string, n bigint")


class Search:
    """Words of one block in a k-d tree, asked by words as long or a letter shorter.

    Letter counts lie by letter, so that boxes and distances are worked out for many words at a time.
    """

    def __init__(self, block: np.ndarray, asking: np.ndarray) -> None:
        self.block, self.asking = block, asking
        points, queries = vectors_of(block), vectors_of(asking)
        used = points.any(axis=0) | queries.any(axis=0)
        # Counts up to 63 and their distances fit eight bits.
        kind = np.int8 if block.shape[1] < 64 else points.dtype
        self.points, self.queries = (np.ascontiguousarray(v[:, used].T.astype(kind)) for v in (points, queries))
        self.radius = 2 if block.shape[1] == asking.shape[1] else 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (asking, block) rows one edit apart."""
        total = np.int16 if self.points.dtype == np.int8 else np.int64
        waiting = [(np.arange(self.points.shape[1]), self.points, np.arange(self.queries.shape[1]), self.queries)]
        while waiting:
            own, points, asking, queries = waiting.pop()
            low, high = points.min(axis=1), points.max(axis=1)
            off = np.abs(queries - np.clip(queries, low[:, None], high[:, None])).sum(axis=0, dtype=total)
            near = np.flatnonzero(off <= self.radius)
            if not len(near):
                continue
            asking, queries = asking[near], queries[:, near]
            split = best_split(points.T) if len(own) > LEAF else None
            if split:
                right = points[split[0]] > split[1]
                for side in (~right, right):
                    waiting.append((own[side], points[:, side], asking, queries))
                continue
            # Letters that all points have equally often add the same to all distances.
            varies, same = np.flatnonzero(low < high).tolist(), np.flatnonzero(low == high)
            base = np.abs(queries[same] - low[same, None]).sum(axis=0, dtype=queries.dtype)
            rows = max(1, MATRIX // len(own))
            for begin in range(0, len(asking), rows):
                part = slice(begin, begin + rows)
                far = np.repeat(base[part, None], len(own), axis=1)
                for d in varies:
                    step = queries[d, part, None] - points[d]
                    far += np.abs(step, out=step)
                one, other = np.nonzero(far == self.radius)
                yield from self._verified(asking[part][one], own[other])

    def _verified(self, one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = self.asking.shape[1]
        rows = max(1, 4 * MATRIX // length)
        for begin in range(0, len(one), rows):
            a, b = one[begin:begin + rows], other[begin:begin + rows]
            left, right = self.asking[a], self.block[b]
            if self.radius == 2:
                good = (left != right).sum(axis=1) == 1
            else:
                # The equal head and the equal tail cover the shorter word.
                head = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                good = head + tail >= length
            if good.any():
                yield a[good], b[good]


class Best:
    """Number of partners and the best of them for some words."""

    def __init__(self, words: list[str], partners: list[str], n: np.ndarray) -> None:
        self.words, self.partners, self.n = words, partners, n
        order = sorted(range(len(partners)), key=lambda i: (-n[i], partners[i]))
        self.order, self.rank = order, np.empty(len(partners), np.int64)
        self.rank[order] = np.arange(len(partners))
        self.many, self.best = np.zeros(len(words), np.int64), np.full(len(words), NOBODY)

    def add(self, word: np.ndarray, partner: np.ndarray) -> None:
        self.many += np.bincount(word, minlength=len(self.many))
        np.minimum.at(self.best, word, self.rank[partner])

    def table(self) -> pa.Table:
        met = np.flatnonzero(self.many)
        best = [self.order[r] for r in self.best[met].tolist()]
        return pa.table(
            {
                "word": pa.array([self.words[i] for i in met.tolist()], pa.string()),
                "n_near": pa.array(self.many[met], pa.int64()),
                "best_n": pa.array(self.n[best] if best else [], pa.int64()),
                "best": pa.array([self.partners[i] for i in best], pa.string()),
            }
        )


def search_block(table: pa.Table) -> pa.Table:
    """Rows ``word, n_near, best_n, best`` for the words of a block and those that ask it."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    asks = table.column("asks").to_numpy()
    length = table.column("length")[0].as_py()
    own = np.flatnonzero(~asks)
    sizes = np.array([len(w) for w in words])
    found = [Best([], [], np.zeros(0, np.int64)).table()]
    block = [words[i] for i in own.tolist()]
    for shorter in (0, 1):
        rows = np.flatnonzero(asks & (sizes == length - shorter))
        if not len(rows) or not block:
            continue
        asking = [words[i] for i in rows.tolist()]
        # Words as long ask each other; of words of different length only the shorter one asks.
        sides = [Best(asking, block, n[own])] + ([Best(block, asking, n[rows])] if shorter else [])
        for one, other in Search(codes_of(block), codes_of(asking)).pairs():
            sides[0].add(one, other)
            if shorter:
                sides[1].add(other, one)
        found += [s.table() for s in sides]
    return pa.concat_tables(found)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word with words one edit apart, from distinct ``word, n``."""
    spark: SparkSession = words.sparkSession
    words = words.withColumn("length", F.length("word").cast("bigint"))
    sent = materialize(routed(words, part_lengths(words)))
    size = F.lit(CELL * LONG) / F.greatest(F.col("length"), F.lit(LONG))
    counts = sent.groupBy("length", "cell").agg(F.count_if(~F.col("asks")).alias("own"), F.count_if("asks").alias("asking"))
    cut = counts.filter("own > 0 and asking > 0").select(
        "length", "cell",
        F.greatest(F.lit(1), F.ceil(F.col("own") / size)).cast("bigint").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("asking") / (size * (ASKING // CELL)))).cast("bigint").alias("parts"),
    )
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        min(100_000, cut.agg(F.sum(F.col("blocks") * F.col("parts")).alias("n")).first()["n"] or 0),
    )
    hashed, ask = F.xxhash64("word"), F.col("asks")

    def spread(own: Column, many: str) -> Column:
        """One of ``many`` for some rows, all of them for the others."""
        every = F.sequence(F.lit(0).cast("bigint"), F.col(many) - 1)
        return F.explode(F.when(own, F.array(F.pmod(hashed, F.col(many)))).otherwise(every))

    dealt = (
        sent.join(cut, ["length", "cell"])
        .withColumn("block", spread(~ask, "blocks"))
        .withColumn("part", spread(ask, "parts"))
        .drop("blocks", "parts")
        .repartition(tasks, "length", "cell", "block", "part")
    )
    met = dealt.groupBy("length", "cell", "block", "part").applyInArrow(
        search_block, "word string, n_near bigint, best_n bigint, best string"
    )
    order = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), order.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: forms followed to the end, twice as far each round."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = materialize(
            known.select("word", "root").join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        if known.filter("moved").isEmpty():
            return known.select("word", "root")


def group_variants(words: DataFrame, least: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct ``word, n`` with at least ``least``
    occurrences. A word's form is the most frequent word one edit apart if that is ``ratio`` times as
    frequent; its root is where forms end."""
    words = materialize(words.filter(F.col("n") >= least).select("word", "n"))
    best = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= F.col("n") * ratio
    known = materialize(
        best.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        )
    )
    roots = last_forms(known.filter("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
