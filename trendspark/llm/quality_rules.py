"""Quality rules: an isolation forest over rule statistics, its threshold set from labelled rows.

Statistics are counted over whole texts. The forest's trees split a pool of rows, bounded as the
method asks and chosen by hash over the whole table; path lengths of every row then give its anomaly
score, and labelled rows of the whole table the threshold.

Defined results: null and empty texts have no words and fail the base rule; equal rows score alike;
without labelled good rows the forest rejects nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size
from trendspark.session import materialize

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_bare")
#: Rows that trees are drawn from, trees, rows of a tree: few, so that groups of like anomalies do not hide each other.
POOL, TREES, TREE_ROWS = 8192, 256, 16
#: Share of labelled good rows that the forest may reject.
MAX_GOOD_REJECTED = 0.005
SCORE_STEPS = 10_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) > len(words) - window:
        return 0  # too few repeated words for a repeated window
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    rolling = np.zeros(n, np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    if len(np.unique(rolling)) == n:
        return 0
    # Exact classes of windows by doubling: of 2, 4 and 8 words.
    ranks, width = codes, 1
    while width < window:
        pairs = ranks[:-width] * (len(words) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def count(data: bytes) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    words = data.split()
    text = data.decode()
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    chars = len(text) - sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lower, upper = text.lower(), text.upper()
    cased = sum(map(str.__ne__, lower, upper)) if len(lower) == len(upper) else len(lower)
    n_upper = sum(map(str.__ne__, lower, text)) if len(lower) == len(text) else 0
    return (
        len(words), chars, sum(data.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))),
        sum(lines.values()) - len(lines), repeated(words),
        sum(lines.values()), n_upper, cased, data.count(b"!"), len(set(words)),
        sum(1 for line in lines if not line.rstrip().endswith((b".", b"!", b"?", b'"', b":"))),
    )


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, text, 1 << 23):
            columns = zip(*map(count, as_bytes(batch.column(text))), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c, pa.int64()) for c in columns)], names=[key, *BASE, *MORE]
            )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in (*BASE, *MORE))
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {counts}")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on a text's length, but for the first."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines = np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, np.log1p(100 * c["n_symbols"] / chars),
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / np.maximum(c["n_letters"], 1),
            np.log1p(100 * c["n_marks"] / chars), np.log(c["n_distinct"] / words + 1e-3) + 0.15 * np.log(words),
            c["n_bare"] / lines,
        ],
        axis=1,
    ).astype(np.float64)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: a node splits ``feature < value`` into children, or ends with a length."""

    def __init__(self, rows: np.ndarray, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        size = min(TREE_ROWS, len(rows))
        self.norm = max(float(_average_path(size)), 1e-9)
        self.trees = []
        for _ in range(TREES if size > 1 else 0):
            picked = rows[random.choice(len(rows), size, replace=False)]
            self.trees.append(self._grow(picked, random, math.ceil(math.log2(size))))

    @staticmethod
    def _grow(rows: np.ndarray, random: np.random.Generator, depth: int):
        feature, value, left, length = [], [], [], []

        def add() -> int:
            for column in (feature, value, left, length):
                column.append(0)
            return len(feature) - 1

        todo = [(add(), rows, 0)]
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level >= depth or len(wide) == 0:
                left[node], length[node] = -1, level + float(_average_path(len(part)))
                continue
            feature[node] = int(random.choice(wide))
            value[node] = random.uniform(low[feature[node]], high[feature[node]])
            goes_left = part[:, feature[node]] < value[node]
            left[node], right = add(), add()
            todo += [(left[node], part[goes_left], level + 1), (right, part[~goes_left], level + 1)]
            if not goes_left.any() or goes_left.all():
                todo = todo[:-2]
                left[node], length[node] = -1, level + float(_average_path(len(part)))
        return np.array(feature), np.array(value), np.array(left), np.array(length, np.float64), depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1."""
        if not self.trees:
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, length, depth in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                child = left[node]
                step = child + (rows[every, feature[node]] >= value[node])
                node = np.where(child < 0, node, step)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def fit_forest(statistics: DataFrame, pool: int = POOL) -> Forest:
    """Trees over at most ``2 * pool`` rows, chosen by hash from all."""
    names, n = [*BASE, *MORE], statistics.count()
    chosen = statistics.filter(f"n_words > 0 and pmod(xxhash64(*), {max(n, 1)}) < {pool}").select(*names)
    rows = chosen.limit(2 * pool).toPandas()
    return Forest(features({c: rows[c].to_numpy(np.float64) for c in names}))


def with_score(statistics: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``anomaly``, rounded to the steps that thresholds are set in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy().astype(np.float64) for n in (*BASE, *MORE)}
            found = np.round(forest.score(features(c)) * SCORE_STEPS).astype(np.int64)
            yield batch.append_column("anomaly", pa.array(found))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statistics.schema)
    return statistics.mapInArrow(run, f"{schema}, anomaly bigint")


def calibrate(
    scored: DataFrame, labels: DataFrame, key: str = "doc_id", most: float = MAX_GOOD_REJECTED
) -> int:
    """Score from which rows are rejected: most right decisions while good rows rejected stay few."""
    counted = (
        scored.filter("not base_failed")
        .join(labels.filter("quality is not null").select(key, "quality"), key)
        .groupBy("anomaly", "quality")
        .count()
        .collect()
    )
    good, bad = np.zeros(SCORE_STEPS + 2), np.zeros(SCORE_STEPS + 2)
    for row in counted:
        (good if row["quality"] == 1 else bad)[row["anomaly"]] += row["count"]
    if not good.sum():
        return SCORE_STEPS + 1
    rejected_good, rejected_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    gain = np.where(rejected_good <= most * good.sum(), rejected_bad - rejected_good, -np.inf)
    best = np.flatnonzero(gain == gain.max())
    return int(best[-1])


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: float = MAX_GOOD_REJECTED
) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` (in steps), ``threshold`` and ``kept`` of every document."""
    statistics = materialize(rule_statistics(docs, key, text))
    scored = with_score(statistics, fit_forest(statistics)).withColumn(
        "base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    )
    scored = materialize(scored)
    threshold = calibrate(scored, labels, key, most)
    return scored.withColumn("threshold", F.lit(threshold).cast("bigint")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < threshold)
    )
