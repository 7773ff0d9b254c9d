"""Runs: stretches of words that repeat with a period, found by suffix trees and Lyndon roots.

A run has a smallest period q, at least ``times`` periods and ``least`` words, and no neighbouring
word extends it. Every run is the extension of a Lyndon word, in the order of words or in its
reverse, that is the longest one at its start. So for both orders the longest Lyndon word at every
place is a candidate root; it is extended to the right by the longest common extension of two
suffixes, and to the left by that of two prefixes. Extensions are lowest common ancestors in the
suffix trees of the words and of their reversal, built by Ukkonen's algorithm; an Euler tour with
minima of blocks answers each in constant time.

Before that, a text is cut down to the stretches that can hold a run: within a run of period q a
sequence of up to q words stands ``times - 1`` times in a row q places apart, so places whose sequence does not
recur that near part the text. Equal hashes only widen a stretch; words are compared by the trees.

One text is handled at a time, and memory grows with its longest such stretch. Nothing is shuffled.

Defined results: null, empty and blank texts have no words and no runs; repeated rows and keys are
rows of their own; columns beside key and text are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size
from trendspark.llm.hashing import run_hashes

LEAST, TIMES = 6, 4
SLICE_BYTES = 1 << 22
#: Words of the sequences by which a text is cut down, from the largest on that a period allows.
GRAMS = (9, 3, 1)
#: Places of an Euler tour that share a minimum.
BLOCK = 16
FAR = np.iinfo(np.int64).max
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def narrowest(grams: np.ndarray, many: int) -> np.ndarray:
    """For each place the least width of ``many`` successive equal sequences, that at the place included."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    own, found = grams[order], np.full(n, FAR)
    if n >= many:
        last = n - many + 1
        width = np.where(own[many - 1:] == own[:last], order[many - 1:] - order[:last], FAR)
        for shift in range(many):
            part = found[shift:shift + last]
            np.minimum(part, width, out=part)
    result = np.empty(n, np.int64)
    result[order] = found
    return result


def stretches(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint parts of a text that hold all its runs, each whole."""
    n, scale, size, found = len(codes), 1, 0, []
    # Periods above half of ``scale`` up to ``scale``.
    while (shortest := max(least, times * (scale // 2 + 1))) <= n:
        fitting = next(g for g in GRAMS if g <= scale // 2 + 1)
        if fitting != size:
            size = fitting
            width = narrowest(run_hashes(codes, size), times - 1)
            nearest = int(width.min())
        if size == GRAMS[0] and nearest == FAR:
            break
        if nearest <= (times - 2) * scale:
            near = np.concatenate([[False], width <= (times - 2) * scale, [False]])
            turn = np.flatnonzero(near[1:] != near[:-1])
            for low, high in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                if high - low > shortest - size:
                    found.append((low, high + size - 1))
        scale *= 2
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low < merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    if merged == [(0, n)]:
        return merged
    return [
        (low + a, low + b) for low, high in merged for a, b in stretches(codes[low:high], least, times)
    ]


class SuffixTree:
    """Suffix tree of a sequence of codes from 1 to ``top``; 0 closes the sequence."""

    def __init__(self, codes: list[int], top: int) -> None:
        self.text, self.radix = [*codes, 0], top + 1
        self.n = len(self.text)
        self._build()
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        self.heads = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        del self.edges
        self.tails, self.letters = keys // self.radix, keys % self.radix
        self._tour()

    def _build(self) -> None:
        """Ukkonen's algorithm: one pass, the active place moves along suffix links."""
        text, radix, n = self.text, self.radix, self.n
        start, stop, link, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, letter in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * radix + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    at = start[child]
                    whole = min(stop[child], i + 1) - at
                    if length >= whole:
                        edge += whole
                        length -= whole
                        node = child
                        continue
                    if text[at + length] == letter:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    start += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    edges[key] = middle
                    edges[middle * radix + letter] = middle + 1
                    start[child] = at + length
                    edges[middle * radix + text[at + length]] = child
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.stop, self.edges = start, stop, edges

    def _children(self, letters: np.ndarray) -> tuple[list[int], list[int]]:
        """Children in order of node and letter, and where a node's children begin."""
        order = np.argsort(self.tails * self.radix + letters)
        begin = np.searchsorted(self.tails[order], np.arange(len(self.start) + 1))
        return self.heads[order].tolist(), begin.tolist()

    def _tour(self) -> None:
        """Euler tour: depth in words at every step, and the step at which a suffix is met."""
        children, begin = self._children(self.letters)
        start, stop, n = self.start, self.stop, self.n
        following, depth = list(begin), [0] * len(start)
        tour, place, order, path = [], [0] * n, [], [0]
        while path:
            node = path[-1]
            tour.append(depth[node])
            at = following[node]
            if at < begin[node + 1]:
                following[node] = at + 1
                child = children[at]
                depth[child] = depth[node] + stop[child] - start[child]
                path.append(child)
            else:
                if begin[node] == begin[node + 1]:
                    suffix = n - depth[node]
                    place[suffix] = len(tour) - 1
                    order.append(suffix)
                path.pop()
        self.depth, self.order, self.place = depth, order, np.array(place, np.int64)
        steps = np.array(tour, np.int32)
        filled = np.full(-(-len(steps) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        filled[:len(steps)] = steps
        rows = filled.reshape(-1, BLOCK)
        self.steps = filled
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.powers = [rows.min(axis=1)]
        while (width := 1 << len(self.powers)) <= len(rows):
            last = self.powers[-1]
            self.powers.append(np.minimum(last[:-width // 2], last[width // 2:]))

    def suffix_ranks(self, descending: bool = False) -> list[int]:
        """Rank of every suffix of the sequence, by letters or by letters the other way round; the
        end is the least letter both times."""
        order = self.order
        if descending:
            children, begin = self._children(-self.letters % self.radix)
            order, path, depth, n = [], [0], self.depth, self.n
            while path:
                node = path.pop()
                low, high = begin[node], begin[node + 1]
                if low == high:
                    order.append(n - depth[node])
                else:
                    path += children[low:high][::-1]
        ranks = np.empty(self.n, np.int64)
        ranks[order] = np.arange(self.n)
        return ranks[:-1].tolist()

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Longest common extension of pairs of different suffixes, the depth of their lowest common ancestor."""
        a, b = self.place[one], self.place[other]
        low, high = np.minimum(a, b), np.maximum(a, b)
        left, right = low // BLOCK, high // BLOCK
        least = np.minimum(self.after[low], self.before[high])
        same = np.flatnonzero(left == right)
        if len(same):
            inside = low[same]
            least[same] = self.steps[inside]
            for shift in range(1, BLOCK):
                at = np.minimum(inside + shift, high[same])
                least[same] = np.minimum(least[same], self.steps[at])
        between = right - left - 1
        wide = np.flatnonzero(between > 0)
        power = np.frexp(between[wide].astype(np.float64))[1] - 1
        for exponent in np.unique(power).tolist():
            rows = wide[power == exponent]
            table = self.powers[exponent]
            both = np.minimum(table[left[rows] + 1], table[right[rows] - (1 << exponent)])
            least[rows] = np.minimum(least[rows], both)
        return least.astype(np.int64)


def longest_lyndon(ranks: list[int]) -> np.ndarray:
    """End of the longest Lyndon word at every place: where the next smaller suffix starts."""
    n = len(ranks)
    ends, later = [n] * n, []
    for i in range(n - 1, -1, -1):
        own = ranks[i]
        while later and ranks[later[-1]] > own:
            later.pop()
        if later:
            ends[i] = later[-1]
        later.append(i)
    return np.array(ends, np.int64)


def runs_of_stretch(codes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of one stretch."""
    n = len(codes)
    _, dense = np.unique(codes, return_inverse=True)
    dense = dense + 1
    top = int(dense.max())
    forward = SuffixTree(dense.tolist(), top)
    ends = [longest_lyndon(forward.suffix_ranks(way)) for way in (False, True)]
    start, stop = np.tile(np.arange(n), 2), np.concatenate(ends)
    period = stop - start
    fits = np.flatnonzero(np.maximum(times * period, least) <= n)
    start, stop, period = start[fits], stop[fits], period[fits]
    right = forward.common(start, stop)
    del forward
    backward = SuffixTree(dense[::-1].tolist(), top)
    left = np.where(start > 0, backward.common(n - start, n - stop), 0)
    length = left + period + right
    good = length >= np.maximum(times * period, least)
    return np.unique(np.stack([start - left, length, period], axis=1)[good], axis=0)


def find_word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a text's words as rows (start, length, period), by start and period."""
    if len(words) < max(least, times):
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    found = [np.zeros((0, 3), np.int64)]
    for low, high in stretches(codes, least, times):
        found.append(runs_of_stretch(codes[low:high], least, times) + np.array([low, 0, 0]))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, of each run only the first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``key, runs, collapsed`` of every row: its runs by start and period, and the text without
    repeats. ``change(key, words)`` may replace a row's words before that."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, text, SLICE_BYTES):
            found, kept, ends = [], [], [0]
            keys = batch.column(key).to_pylist() if change else [None] * batch.num_rows
            for name, data in zip(keys, as_bytes(batch.column(text)), strict=True):
                words = data.split()
                if change:
                    words = change(name, words)
                rows = find_word_runs(words, least, times)
                found.append(rows)
                kept.append(collapse(words, rows))
                ends.append(ends[-1] + len(rows))
            flat = np.concatenate(found)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[key, "runs", "collapsed"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def _longest(runs: Column) -> Column:
    """The longest run; of equals that which starts first, then that of the least period."""
    order = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))
    )
    return F.array_min(order)


def with_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    comma, line_end = F.lit(","), F.lit("\n")
    lines = F.transform(
        "runs", lambda r: F.concat(r["start"], comma, r["length"], comma, r["period"], line_end)
    )
    best, length = F.col("_best"), -F.col("_best")["size"]
    return found.withColumn("_best", _longest(F.col("runs"))).select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.expr("(-_best.size * 1000) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
