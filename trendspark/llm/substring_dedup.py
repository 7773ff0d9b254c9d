"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the run of ``mer`` words inside it with the
least hash, where runs that are frequent in the corpus come last, so that a passage in many documents
does not gather their surroundings in one bucket. Consecutive windows of one minimiser travel as one
packed string to the minimiser's bucket; equal windows meet there, are sorted by a rolling hash,
compared word by word and counted exactly. Equal texts and equal strings are counted once per
slice of input before they travel. A string whose minimiser occurs nowhere else is not looked into. What comes back is ranges of words to remove.

Defined results: null and empty texts have no words and nothing to remove; texts shorter than a
window stay whole; repeated rows count as other places, so all their windows go; nothing is kept of a
window just because it is the first one. Extra columns stay as they are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size, free, give_back, parts_for, total_bytes
from trendspark.llm.hashing import Hashes, mix, run_hashes, slices, text_hash, word_codes
from trendspark.session import materialize, scratch

SIZE, MER = 35, 8
#: Input handled at once, and packed strings of one bucket before compression.
SLICE_BYTES, BUCKET_BYTES = 1 << 24, 1 << 23
#: Packed strings repeat the words around their windows about so often.
EXPANSION = 3.5
#: A run is frequent if it has this share of all runs: 125,000 runs at most.
FREQUENT = 8e-6


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of ``width``."""
    least, done = values, 1
    while done * 2 <= width:
        least, done = np.minimum(least[:-done], least[done:]), done * 2
    rest = width - done
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def ranked_runs(codes: np.ndarray, frequent: np.ndarray, mer: int) -> np.ndarray:
    """Hash of every run of ``mer`` words, by which minimisers are chosen; frequent runs have their highest bit set."""
    runs = run_hashes(codes, mer) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        runs = runs | (frequent[at] == runs).astype(np.uint64) << np.uint64(63)
    return runs


def occur_twice(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each of the values occurs more than once among the runs."""
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


def frequent_runs(docs: DataFrame, text: str, size: int, mer: int) -> np.ndarray:
    """Hashes of the frequent runs, sorted. A task leaves out runs that are rare among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), 0
        for texts in slices(batches, text, SLICE_BYTES):
            found = []
            for data, n in texts.items():
                words = data.split()
                if len(words) >= size:
                    runs = run_hashes(word_codes(words, hashes), mer) >> np.uint64(1)
                    total += n * len(runs)
                    found += [runs] * min(n, 8)
            if found:
                value, counts = np.unique(np.concatenate(found), return_counts=True)
                many = counts >= max(4, FREQUENT / 4 * counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[many].astype(np.int64)), pa.array(counts[many])], names=["run", "n"]
                )
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([total])], names=["run", "n"])

    counted = docs.select(text).mapInArrow(run, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    total = counted.filter("run = -1").first()
    least = (total["n"] if total else 0) * FREQUENT
    rows = counted.filter((F.col("run") >= 0) & (F.col("n") >= max(least, 4))).toPandas()
    return np.sort(rows["run"].to_numpy().astype(np.uint64))


class Package:
    """Strings of one bucket from one slice, and where they occur.

    A string's mark tells its minimiser; the lowest bit is set if a text with it has that run twice.
    """

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.marks = array("I")
        # Five numbers an occurrence; as tuples they would take as much memory as the strings.
        self.rows = array("q")

    def add(self, string: bytes, key: int, n_words: int, start: int, times: int, mark: int = 0) -> None:
        number = self.ids.setdefault(string, len(self.ids))
        if number == len(self.marks):
            self.marks.append(mark)
        else:
            self.marks[number] |= mark
        self.rows.extend((number, key, n_words, start, times))

    def blob(self, packer: zstandard.ZstdCompressor) -> bytes:
        table = np.frombuffer(self.rows, np.int64).reshape(-1, 5)
        return packer.compress(len(table).to_bytes(8, "little") + table.T.tobytes() + b"\n".join(self.ids))


def unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    table = np.frombuffer(data, np.int64, 5 * n, 8).reshape(5, n)
    return table, data[8 + 40 * n:].split(b"\n")


def packages(docs: DataFrame, frequent: np.ndarray, buckets: int, text: str, size: int, mer: int) -> DataFrame:
    """Super-k-mers of all texts: one row (bucket, blob, marks) per slice and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = Hashes(), zstandard.ZstdCompressor(level=3)
        for texts in slices(batches, text, SLICE_BYTES):
            own: dict[int, Package] = defaultdict(Package)
            for data, times in texts.items():
                words = data.split()
                n = len(words)
                if n < size:
                    continue
                runs = ranked_runs(word_codes(words, hashes), frequent, mer)
                least = sliding_least(runs, size - mer + 1)
                begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                ends = np.append(begins[1:], len(least)) + (size - 1)
                mixed = mix(least[begins])
                bucket = (mixed % np.uint64(buckets)).tolist()
                mark = (mixed >> np.uint64(33) << np.uint64(1) | occur_twice(least[begins], runs).astype(np.uint64)).tolist()
                plain = b" ".join(words)
                lengths = np.fromiter(map(len, words), np.int64, n) + 1
                place = np.concatenate([[0], np.cumsum(lengths)])
                key = text_hash(data)
                cuts = zip(bucket, begins.tolist(), place[begins].tolist(), (place[ends] - 1).tolist(), mark, strict=True)
                for b, start, low, high, m in cuts:
                    own[b].add(plain[low:high], key, n, start, times, m)
            names = sorted(own)
            for first in range(0, len(names), 64):
                part = names[first:first + 64]
                marks = [own[b].marks.tobytes() for b in part]
                blobs = [own.pop(b).blob(packer) for b in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())],
                    names=["bucket", "blob", "marks"],
                )

    return docs.select(text).mapInArrow(run, "bucket bigint, blob binary, marks binary")


def repeated_windows(strings: list[bytes], times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every window whose words occur twice or more among the strings."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    # One split of all strings: a list of words for each would be walked by the collector again and again.
    lengths = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    words = b" ".join(strings).split(b" ") if strings else []
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    first = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(strings)), lengths)
    offset = np.arange(len(codes)) - first[of]
    starts = np.flatnonzero(offset <= lengths[of] - size)
    hashed = run_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), size)[starts]
    order = np.argsort(hashed, kind="stable")
    starts, hashed = starts[order], hashed[order]
    new = np.concatenate([[True], hashed[1:] != hashed[:-1]]) if len(hashed) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    weight = np.bincount(group, times[of[starts]])[group] if len(group) else np.zeros(0)
    many = weight >= 2
    starts, group = starts[many], group[many]
    # Word by word: members of a group have to equal the one before them.
    same = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.zeros(0, bool)
    right = np.flatnonzero(same)
    equal = np.ones(len(right), bool)
    for k in range(size):
        equal &= codes[starts[right] + k] == codes[starts[right - 1] + k]
    if not equal.all():  # two sequences of one hash: group these by their words
        mixed = np.isin(group, group[right[~equal]])
        rows = codes[starts[mixed][:, None] + np.arange(size)]
        exact = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        enough = np.bincount(exact, times[of[starts[mixed]]])[exact] >= 2
        starts = np.concatenate([starts[~mixed], starts[mixed][enough]])
    return of[starts], offset[starts]


def worth_a_look(marks: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Strings that may have a repeated window: the run that is its minimiser has to occur twice as well."""
    group = np.unique(marks >> 1, return_inverse=True)[1]
    return np.flatnonzero((np.bincount(group, times)[group] >= 2) | (marks & 1 == 1)) if len(marks) else np.zeros(0, np.int64)


def ranges_of_bucket(blobs: list[bytes], size: int, marks: list[bytes]) -> pd.DataFrame:
    """Ranges (key, n_words, start, end) of words to remove."""
    ids: dict[bytes, int] = {}
    tables, owns = [], []
    for blob in blobs:
        table, strings = unpack(blob)
        own = np.fromiter((ids.setdefault(s, len(ids)) for s in strings), np.int64, len(strings))
        owns.append(own)
        table = table.copy()
        table[0] = own[table[0]]
        tables.append(table)
    table = np.concatenate(tables, axis=1)
    times = np.bincount(table[0], table[4], len(ids))
    mark = np.zeros(len(ids), np.uint32)
    for own, part in zip(owns, marks, strict=True):
        mark[own] |= np.frombuffer(part, np.uint32)
    strings, looked_at = list(ids), worth_a_look(mark, times)
    of, offset = repeated_windows([strings[i] for i in looked_at.tolist()], times[looked_at], size)
    of = looked_at[of]
    order = np.lexsort((offset, of))
    of, offset = of[order], offset[order]
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(of) else []
    last = np.append(cut[1:], len(of)).astype(np.int64) - 1 if len(of) else []
    runs = pd.DataFrame({"of": of[cut], "low": offset[cut], "high": offset[last] + size}) if len(of) else None
    if runs is None:
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in ("key", "n_words", "start", "end")})
    met = np.zeros(len(ids), bool)
    met[of] = True
    table = table[:, met[table[0]]]
    places = pd.DataFrame({"of": table[0], "key": table[1], "n_words": table[2], "at": table[3]}).drop_duplicates()
    found = places.merge(runs, on="of")
    found["start"], found["end"] = found["at"] + found["low"], found["at"] + found["high"]
    return found[["key", "n_words", "start", "end"]]


def repeated_ranges(docs: DataFrame, text: str = "text", size: int = SIZE, mer: int = MER) -> DataFrame:
    """Per text key the ranges of words that are covered by a repeated window.

    Rows ``key, ranges``, ranges being an array of (n_words, start, end); see :func:`text_key`.
    """
    spark = docs.sparkSession
    frequent = frequent_runs(docs, text, size, mer)
    buckets = parts_for(spark, int(total_bytes(docs, text) * EXPANSION), BUCKET_BYTES)

    def reduce(table: pa.Table) -> pa.Table:
        found = ranges_of_bucket(table.column("blob").to_pylist(), size, table.column("marks").to_pylist())
        give_back()
        return pa.Table.from_pandas(found, preserve_index=False)

    ranges = (
        packages(docs, frequent, buckets, text, size, mer)
        .groupBy("bucket")
        .applyInArrow(reduce, "key bigint, n_words bigint, start bigint, end bigint")
    )
    return ranges.groupBy("key").agg(F.collect_list(F.struct("n_words", "start", "end")).alias("ranges"))


def text_key(text: str) -> Column:
    """The key of a text: a 64-bit hash; ranges also carry the number of words."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def kept_words(data: bytes, ranges: list[dict] | None) -> tuple[list[bytes], int]:
    """Words left, and the number of words there were."""
    words = data.split()
    if not ranges:
        return words, len(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        if r["n_words"] == len(words):
            edges[r["start"]] += 1
            edges[r["end"]] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words)


def _with_ranges(docs: DataFrame, text: str, size: int, mer: int) -> DataFrame:
    """``docs`` and a last column with the ranges of its text."""
    key, found = free(docs, "_key", "_ranges")
    with scratch(docs.sparkSession) as keep:
        ranges = keep(repeated_ranges(docs, text, size, mer))
    ranges = ranges.select(F.col("key").alias(key), F.col("ranges").alias(found))
    return docs.withColumn(key, text_key(text)).join(ranges, key, "left").select(*docs.columns, found)


def removal_digest(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, mer: int = MER
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, text, 1 << 23):
            rows = zip(as_bytes(batch.column(text)), batch.column(-1).to_pylist(), strict=True)
            kept = [kept_words(data, ranges) for data, ranges in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array([n for _, n in kept], pa.int64()),
                    pa.array([n - len(k) for k, n in kept], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in kept], pa.string()),
                ],
                names=[key, "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    staged = _with_ranges(docs.select(key, text), text, size, mer)
    return staged.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, text: str = "text", size: int = SIZE, mer: int = MER) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text; a text that loses nothing stays as it is."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, text, 1 << 23):
            texts = []
            rows = zip(batch.column(text).to_pylist(), batch.column(-1).to_pylist(), strict=True)
            for value, ranges in rows:
                if ranges:
                    kept, n = kept_words(value.encode(), ranges)
                    value = value if len(kept) == n else b" ".join(kept).decode()
                texts.append(value)
            at = batch.schema.get_field_index(text)
            changed = batch.set_column(at, text, pa.array(texts, pa.string()))
            yield changed.select(columns)

    return _with_ranges(docs, text, size, mer).mapInArrow(run, docs.schema)
