"""Benchmark decontamination with a positional inverted index.

The index is cut into segments of a bounded number of words. A segment lists its documents and, for
each term, the sorted positions of the term in the segment; a gap of one position parts neighbouring
documents. A search takes the benchmark in blocks of bounded size: within a segment, the position
lists of a window's terms are shifted by their offsets and intersected, from the rarest term on.
Postings are stored for the terms of a given vocabulary (here the benchmark's) or for all terms.

Words: A-Z are lower-cased, then runs of letters and digits in ASCII and of all characters beyond.

Defined results: null texts have no words, match nothing and still give a row; items without words
give no window; equal items and repeated documents are all reported; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import EMPTY_SHA256, as_bytes, batches_by_size, free, total_bytes
from trendspark.session import materialize

WINDOW = 10
SEGMENT_WORDS = 1 << 20
#: Bytes of benchmark text that one search carries to every segment.
BLOCK_BYTES = 1 << 23

#: Lower-cases A-Z and turns the ASCII characters that are in no word into spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class Vocabulary(dict):
    """Numbers terms as they come; with a fixed set, others are -1 and not kept."""

    def __init__(self, terms: Iterable[bytes] | None = None) -> None:
        super().__init__({t: i for i, t in enumerate(terms or ())})
        self.open = terms is None

    def __missing__(self, term: bytes) -> int:
        if self.open:
            self[term] = len(self)
            return self[term]
        return -1


def build_index(
    docs: DataFrame, vocabulary: set[bytes] | None = None, key: str = "doc_id", text: str = "text",
    segment_words: int = SEGMENT_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Tables of documents (segment, ordinal, key, n_words, start) and postings (segment, term, positions).

    Both are stored, so segments keep their numbers.
    """
    known = sorted(vocabulary) if vocabulary is not None else None
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 32, 0
        term_ids = Vocabulary(known)
        keys, sizes, codes, total = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, term_ids, keys, sizes, codes, total
            if not keys:
                return
            segment, serial = base + serial, serial + 1
            counts = np.array(sizes, np.int64)
            starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
            code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            place = np.arange(len(code)) + np.repeat(np.arange(len(counts)), counts)
            place, code = place[code >= 0], code[code >= 0]
            order = np.argsort(code, kind="stable")
            met, first = np.unique(code[order], return_index=True)
            names = list(term_ids)
            ends = np.append(first, len(order)).astype(np.int32)
            nothing, n_docs, n_terms = pa.nulls(len(met), pa.int64()), len(sizes), len(met)
            key_column = pa.concat_arrays(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n_docs, segment)), pa.array(np.arange(n_docs)), key_column,
                    pa.array(counts), pa.array(starts), pa.nulls(n_docs, pa.binary()),
                    pa.nulls(n_docs, pa.list_(pa.int32())),
                ],
                schema=schema_of(key_column.type),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n_terms, segment)), nothing, pa.nulls(n_terms, key_column.type), nothing,
                    nothing, pa.array([names[m] for m in met], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))),
                ],
                schema=schema_of(key_column.type),
            )
            term_ids = Vocabulary(known)
            keys, sizes, codes, total = [], [], [], 0

        def schema_of(key_type: pa.DataType) -> pa.Schema:
            return pa.schema(
                [
                    ("segment", pa.int64()), ("ordinal", pa.int64()), (key, key_type), ("n_words", pa.int64()),
                    ("start", pa.int64()), ("term", pa.binary()), ("positions", pa.list_(pa.int32())),
                ]
            )

        for batch in batches_by_size(batches, text, 1 << 22):
            for data in as_bytes(batch.column(text)):
                found = words(data)
                sizes.append(len(found))
                codes.append(np.fromiter(map(term_ids.__getitem__, found), np.int64, len(found)))
                total += len(found)
            keys.append(batch.column(key))
            # A segment is counted in batches: keys come by the batch.
            if total >= segment_words:
                yield from merged(flush())
        yield from merged(flush())

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield part

    index = materialize(
        docs.select(key, text).mapInArrow(
            run,
            f"segment bigint, ordinal bigint, `{key}` {kind}, n_words bigint, start bigint, term binary, "
            "positions array<int>",
        )
    )
    postings = index.filter("term is not null").select("segment", "term", "positions")
    return index.filter("term is null").drop("term", "positions"), postings


def windows(item: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Distinct windows of an item; an item of fewer words is one window."""
    found = words(item)
    if not found:
        return []
    return list(dict.fromkeys(tuple(found[i:i + size]) for i in range(max(1, len(found) - size + 1))))


def phrase_starts(lists: dict[bytes, np.ndarray], window: tuple[bytes, ...]) -> np.ndarray:
    """Start positions of an exact window: shifted lists, intersected from the rarest term on."""
    if any(term not in lists for term in window):
        return np.zeros(0, np.int64)
    offsets = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
    starts = lists[window[offsets[0]]].astype(np.int64) - offsets[0]
    for k in offsets[1:]:
        if not len(starts):
            break
        other = lists[window[k]]
        at = np.searchsorted(other, starts + k)
        starts = starts[other[np.minimum(at, len(other) - 1)] == starts + k]
    return starts


def proximity_starts(lists: dict[bytes, np.ndarray], window: tuple[bytes, ...], slop: int) -> np.ndarray:
    """Starts of stretches of ``len(window) + slop`` words that hold every term of the window, in any
    order; a stretch starts with one of the terms."""
    terms = sorted(set(window), key=lambda t: len(lists.get(t, ())))
    if any(term not in lists for term in terms):
        return np.zeros(0, np.int64)
    span, rare = len(window) + slop, lists[terms[0]].astype(np.int64)
    starts = np.unique((rare[:, None] - np.arange(span)).ravel())
    starts = starts[starts >= 0]
    begins = np.zeros(len(starts), bool)
    holds = np.ones(len(starts), bool)
    for term in terms:
        places = lists[term].astype(np.int64)
        at = np.searchsorted(places, starts)
        nearest = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], np.iinfo(np.int64).max)
        holds &= nearest < starts + span
        begins |= nearest == starts
    return starts[holds & begins]


def search(
    documents: DataFrame, postings: DataFrame, items: list[tuple[str, bytes]], size: int = WINDOW,
    slop: int | None = None, key: str = "doc_id",
) -> DataFrame:
    """Matches (segment, ordinal, item, start, words) of the items' windows.

    ``start`` counts words within the document. Exact phrases, or with ``slop`` all terms of a window
    within that many more words. One segment is one group; its size is bounded.
    """
    wanted = [(item, windows(data, size)) for item, data in items]
    of_window: dict[tuple[bytes, ...], list[str]] = {}
    for item, found in wanted:
        for window in found:
            of_window.setdefault(window, []).append(item)

    def run(group: tuple, docs: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("start")
        begin = docs["start"].to_numpy()
        end = begin + docs["n_words"].to_numpy()
        ordinal = docs["ordinal"].to_numpy()
        lists = {bytes(t): np.asarray(p) for t, p in zip(terms["term"], terms["positions"], strict=True)}
        out = {"ordinal": [], "item": [], "start": [], "words": []}
        for window, named in of_window.items():
            if slop is None:
                starts, length = phrase_starts(lists, window), len(window)
            else:
                starts, length = proximity_starts(lists, window, slop), len(window) + slop
            if not len(starts):
                continue
            doc = np.searchsorted(begin, starts, side="right") - 1
            if slop is not None:  # a stretch may run past the document's end, its terms may not
                last = np.maximum.reduce(
                    [lists[t][np.searchsorted(lists[t], starts)] for t in set(window)]
                )
                starts, doc = starts[last < end[doc]], doc[last < end[doc]]
            for item in named:
                out["ordinal"].append(ordinal[doc])
                out["item"].append(np.full(len(doc), item, object))
                out["start"].append(starts - begin[doc])
                out["words"].append(np.minimum(length, end[doc] - starts))
        if not out["item"]:
            return pd.DataFrame(columns=["segment", *out])
        found = pd.DataFrame({name: np.concatenate(parts) for name, parts in out.items()})
        found.insert(0, "segment", group[0])
        return found

    return documents.groupBy("segment").cogroup(postings.groupBy("segment")).applyInPandas(
        run, "segment bigint, ordinal bigint, item string, start bigint, words bigint"
    )


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about BLOCK_BYTES of text."""
    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    rows = rows.filter("text is not null")
    many = max(1, -(-total_bytes(rows, "text") // BLOCK_BYTES))
    for block in range(many):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == block)
        yield [(row["item"], row["text"].encode()) for row in part.toLocalIterator()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    size: int = WINDOW,
) -> DataFrame:
    """``segment, ordinal, key, n_words, n_hit, items`` of every document; items sorted as strings."""
    terms: set[bytes] = set()
    parts = list(blocks(benchmark, item)) if total_bytes(benchmark, "text") <= BLOCK_BYTES else None
    if parts is not None:
        for block in parts:
            terms.update(w for _, data in block for w in words(data))
        documents, postings = build_index(docs, terms, key, text)
    else:
        documents, postings = build_index(docs, None, key, text)
    found = None
    for block in parts if parts is not None else blocks(benchmark, item):
        own = {w for _, data in block for w in words(data)}
        matched = materialize(search(documents, postings, block, size, key=key)) if own else None
        if matched is not None:
            found = matched if found is None else found.unionByName(matched)
    if found is None:
        empty = F.expr("CAST(array() AS array<string>)")
        return documents.drop("start").withColumns({"n_hit": F.lit(0).cast("bigint"), "items": empty})
    place = F.explode(F.sequence("start", F.expr("start + words - 1")))
    spans = found.select("segment", "ordinal", "start", "words").distinct()
    hit = (
        spans.select("segment", "ordinal", place.alias("place")).distinct()
        .groupBy("segment", "ordinal").agg(F.count("*").alias("n_hit"))
    )
    items = (
        found.select("segment", "ordinal", "item").distinct()
        .groupBy("segment", "ordinal").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return (
        documents.drop("start")
        .join(hit.join(items, ["segment", "ordinal"]), ["segment", "ordinal"], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
        .withColumn("items", F.coalesce("items", F.expr("CAST(array() AS array<string>)")))
    )


def with_digest(found: DataFrame) -> DataFrame:
    """Adds ``n_items``, ``items_sha256`` and ``contaminated``."""
    joined = F.array_join("items", ",")
    digest = F.when(F.size("items") == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(joined, 256))
    return found.withColumns(
        {
            "n_items": F.size("items").cast("bigint"),
            "items_sha256": digest,
            "contaminated": F.col("n_hit") > 0,
        }
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, as they are."""
    # Rows are known by their content: whatever ids they have, equal texts meet the same fate.
    (key,) = free(docs, "_key")
    hashed = docs.withColumn(key, F.concat_ws("-", F.xxhash64(text), F.octet_length(text)))
    found = decontaminate(hashed.select(key, text), benchmark, key, text, item, size)
    hit = found.filter("n_hit > 0").select(key).distinct()
    return hashed.join(hit, key, "left_anti").select(*docs.columns)
