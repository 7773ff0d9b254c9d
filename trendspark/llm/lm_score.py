"""Language-model scores: context-tree weighting over bytes, beside a smoothed word unigram.

Every byte is eight binary decisions; a decision's context is the bits before it in the byte and the
last bytes before that. At each depth from 0 to 5 bytes of context a Krichevsky-Trofimov estimate
counts what followed in training texts, and context-tree weighting mixes the depths by how well each
would have coded them. Modelled are a text's lower-cased words joined by one space, closed by a line
feed, which no word holds.

Documents are dealt into chunks of bounded size. A chunk sends its distinct words and its distinct
sequences of six bytes, with training counts, to buckets; a bucket adds up all chunks' counts and
answers each chunk in the order it asked, so no key is hot and no model travels whole. Sequences meet
by their last two bytes of context and half of the third: there depths 3 to 5 are weighted. Depth 2 is
summed between buckets and sent back to them; depths 1 and 0, at most 256 x 255 nodes, pass through
the driver.

Defined results: null and empty texts are one end token; without training texts every byte has
probability 1/256; repeated rows count as often as they occur; a null id belongs to the text "".
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zlib
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, parts_for, total_bytes
from trendspark.session import materialize

CHUNK_BYTES = 1 << 23
DEPTH = 5
END = b"\n"
#: Bytes handled at once within a chunk.
STRIDE = 1 << 20


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def unpack(blob: bytes, *kinds: type) -> tuple:
    """The arrays, and what follows them."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at, found = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        found.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return (*found, data[at:])


class Chunk:
    """Words and byte sequences of a chunk's texts, in the order in which buckets list them.

    A sequence has the last byte lowest and the bytes of its context, in reading order, above it.
    """

    def __init__(self, texts: list[bytes], learn: list[bool], buckets: int) -> None:
        self.buckets, self.streams = buckets, []
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        lengths = []

        def words_of():
            for data in texts:
                words = data.lower().split()
                self.streams.append(b" ".join(words) + END)
                lengths.append(len(words))
                yield words

        # One look-up a word, here only: its number, by which counts are added up and answers read.
        self.word_at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words_of())), np.int32)
        self.n_words = np.array(lengths, np.int64)
        learned = self.word_at[np.repeat(np.array(learn, bool), self.n_words)]
        self.word_counts = np.bincount(learned, minlength=len(numbers))
        self.by_bucket = split_words(numbers, buckets)
        used, values, counts = np.array(learn, bool), [], []
        for data, at, doc in self.pieces():
            found = self.sequences_at(data, at)
            learned = used[doc]
            for part, weight in ((found[learned], 1), (found[~learned], 0)):
                value, times = np.unique(part, return_counts=True)
                values.append(value)
                counts.append(times * weight)
        self.sequence, inverse = np.unique(np.concatenate(values), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate(counts), len(self.sequence)).astype(np.int64)

    def pieces(self):
        """Bytes of some texts, the places to score in them, and the text of each place."""
        first = 0
        while first < len(self.streams):
            last, total = first, 0
            while last < len(self.streams) and (last == first or total < STRIDE):
                total += len(self.streams[last]) + DEPTH
                last += 1
            data = np.frombuffer(b"".join(END * DEPTH + s for s in self.streams[first:last]), np.uint8)
            lengths = np.array([len(s) for s in self.streams[first:last]])
            ends = np.cumsum(lengths + DEPTH)
            scored = np.ones(len(data), bool)
            for k in range(DEPTH):
                scored[ends - lengths - DEPTH + k] = False
            yield data, np.flatnonzero(scored), np.repeat(np.arange(first, last), lengths)
            first = last

    @staticmethod
    def sequences_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        wide = data.astype(np.int64)
        total = wide[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            total |= wide[DEPTH - k:-k] << (8 * k)
        return total[at - DEPTH]

    def finder(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Index in ``sequence`` of the sequences at places of a piece, by a table for each byte read."""
        letters = np.unique(self.sequence[:, None] >> np.arange(0, 8 * DEPTH + 8, 8) & 255)
        size = len(letters)
        code = np.zeros(256, np.int32)
        code[letters] = np.arange(size)
        tables, row = [], np.zeros(len(self.sequence), np.int64)
        for k in range(DEPTH, -1, -1):
            cell = row * size + code[self.sequence >> (8 * k) & 255]
            met, row = np.unique(cell, return_inverse=True)
            table = np.zeros(size * (1 if not tables else int(tables[-1].max()) + 1), np.int64)
            table[met] = np.arange(len(met))
            tables.append(table)

        def find(data: np.ndarray, at: np.ndarray) -> np.ndarray:
            # All places are read in a row; what the padding between texts leads to is not looked at.
            own = code[data]
            row = np.zeros(len(data) - DEPTH, np.int64)
            for k, table in zip(range(DEPTH, -1, -1), tables, strict=True):
                row *= size
                row += own[DEPTH - k:len(own) - k]
                row = np.take(table, row)
            return row[at - DEPTH]

        return find

    def requests(self):
        """Blobs by kind and bucket: sorted words or sequences, with training counts."""
        for bucket, (words, number) in self.by_bucket.items():
            yield "word", bucket, pack(self.word_counts[number].astype(np.int64), tail=b"\n".join(words))
        for bucket, rows in self.sequence_rows():
            yield "bytes", bucket, pack(self.sequence[rows], self.counts[rows].astype(np.int32))

    def sequence_rows(self):
        bucket = sequence_bucket(self.sequence, self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                yield int(bucket[rows[0]]), rows


def split_words(numbers: dict[bytes, int], buckets: int) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """Words of each bucket in their order, and their numbers."""
    names = sorted(numbers)
    number = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))
    bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return {int(bucket[rows[0]]): ([names[i] for i in rows.tolist()], number[rows]) for rows in parts}


def bucket_of(nearest: np.ndarray, half: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of two bytes of context and the upper half of the third."""
    return ((nearest * SPLITS + half) * 2654435761 >> 13) % buckets


#: Buckets that share two bytes of context, one for each upper half of the third byte.
SPLITS = 16


def sequence_bucket(sequence: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(sequence >> 8 & 0xFFFF, sequence >> 28 & 15, buckets)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series above a shift of eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi)
    return series + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def summed_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, values, n).astype(np.float64)


class Level:
    """Nodes of one depth, sorted: key ``context << 8 | bits before``, counts, log of the weighted
    probability, and the weight of the node's own estimate against its children's."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.key, inverse = np.unique(key, return_inverse=True)
        n = len(self.key)
        self.zeros, self.ones = summed_by(inverse, zeros, n), summed_by(inverse, ones, n)
        own = log_estimate(self.zeros, self.ones)
        if below is None:
            self.log_weighted, self.weight = own, np.ones(n)
        else:
            children = summed_by(inverse, below, n)
            self.log_weighted = np.logaddexp(own, children) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))

    def above(self, depth: int) -> tuple[np.ndarray, ...]:
        """Key at a smaller depth, counts, and what the nodes give to it."""
        return shorter(self.key, depth), self.zeros, self.ones, self.log_weighted

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one, and weight; even for unseen nodes."""
        if not len(self.key):
            return np.full(len(key), 0.5), np.full(len(key), 0.5)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        met = self.key[at] == key
        one = (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        return np.where(met, one, 0.5), np.where(met, self.weight[at], 0.5)


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """A node's key with the nearest ``depth`` bytes of context only."""
    return key & ((1 << (8 * depth + 8)) - 1)


def bits(sequence: np.ndarray):
    """For each of a byte's eight decisions: the node's key, and the bit."""
    following, context = sequence & 255, sequence >> 8 << 8
    for k in range(8):
        yield context | (1 << k) | (following >> (8 - k)), (following >> (7 - k)) & 1


def inner_levels(sequence: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth five, four and three."""
    used = counts > 0
    sequence, counts = sequence[used], counts[used]
    parts = [(key, counts * (1 - bit), counts * bit) for key, bit in bits(sequence)]
    levels = [Level(*(np.concatenate(c) for c in zip(*parts, strict=True)), None)]
    for depth in range(DEPTH - 1, 2, -1):
        levels.append(Level(*levels[-1].above(depth)))
    return levels


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All sequences with their counts, and each blob's sequences."""
    asked, counts = [], []
    for blob in blobs:
        sequence, count, _ = unpack(blob, np.int64, np.int32)
        asked.append(sequence)
        counts.append(count)
    every, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64), asked


NODES = "key bigint, zeros double, ones double, below double"
NAMES = ("key", "zeros", "ones", "below")


def second_depth(table: pa.Table) -> pa.Table:
    """What a bucket's nodes of depth three give to depth two."""
    every, counts, _ = merged(table.column("blob").to_pylist())
    key, *columns = inner_levels(every, counts)[-1].above(2)
    key, inverse = np.unique(key, return_inverse=True)
    return pa.table([key, *(summed_by(inverse, c, len(key)) for c in columns)], names=NAMES)


def first_depth(batches):
    """What whole nodes of depth two give to depth one."""
    for batch in batches:
        level = Level(*(batch.column(c).to_numpy() for c in NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in level.above(1)], names=NAMES)


def summed(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("key").agg(*(F.sum(c).alias(c) for c in NAMES[1:]))


def log10_probability(sequence: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Of the last byte of each sequence after the others; ``levels`` from the deepest to depth zero."""
    total = np.zeros(len(sequence))
    for key, bit in bits(sequence):
        mixed = None
        for depth, level in zip(range(DEPTH, -1, -1), levels, strict=True):
            one, weight = level.look_up(shorter(key, depth))
            mixed = one if mixed is None else weight * one + (1 - weight) * mixed
        total += np.log10(np.where(bit == 1, mixed, 1 - mixed))
    return total


def count_words(table: pa.Table) -> pa.Table:
    """Totals of a bucket's words, answered in each chunk's order; chunk -1 has the bucket's sums."""
    total: dict[bytes, int] = {}
    asked = []
    for blob in table.column("blob").to_pylist():
        counts, tail = unpack(blob, np.int64)
        words = tail.split(b"\n")
        asked.append(words)
        for word, n in zip(words, counts.tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    answers = [pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))) for words in asked]
    known = [n for n in total.values() if n]
    answers.append(pack(np.array([sum(known), len(known)], np.int64)))
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "kind": pa.array(["word"] * len(answers)),
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([bucket] * len(answers), pa.int64()),
            "blob": pa.array(answers, pa.binary()),
        }
    )


ANSWER = "kind string, chunk bigint, bucket bigint, blob binary"


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Learns from the rows that are not held out. ``score`` is the log10 probability of the text.
    """
    spark = docs.sparkSession
    chunks = parts_for(spark, total_bytes(docs, text), CHUNK_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    # By content, so that a row is in the same chunk each time.
    staged = docs.select(key, text, F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn(
        "chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks))
    )

    def chunk_of(table: pa.Table) -> Chunk:
        learn = [not h for h in table.column("held_out").to_pylist()]
        return Chunk(as_bytes(table.column(text)), learn, chunks)

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        kinds, buckets, blobs = zip(*chunk_of(table).requests(), strict=True)
        return pa.table(
            {
                "kind": pa.array(kinds),
                "chunk": pa.array([group[0].as_py()] * len(kinds), pa.int64()),
                "bucket": pa.array(buckets, pa.int64()),
                "blob": pa.array(blobs, pa.binary()),
            }
        )

    asked = materialize(staged.groupBy("chunk").applyInArrow(ask, ANSWER))
    words = materialize(asked.filter("kind = 'word'").groupBy("bucket").applyInArrow(count_words, ANSWER))
    n_docs = staged.filter(~F.col("held_out")).count()
    sums = [unpack(r["blob"], np.int64)[0] for r in words.filter("chunk = -1").select("blob").toLocalIterator()]
    train_tokens = int(sum(s[0] for s in sums)) + n_docs
    distinct = int(sum(s[1] for s in sums)) + (n_docs > 0)
    bytes_asked = asked.filter("kind = 'bytes'")
    second = materialize(summed(bytes_asked.groupBy("bucket").applyInArrow(second_depth, NODES)))
    rows = summed(second.mapInArrow(first_depth, NODES)).orderBy("key").toPandas()
    first = Level(*(rows[c].to_numpy() for c in NAMES))
    outer = [first, Level(*first.above(0))]

    def deal(batches):
        for batch in batches:
            for half in range(SPLITS):
                bucket = bucket_of(batch.column("key").to_numpy() >> 8, np.int64(half), chunks)
                yield batch.append_column("bucket", pa.array(bucket))

    dealt = second.mapInArrow(deal, f"{NODES}, bucket bigint").distinct()

    def answer(table: pa.Table, nodes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["kind", "chunk", "bucket", "blob"])
        every, counts, wanted = merged(table.column("blob").to_pylist())
        two = Level(*(nodes.column(c).to_numpy() for c in NAMES))
        found = log10_probability(every, [*inner_levels(every, counts), two, *outer]).astype(np.float32)
        blobs = [pack(found[np.searchsorted(every, own)]) for own in wanted]
        return table.set_column(table.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))

    answers = words.filter("chunk >= 0").unionByName(
        bytes_asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(answer, ANSWER)
    )
    base = _base(train_tokens, distinct)

    def finish(table: pa.Table, answered: pa.Table) -> pa.Table:
        chunk = chunk_of(table)
        times = np.zeros(len(chunk.word_counts))
        found = np.zeros(len(chunk.sequence), np.float32)
        rows = dict(chunk.sequence_rows())
        for what, bucket, blob in zip(*(answered.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if what == "word":
                times[chunk.by_bucket[bucket][1]] = unpack(blob, np.int64)[0]
            else:
                found[rows[bucket]] = unpack(blob, np.float32)[0]
        total = np.zeros(len(chunk.streams))
        find = chunk.finder()
        for data, at, doc in chunk.pieces():
            total += np.bincount(doc, found[find(data, at)], len(total))
        doc = np.repeat(np.arange(len(total)), chunk.n_words)
        n_known = np.bincount(doc, (times > 0)[chunk.word_at], len(total)).astype(np.int64) + (n_docs > 0)
        base_score = np.bincount(doc, base(times)[chunk.word_at], len(total)) + base(np.array([n_docs]))[0]
        size = len(total)
        return pa.table(
            {
                key: table.column(key),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(chunk.n_words + 1, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([train_tokens] * size, pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(total, pa.float64()),
            }
        )

    return (
        staged.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            finish,
            f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        )
    )


def _base(train_tokens: int, distinct: int) -> Callable[[np.ndarray], np.ndarray]:
    whole = train_tokens + 0.1 * (distinct + 1)
    return lambda count: np.log10((count + 0.1) / whole)
