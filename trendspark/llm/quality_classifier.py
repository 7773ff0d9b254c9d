"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are hashed into a fixed number of buckets, so that vectors and their broadcast have a bound. A
bucket's vector adds up the sparse random index vectors of its neighbours over the whole corpus; the
sums are whole numbers, so no order of tasks changes them. A document's vector holds the mean of its
words' vectors and their mean step from word to word. The network learns from labelled documents, at
most about ``TRAIN_ROWS`` chosen by hash, and a temperature set on a part left out calibrates it.

Defined results: null and empty texts have the zero vector and are scored like all others; labels
that are null are left out; without labels of both kinds every score is the share of label 1, or 0.5;
repeated rows score alike; texts of any length are read in slices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size
from trendspark.session import materialize, scratch

BUCKETS, DIMENSIONS, REACH, NONZERO = 1 << 14, 32, 2, 2
#: Bound of the labelled rows used for learning.
TRAIN_ROWS = 24_000
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 48, 40, 3e-3, 1e-4, 256
SLICE = 1 << 22

WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")


class Buckets(dict):
    """Bucket of a word; starts anew when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word) & (BUCKETS - 1)
        return bucket


def codes(data: bytes, buckets: Buckets) -> Iterator[np.ndarray]:
    """Buckets of a text's words, in slices cut at white space where there is any."""
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        found = WORD.findall(data, start, end)
        yield np.fromiter(map(buckets.__getitem__, found), np.int64, len(found))
        start = end


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector; the last row is empty."""
    random = np.random.default_rng(11)
    places = random.integers(0, DIMENSIONS, (BUCKETS + 1, NONZERO))
    signs = random.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0.0
    return places, signs


def neighbour_sums(code: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors by bucket. ``BUCKETS`` as a code separates documents."""
    size = (BUCKETS + 1) * DIMENSIONS
    total = np.zeros(size)
    for step in range(1, REACH + 1):
        for one, other in ((code[:-step], code[step:]), (code[step:], code[:-step])):
            for k in range(NONZERO):
                total += np.bincount(one * DIMENSIONS + places[other, k], signs[other, k], size)
    return total.reshape(BUCKETS + 1, DIMENSIONS)[:BUCKETS]


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A vector for each bucket, learned from all texts. A task sends one row per bucket it has met."""
    names = [f"d{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        buckets, gap = Buckets(), np.full(REACH, BUCKETS)
        total, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS + 1, np.int64)
        waiting, size = [], 0

        def add() -> None:
            nonlocal total, counts, waiting, size
            if size:
                code = np.concatenate(waiting)
                total += neighbour_sums(code, places, signs)
                counts += np.bincount(code, minlength=BUCKETS + 1)
                waiting, size = [], 0

        for batch in batches_by_size(batches, text, 1 << 23):
            for data in as_bytes(batch.column(text)):
                for code in codes(data, buckets):
                    waiting.append(code)
                    size += len(code)
                    if size > 1_000_000:
                        add()
                waiting.append(gap)
        add()
        met = np.flatnonzero(counts[:BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(counts[met])]
            + [pa.array(total[met, i].astype(np.int64)) for i in range(DIMENSIONS)],
            names=["bucket", "n", *names],
        )

    schema = "bucket bigint, n bigint, " + ", ".join(f"{n} bigint" for n in names)
    sums = (
        docs.select(text).mapInArrow(run, schema).groupBy("bucket")
        .agg(*(F.sum(n).alias(n) for n in ("n", *names)))
        .toPandas()
    )
    vectors = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)
    if len(sums):
        rows = sums[names].to_numpy(np.float64)
        rows = rows / sums[["n"]].to_numpy() - rows.sum(axis=0) / sums["n"].sum()
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        vectors[sums["bucket"].to_numpy()] = rows
    return vectors


def pool(data: bytes, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean vector, mean absolute step between words, and log length of one text."""
    total, steps, n, last = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0, None
    for code in codes(data, buckets):
        if last is not None:
            code = np.concatenate([last, code])
        rows = vectors[code]
        steps += np.abs(rows[1:] - rows[:-1]).sum(axis=0)
        fresh = rows if last is None else rows[1:]
        total += fresh.sum(axis=0)
        n += len(fresh)
        last = code[-1:] if len(code) else last
    size = max(n, 1)
    return np.concatenate([total / size, steps / max(n - 1, 1), [np.log1p(n)]]).astype(np.float32)


def document_vectors(
    docs: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and ``vector`` (float32 bytes) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches_by_size(batches, text, 1 << 23):
            rows = [pool(data, sent.value, buckets).tobytes() for data in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.binary())], [key, "vector"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector binary")


class Network:
    """Input, one hidden layer of rectified units, one logit; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.layers = None
        if len(y) < 10 or y.min() == y.max():
            return
        order = random.permutation(len(y))
        held, learn = order[: len(y) // 5], order[len(y) // 5:]
        self.shift, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-4
        z = (x - self.shift) / self.scale
        sizes = [(z.shape[1], HIDDEN), (HIDDEN, 1)]
        self.layers = [
            part
            for a, b in sizes
            for part in (random.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))
        ]
        self._learn(z[learn], y[learn], random)
        self.temperature = self._calibrate(z[held], y[held])

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum(z @ w1 + b1, 0)
        return hidden, (hidden @ w2 + b2)[:, 0]

    def _learn(self, z: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = random.permutation(len(y))
            for start in range(0, len(y), BATCH):
                rows = order[start:start + BATCH]
                hidden, logit = self._forward(z[rows])
                error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y[rows])[:, None] / len(rows)
                back = (error @ self.layers[2].T) * (hidden > 0)
                slopes = [z[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
                step += 1
                for k, slope in enumerate(slopes):
                    slope = slope + DECAY * self.layers[k]
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    mean, spread = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                    self.layers[k] = self.layers[k] - rate * mean / (np.sqrt(spread) + 1e-8)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss on rows left out."""
        logit = self._forward(z)[1]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.mean(np.logaddexp(0, logit / t) - y * logit / t) for t in tried]
        return float(tried[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.rate)
        logit = self._forward((x - self.shift) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _matrix(column) -> np.ndarray:
    width = 2 * DIMENSIONS + 1
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, width).astype(np.float64)


def train(vectors: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality") -> Network:
    """Network from about ``TRAIN_ROWS`` labelled documents at most; ``learn`` says which keys may be used."""
    rows = labels.filter(learn & F.col(label).isin(0, 1)).select(key, label)
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(max(n, 1))) < TRAIN_ROWS)
    data = vectors.join(rows, key).select(key, label, "vector").toPandas().sort_values([key, label])
    return Network(_matrix(data["vector"]), data[label].to_numpy(np.float64))


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``key``, ``score`` and ``predicted`` of every document."""
    vectors = materialize(document_vectors(docs, word_vectors(docs, text), key, text))
    network = train(vectors, labels, learn, key, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = network.probability(_matrix(batch.column("vector").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[key, "score", "predicted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return vectors.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def keep_good(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    least: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, as they are.

    Rows are scored where they lie, so repeated and null keys do no harm and no text is shuffled.
    """
    words = word_vectors(docs, text)
    # The kept rows are scored where they lie, so the vectors are for training only.
    with scratch(docs.sparkSession):
        network = train(materialize(document_vectors(docs, words, key, text)), labels, learn, key, label)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches_by_size(batches, text, 1 << 23):
            pooled = [pool(data, sent.value, buckets) for data in as_bytes(batch.column(text))]
            kept = network.probability(np.stack(pooled).astype(np.float64)) >= least
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
