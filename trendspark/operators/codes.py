"""Approximate vector search: inverted lists of product-quantised codes, several lists per query, exact re-rank.

A vector lies in the list of its nearest centre, as one byte per part of its difference to the centre. A
query probes the lists of its nearest centres; distances are added up from a small table per part, and
only the best of them are measured on the vectors themselves. Centres and codes are fitted on a bounded
sample, every row is indexed. Lists are stored in blocks of bounded size, so a long list has many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.operators import knn
from trendspark.operators.search import read_stored
from trendspark.session import materialize, top_per_group

#: Vectors that centres and codes are fitted on, at most.
SAMPLE = 1 << 15
MOST_LISTS, CODES, ROUNDS = 1 << 10, 256, 8
BLOCK_ROWS = 1 << 13
#: Lists by category that a scan is filtered by; beyond, the join alone decides.
FILTERED = 500


def centres(vectors: np.ndarray, many: int, seed: int = 1) -> np.ndarray:
    """Means of groups of vectors, by a few rounds of nearest means."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.choice(len(vectors), min(many, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(vectors, found)
        size = np.bincount(own, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, own, vectors)
        some = size > 0
        found[some] = total[some] / size[some, None]
    return found


def nearest(vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // len(marks))
    parts = [
        knn.squared_distances(vectors[i:i + step], marks).argmin(1) for i in range(0, len(vectors), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Model:
    """Centres of lists, and for each part of a vector's difference to its centre the values of the codes."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int) -> None:
        self.marks = centres(sample, lists)
        rest = sample - self.marks[nearest(sample, self.marks)]
        self.bounds = np.linspace(0, sample.shape[1], parts + 1).astype(int)
        self.values = [centres(rest[:, a:b], CODES) for a, b in self.slots()]

    def slots(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(vectors, self.marks)
        rest = vectors - self.marks[own]
        codes = [nearest(rest[:, a:b], v) for (a, b), v in zip(self.slots(), self.values, strict=True)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def distances(self, query: np.ndarray, mark: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to the coded vectors of a list."""
        rest, total = query - self.marks[mark], np.zeros(len(codes))
        for i, ((a, b), values) in enumerate(zip(self.slots(), self.values, strict=True)):
            total += ((values - rest[a:b]) ** 2).sum(1)[codes[:, i]]
        return total


def build_code_table(
    points: DataFrame, path: str, lists: int | None = None, parts: int = 16, mode: str = "error"
) -> None:
    """Lists of codes beside the vectors and their metadata, and the model that made them.

    ``points`` are ``(category, id, vector)`` with any further columns; ``lists`` is by default the root
    of their number, at most ``MOST_LISTS``.
    """
    spark = points.sparkSession
    vectors = materialize(points.withColumn("vector", F.col("vector").cast("array<double>")))
    n = vectors.count()
    share = max(1, min(1_000_000, SAMPLE * 1_000_000 // max(n, 1)))
    drawn = vectors.filter(F.pmod(F.xxhash64("category", "id"), F.lit(1_000_000)) < share)
    sample = drawn.select("vector").limit(2 * SAMPLE).toPandas()["vector"]
    if not len(sample):
        raise ValueError("no vectors to index")
    model = Model(knn.matrix(sample), lists or max(1, min(MOST_LISTS, int(n ** 0.5))), parts)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, codes = shared.value.encode(knn.matrix(batch["vector"]))
            yield batch.assign(list=own.astype("int32"), code=[c.tobytes() for c in codes])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    coded = materialize(vectors.mapInPandas(run, f"{schema}, list int, code binary"))
    sizes = coded.groupBy("category", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = materialize(sizes)
    blocked = coded.join(F.broadcast(sizes) if n <= FILTERED * BLOCK_ROWS else sizes, ["category", "list"])
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    (
        blocked.repartitionByRange("category", "list", "block", "id").sortWithinPartitions("category", "list", "block")
        .write.mode(mode).partitionBy("category").parquet(f"{path}/vectors")
    )
    sizes.write.mode(mode).parquet(f"{path}/lists")
    rows = [("mark", i, v.tolist()) for i, v in enumerate(model.marks)]
    for part, values in enumerate(model.values):
        rows += [(f"part {part}", i, v.tolist()) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "kind string, number int, value array<double>").write.mode(mode).parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    """The stored model: at most ``MOST_LISTS`` centres and ``CODES`` values a part."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "number").toPandas()
    model = Model.__new__(Model)
    model.marks = knn.matrix(rows[rows["kind"] == "mark"]["value"])
    parts = sorted((k for k in rows["kind"].unique() if k != "mark"), key=lambda k: int(k.split()[1]))
    model.values = [knn.matrix(rows[rows["kind"] == k]["value"]) for k in parts]
    model.bounds = np.cumsum([0] + [v.shape[1] for v in model.values])
    return model


def search_codes(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    probes: int = 8,
    rerank: int = 20,
    metadata: Sequence[str] = (),
) -> DataFrame:
    """``(category, query_id, id, rank, distance)`` and ``metadata`` of nearly the nearest rows.

    ``queries`` are ``(category, query_id, vector)``. A query probes ``probes`` lists and measures its
    ``k * rerank`` best codes; distances given out are exact. All lists and a large ``rerank`` are exact.
    """
    model, table = spark.sparkContext.broadcast(read_model(spark, path)), read_stored(spark, path)
    sizes = spark.read.parquet(f"{path}/lists")
    asked = queries.select("category", "query_id", F.col("vector").cast("array<double>").alias("asked"))
    key, id_type = (f.dataType.simpleString() for f in (asked.schema["query_id"], table.schema["id"]))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = model.value.marks
        for batch in batches:
            for part in knn.row_slices(batch, len(marks)):
                far = knn.squared_distances(knn.matrix(part["asked"]), marks)
                order = far.argsort(axis=1, kind="stable")[:, :probes]
                yield part.assign(list=list(order.astype("int32"))).explode("list").astype({"list": "int32"})

    probed = asked.mapInPandas(probe, f"category string, query_id {key}, asked array<double>, list int")
    # Only lists that are there, block by block.
    probed = materialize(
        probed.join(sizes, ["category", "list"]).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).drop("blocks")
    )
    visited = probed.select("category", "list").distinct().limit(FILTERED + 1).collect()
    if len(visited) <= FILTERED:
        wanted = F.lit(False)
        for category in sorted({r["category"] for r in visited}):
            own = [r["list"] for r in visited if r["category"] == category]
            wanted = wanted | ((F.col("category") == category) & F.col("list").isin(own))
        table = table.filter(wanted)
    keys, best = ["category", "list", "block"], k * rerank

    def measure(coded: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(coded) and len(asking):
            codes = np.stack([np.frombuffer(c, np.uint8) for c in coded["code"]])
            mark, ids = int(coded["list"].iloc[0]), coded["id"].to_numpy()
            for query, vector in zip(asking["query_id"], asking["asked"], strict=True):
                far = model.value.distances(np.asarray(vector), mark, codes)
                first = np.argsort(far, kind="stable")[:best]
                out.append(pd.DataFrame({"query_id": query, "id": ids[first], "about": far[first]}))
        if not out:
            return pd.DataFrame(columns=["category", "query_id", "id", "about"])
        return pd.concat(out).assign(category=coded["category"].iloc[0])[["category", "query_id", "id", "about"]]

    about = (
        table.select(*keys, "id", "code").groupBy(*keys)
        .cogroup(probed.groupBy(*keys))
        .applyInPandas(measure, f"category string, query_id {key}, id {id_type}, about double")
    )
    close = top_per_group(about, ["category", "query_id"], [F.col("about"), F.col("id")], best)
    close = close.select("category", "query_id", "id")
    gap = F.zip_with("vector", "asked", lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x)
    rows = table.select("category", "id", "vector", *metadata)
    measured = close.join(rows, ["category", "id"]).join(asked, ["category", "query_id"])
    measured = measured.withColumn("distance", F.round(distance, knn.DIGITS)).drop("vector", "asked")
    return top_per_group(measured, ["category", "query_id"], [F.col("distance"), F.col("id")], k)
