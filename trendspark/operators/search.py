"""Vector search and the stored vector table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendspark.operators import knn
from trendspark.operators.embedding import hashed_vector
from trendspark.session import materialize


#: Hits of ids and numbers that are sent to every task; more are joined by a shuffle.
BROADCAST_HITS = 100_000


def vector_search(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    category: str | None = None,
    metadata: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Nearest base rows with ``metadata`` and squared distance; real rows only, no padding."""
    if category is not None:
        queries = queries.filter(F.col("category") == category)
        base = base.filter(F.col("category") == category)
    hits = knn.knn_join(queries, base, k, **options)
    result = hits.withColumn("distance", F.col("d2")).drop("d2")
    if not metadata:
        return result
    # Hits are rows of the base: an inner join loses none, and a small side may be broadcast.
    result = materialize(result)
    if result.count() <= BROADCAST_HITS:
        result = F.broadcast(result)
    return base.select("category", "id", *metadata).join(result, ["category", "id"])


def build_vector_table(points: DataFrame, path: str, cell_rows: int = knn.BLOCK_ROWS, mode: str = "error") -> None:
    """Vectors with metadata, split by category and ordered by cell, and their cell table.

    Row groups hold few cells, so a search reads only those of the cells it visits.
    """
    vectors = points.withColumn("vector", F.col("vector").cast("array<double>"))
    pivots = knn.choose_pivots(vectors, vectors.count(), cell_rows)
    assigned = materialize(knn.assign_cells(vectors, pivots))
    (
        assigned.repartitionByRange("category", "cell", "id")
        .sortWithinPartitions("category", "cell", "radius")
        .write.mode(mode)
        .partitionBy("category")
        .parquet(f"{path}/vectors")
    )
    near = assigned.groupBy("category", "cell").agg(
        F.max("radius").alias("reach"), F.min("radius").alias("closest"), F.count(F.lit(1)).alias("n")
    )
    rows = [
        (category, i, pivot.tolist())
        for category, matrix in pivots.items()
        for i, pivot in enumerate(matrix)
    ]
    table = points.sparkSession.createDataFrame(rows, "category string, cell int, pivot array<double>")
    table.join(near, ["category", "cell"]).write.mode(mode).parquet(f"{path}/cells")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of a stored table; categories stay text, whatever they look like."""
    vectors = spark.read.parquet(f"{path}/vectors")
    fields = [StructField("category", StringType()) if f.name == "category" else f for f in vectors.schema]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/vectors")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and cells of a stored table."""
    return read_stored(spark, path), spark.read.parquet(f"{path}/cells")


def visited_cells(queries: DataFrame, cells: DataFrame, k: int) -> list[tuple[str, list[int]]]:
    """Cells by category that can hold a hit of any query.

    The cells' table is bounded by the byte budget of pivots and goes to every task.
    """
    rows = cells.orderBy("category", "cell").toPandas()
    shared = cells.sparkSession.sparkContext.broadcast(rows)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {name: group for name, group in shared.value.groupby("category")}
        for batch in batches:
            for name, asked in batch.groupby("category"):
                if name not in own:
                    continue
                known = own[name]
                reach = known["reach"].to_numpy()[None, :]
                pivots, met = knn.matrix(known["pivot"]), np.zeros(len(known), bool)
                for rows_ in knn.row_slices(asked, len(known)):
                    part = knn.matrix(rows_["vector"])
                    to_pivot = np.sqrt(knn.squared_distances(part, pivots))
                    # All n rows of a cell lie within its reach: enough cells bound the k-th distance.
                    farthest = to_pivot + reach
                    order = farthest.argsort(1)
                    filled = known["n"].to_numpy()[order].cumsum(1) >= k
                    last = np.where(filled.any(1), filled.argmax(1), len(known) - 1)[:, None]
                    kth = np.take_along_axis(farthest, np.take_along_axis(order, last, 1), 1)[:, 0]
                    bound = np.where(filled.any(1), kth, np.inf)
                    slack = knn.SLACK * (1 + to_pivot.max())
                    met |= (to_pivot - reach <= bound[:, None] + slack).any(0)
                yield pd.DataFrame({"category": name, "cell": known["cell"].to_numpy()[met]})

    asked = queries.select("category", "vector").mapInPandas(visit, "category string, cell int")
    found = asked.distinct().groupBy("category").agg(F.collect_list("cell").alias("cells")).collect()
    return [(r["category"], r["cells"]) for r in found]


def search_table(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    category: str | None = None,
    metadata: Sequence[str] = (),
) -> DataFrame:
    """Exact search in a stored table, reading only the cells that can hold a hit of some query."""
    vectors, cells = read_table(spark, path)
    if category is not None:
        queries = queries.filter(F.col("category") == category)
        cells = cells.filter(F.col("category") == category)
    wanted = F.lit(False)
    for name, visited in visited_cells(queries, cells, k):
        wanted = wanted | ((F.col("category") == name) & F.col("cell").isin(visited))
    return vector_search(queries, vectors.filter(wanted), k, metadata=metadata)


def write_encoder(idf: DataFrame, path: str, mode: str = "error") -> None:
    """What a later query text needs to get into the space of the stored vectors."""
    idf.write.mode(mode).parquet(f"{path}/idf")


def search_text(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    category: str | None = None,
    metadata: Sequence[str] = (),
    text: str = "text",
    dim: int = 64,
) -> DataFrame:
    """Search by text: ``queries`` has ``query_id`` and ``text``, and ``category`` unless one is given.

    Texts are encoded by the IDF stored beside the vectors. Without a category every category is asked.
    """
    encoded = queries.withColumn("vector", hashed_vector(F.col(text), spark.read.parquet(f"{path}/idf"), dim))
    if category is not None:
        encoded = encoded.withColumn("category", F.lit(category))
    elif "category" not in queries.columns:
        known = read_table(spark, path)[1].select("category").distinct()
        names = [F.lit(r["category"]) for r in known.collect()]
        encoded = encoded.withColumn("category", F.explode(F.array(*names)))
    asked = encoded.select("category", "query_id", "vector")
    return search_table(spark, path, materialize(asked), k, category, metadata)
