"""Session defaults, lineage cuts and skew-safe row numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "trendspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class _Blocks:
    """Tables of the scratch blocks open in this thread.

    Functions travel by value, with the modules they name; a ``ContextVar`` does not. Their copy has no open block.
    """

    def __init__(self) -> None:
        self._open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
        self.get, self.set, self.reset = self._open.get, self._open.set, self._open.reset

    def __reduce__(self) -> tuple:
        return _Blocks, ()


#: Whether Spark deletes the shuffle files of a query at its end, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of local runs by application, removed when the process ends.
_OWN_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}
#: Tables written since the last release, and those of the open scratch blocks of this thread.
_WRITTEN: list[str] = []
_SCRATCH = _Blocks()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; only a local run without a configured one has its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _OWN_FOLDERS:
            _OWN_FOLDERS[context.applicationId] = tempfile.TemporaryDirectory(
                prefix="trendspark-", ignore_cleanup_errors=True
            )
        folder = _OWN_FOLDERS[context.applicationId].name
    return folder


def release(spark: SparkSession) -> None:
    """Delete the tables that cut lineage so far; frames that still read them are lost."""
    _delete(spark, list(_WRITTEN))


def _delete(spark: SparkSession, tables: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(conf).delete(path, True)
        if table in _WRITTEN:
            _WRITTEN.remove(table)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside the block go at its end.

    What comes out of the block is stored by the function that the block gets.
    """
    around, own = _SCRATCH.get(), []

    def keep(df: DataFrame) -> DataFrame:
        return _store(df, around)

    token = _SCRATCH.set((*around, own))
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
    # If the block fails, its tables wait for ``release``.
    _delete(spark, own)


def spread(df: DataFrame) -> DataFrame:
    """Widen a scan of fewer partitions than the cluster has cores; larger scans stay as they are.

    For scans only: counting the partitions of a plan with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, **options: object) -> DataFrame:
    """Cut lineage with a table in the shared folder; ``options`` are those of the writer.

    Unlike ``checkpoint()`` this computes the plan once, keeps column pruning and
    size statistics, and the files outlive any lost executor.
    """
    return _store(df, _SCRATCH.get(), **options)


def _store(df: DataFrame, blocks: tuple[list[str], ...], **options: object) -> DataFrame:
    """Table that the last of the scratch blocks deletes, if there is one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    # Noted first: a write that fails may leave files.
    _WRITTEN.append(path)
    for block in blocks[-1:]:
        block.append(path)
    with _tidy(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What begins inside the block leaves no shuffle files: a written table needs none. Sessions keep their setting."""
    before = spark.conf.get(TIDY, "false")
    if before == "true":
        yield
        return
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def with_position(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Zero-based position per ``keys`` in ``order``, without one task per key.

    Rows are range-partitioned, so a hot key spreads over many partitions; each
    partition numbers its own rows and adds the count of the partitions before it.
    ``order`` has to be unique within ``keys``.
    """
    keys, order = list(keys), list(order)
    ranged = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    match = numbered["_part"] == offsets["_part"]
    for key in keys:
        match = match & numbered[key].eqNullSafe(offsets[key])
    return numbered.join(offsets, match).select(
        *(numbered[c] for c in df.columns),
        (F.col("_local") + F.col("_offset") - 1).cast("bigint").alias(name),
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key, 1-based ``rank``.

    A bounded rank filter lets Spark keep only ``n`` rows per key on the map side.
    Spark does so up to 1,000 rows; above that a salted first round does the same.
    """
    if n > 1000:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_first", F.row_number().over(first))
            .filter(F.col("_first") <= n)
            .drop("_first", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
