"""What the n-gram join keeps on disk: entries, texts on their way, shuffle files."""

import numpy as np
import pytest
from conftest import rows

from trendspark import session
from trendspark.llm import jaccard_join
from trendspark.session import materialize


def drawn(rng, words=120):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, words))


@pytest.fixture
def near(spark):
    """Documents of which every second has a near copy, and every fourth is there three times."""
    rng, data = np.random.default_rng(11), []
    for i in range(60):
        text = drawn(rng)
        data += [(3 * i, text), *[(500 + 3 * i + k, text) for k in range(2) if i % 4 == 0]]
        if i % 2:
            data.append((3 * i + 1, f"{text} one more"))
    return spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_entries_come_back_as_they_were_packed():
    ref = np.array([0, 0, 2, 3, 3, 900, 70_000, 70_000, 1 << 23], np.int32)
    entry = np.arange(9, dtype=np.uint32) * np.uint32(477_218_588)
    node, n, own, found = jaccard_join.expand(jaccard_join.shrink(5, ref, entry))
    assert (node[own] == (5 << jaccard_join.PLACE_BITS) + ref.astype(np.int64)).all() and len(n) == len(node) == 6
    assert found.tolist() == entry.tolist()


def test_entries_take_no_more_room_in_more_buckets(spark):
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(i, drawn(rng)) for i in range(400)], "doc_id bigint, text string").repartition(1)
    few, many = (
        jaccard_join.list_entries(docs, buckets, "doc_id", "text").selectExpr("sum(length(blob))").first()[0]
        for buckets in (2, 40)
    )
    assert many < 1.25 * few


@pytest.mark.parametrize("slice_bytes", [1 << 22, 900])
def test_copies_in_other_slices_are_one_set(spark, near, monkeypatch, slice_bytes):
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", slice_bytes)
    found = jaccard_join.components(near)
    assert rows(found.select("component_id").distinct()) == rows(spark.range(0, 180, 3))
    assert {r["component_id"] for r in found.collect() if r["doc_id"] % 3 == 1} <= {3 * i for i in range(60)}
    assert rows(jaccard_join.keep_one(near).select("doc_id")) == rows(spark.range(0, 180, 3))


def test_texts_are_dealt_once(near):
    near.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard_join.keep_one(near.union(near))._jdf.queryExecution().executedPlan().toString()
        text = [line for line in plan.splitlines() if "Exchange hashpartitioning(_set" in line]
        assert len(text) == 1 and "SortMergeJoin" in plan
    finally:
        near.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_come_twice_and_null_keys_stay_once(spark):
    rng = np.random.default_rng(13)
    texts = [drawn(rng) for _ in range(4)]
    data = [(None, texts[0]), (None, texts[0]), (4, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (7, texts[3])]
    kept = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert rows(kept) == rows(spark.createDataFrame([data[i] for i in (2, 3, 5, 7)], kept.schema))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    setting, before = spark.conf.get(session.TIDY, "false"), shuffle_files(spark)
    stored = materialize(spark.range(1000).groupBy("id").count())
    assert not shuffle_files(spark) - before
    assert stored.count() == 1000 and spark.conf.get(session.TIDY, "false") == setting
