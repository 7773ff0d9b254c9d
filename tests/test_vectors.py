import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from trendspark.operators import clustering, components, density, embedding, knn, reduce, search, spanning

CELLS = dict(broadcast_bytes=0, cell_rows=25, block_rows=16)


def frame(spark, ids, vectors, category="c"):
    return spark.createDataFrame(
        [(category, int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)],
        "category string, id bigint, vector array<double>",
    )


@pytest.fixture(scope="module")
def planted():
    """Four blobs, scattered points, and copies of one vector."""
    rng = np.random.default_rng(1)
    blobs = [rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 5.2, 9)]
    vectors = np.vstack([*blobs, rng.uniform(-3, 12, (30, 3)), np.ones((12, 3)) * 2])
    ids = [int(i * 7 % 1000) for i in range(len(vectors))]
    return ids, vectors


def nearest(ids, vectors, k):
    d = ((vectors[:, None] - vectors[None]) ** 2).sum(-1)
    return {
        i: sorted((round(d[n, m], 9), j) for m, j in enumerate(ids) if j != i)[:k] for n, i in enumerate(ids)
    }


@pytest.mark.parametrize("options", [{}, CELLS])
def test_knn_graph(spark, planted, options):
    ids, vectors = planted
    found = {}
    for r in knn.knn_graph(frame(spark, ids, vectors), 5, **options).collect():
        found.setdefault(r.src, []).append((round(r.d2, 9), r.dst))
    assert {i: sorted(v) for i, v in found.items()} == nearest(ids, vectors, 5)


def test_few_queries_against_many_rows(spark, planted):
    ids, vectors = planted
    base = frame(spark, ids, vectors)
    queries = base.filter("id < 30").withColumnRenamed("id", "query_id")
    some = knn.knn_join(queries, base, 4, broadcast_bytes=88 * 20)
    assert rows(some, "query_id", "id", "rank") == rows(knn.knn_join(queries, base, 4), "query_id", "id", "rank")


def test_search_hits(spark):
    base = frame(spark, [1, 2, 3], [[0, 0], [0, 0], [3, 4]]).withColumn("title", F.concat(F.lit("t"), "id"))
    queries = base.filter("id = 1").withColumnRenamed("id", "query_id")
    hits = search.vector_search(queries, base, 5, "c", ["title"]).orderBy("rank").collect()
    assert [(h.id, h.distance, h.title) for h in hits] == [(1, 0.0, "t1"), (2, 0.0, "t2"), (3, 25.0, "t3")]
    assert search.vector_search(queries, base, 5, "absent").isEmpty()


def test_stored_table_prunes_and_stays_exact(spark, planted, tmp_path):
    ids, vectors = planted
    base = frame(spark, ids, vectors)
    search.build_vector_table(base, str(tmp_path / "v"), cell_rows=20)
    queries = base.filter("id < 20").withColumnRenamed("id", "query_id")
    found = search.search_table(spark, str(tmp_path / "v"), queries, 5, "c")
    assert rows(found, "query_id", "id", "rank") == rows(search.vector_search(queries, base, 5), "query_id", "id", "rank")
    assert spark.read.parquet(str(tmp_path / "v" / "cells")).count() > 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 49), (49, 48), (60, 50)] + [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame([("c", a, b) for a, b in edges], "category string, a bigint, b bigint")
    nodes = spark.range(200).select(F.lit("c").alias("category"), F.col("id").alias("node"))
    found = {r.node: r.component for r in components.connected_components(df, nodes).collect()}
    wanted = {n: n for n in range(200)}
    wanted |= {n: 0 for n in range(31)} | {n: 48 for n in (48, 49, 50, 60)} | {n: 100 for n in range(100, 160)}
    assert found == wanted


@pytest.mark.parametrize("options", [{}, CELLS])
def test_spanning_tree_is_exact(spark, planted, options):
    ids, vectors = planted
    tree = spanning.spanning_tree(frame(spark, ids, vectors), 5, **options)
    found = {(round(r.w, 9), r.a, r.b) for r in tree.collect()}
    assert found == {(round(w, 9), a, b) for w, a, b in brute.spanning_tree(ids, vectors, 5)}


@pytest.mark.parametrize("size,piece_rows", [(5, 500_000), (12, 2)])
def test_density_clusters_match_brute_force(spark, planted, size, piece_rows):
    ids, vectors = planted
    tree = brute.spanning_tree(ids, vectors, 5)
    wanted = brute.density_labels(ids, tree, size)
    assert max(wanted.values()) >= 3
    points = frame(spark, ids, vectors).unionByName(frame(spark, [1, 2, 3], np.eye(3), "tiny"))
    found = density.density_cluster(points.repartition(3), size, 5, piece_rows=piece_rows)
    labels = {(r.category, r.id): r.topic for r in found.collect()}
    assert len(labels) == len(ids) + 3
    assert {i: labels["c", i] for i in ids} == wanted
    assert {labels["tiny", i] for i in (1, 2, 3)} == {-1}


def test_topic_clustering_recovers_blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:4] * 10
    vectors = np.vstack([rng.normal(c, 0.2, (15, 8)) for c in centres])
    points = frame(spark, range(60), vectors, "nba")
    found = {r.id: r.topic for r in clustering.cluster_topics(points).collect()}
    groups = [{found[i] for i in range(s, s + 15)} - {-1} for s in range(0, 60, 15)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    with pytest.raises(ValueError):
        clustering.cluster_topics(points, "other")


def test_assignment_and_map(spark):
    vectors = np.vstack([np.eye(4)[0] + np.eye(4) * 0.1, np.eye(4)[1] * 9 + np.eye(4) * 0.1])
    points = frame(spark, range(8), vectors).withColumn("topic", F.when(F.col("id") < 4, 0).otherwise(1))
    regions = clustering.topic_regions(points)
    fresh = frame(spark, [90, 91, 92], [vectors[0], vectors[5], [50, 50, 50, 50]])
    assert rows(clustering.assign_topics(fresh, regions), "id", "topic") == [(90, 0), (91, 1), (92, -1)]
    flat = reduce.reduce_dims(points, ["c"], 2)
    assert {len(r.vector) for r in flat.collect()} == {2}
    assert reduce.topic_map(points, ["c"]).count() == 2


def test_reduction_without_spread(spark):
    one = frame(spark, [1], [[3, 4, 0]], "solo").unionByName(frame(spark, [2, 3], [[1, 0, 0], [1, 0, 0]], "same"))
    mixed = one.unionByName(frame(spark, range(10, 16), np.eye(6)[:, :3] + 0.1, "c"))
    found = reduce.reduce_dims(mixed, None, 2).collect()
    assert len(found) == 9 and all(v == 0 for r in found if r.category != "c" for v in r.vector)
    axes = reduce.principal_axes(mixed, 2).filter("category = 'c'").first()
    a = np.array(axes.axes)
    assert np.allclose(a @ a.T, np.eye(2)) and axes.variances[0] >= axes.variances[1] > 0
    assert reduce.topic_map(one.withColumn("topic", F.lit(0))).count() == 2


def test_stored_categories_stay_text(spark, planted, tmp_path):
    ids, vectors = planted
    base = frame(spark, ids, vectors, "007").withColumn("title", F.concat(F.lit("t"), "id"))
    search.build_vector_table(base, str(tmp_path / "v"), cell_rows=20)
    queries = base.filter("id < 3").select("category", F.col("id").alias("query_id"), "vector")
    found = search.search_table(spark, str(tmp_path / "v"), queries, 5, metadata=["title"]).collect()
    assert len(found) == 5 * queries.count() and all(r.title == f"t{r.id}" and r.category == "007" for r in found)


def test_metadata_of_few_hits_never_sorts_the_base(spark, planted):
    ids, vectors = planted
    base = frame(spark, ids, vectors).withColumn("title", F.lit("t"))
    queries = base.filter("id = 1").select("category", F.col("id").alias("query_id"), "vector")
    plan = search.vector_search(queries, base, 5, metadata=["title"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_search_by_text(spark, tmp_path):
    posts = spark.createDataFrame(
        [("nba", 1, "guard dunk rim"), ("nba", 2, "trade draft"), ("soccer", 3, "goal keeper")],
        "category string, id bigint, text string",
    )
    idf = embedding.train_idf(posts, "text")
    stored = embedding.embed_text(posts, idf, "text").withColumnRenamed("embedding", "vector")
    search.build_vector_table(stored, str(tmp_path / "v"))
    search.write_encoder(idf, str(tmp_path / "v"))
    asked = spark.createDataFrame([(7, "a draft trade"), (8, "goal")], "query_id bigint, text string")
    found = search.search_text(spark, str(tmp_path / "v"), asked, 1, metadata=["text"]).collect()
    best = {q: min((r for r in found if r.query_id == q), key=lambda r: r.distance).text for q in (7, 8)}
    assert best == {7: "trade draft", 8: "goal keeper"}
    only = search.search_text(spark, str(tmp_path / "v"), asked, 5, "nba").collect()
    assert {r.id for r in only} == {1, 2}


def test_code_table_recall(spark, tmp_path):
    """Nearly all true neighbours by probing an eighth of the lists; all of them with every list."""
    from trendspark.operators import codes

    rng = np.random.default_rng(8)
    vectors = np.vstack([rng.normal(c, 0.5, (60, 32)) for c in rng.normal(0, 1, (40, 32))])
    base = frame(spark, range(len(vectors)), vectors, "007").withColumn("title", F.concat(F.lit("t"), "id"))
    base = base.unionByName(frame(spark, [9_000], [vectors[0]], "solo").withColumn("title", F.lit("s")))
    codes.build_code_table(base, str(tmp_path / "c"), lists=48)
    queries = base.filter("id % 25 = 0").select("category", F.col("id").alias("query_id"), "vector")
    exact = {(r.category, r.query_id, r.id) for r in search.vector_search(queries, base, 5).collect()}
    found = codes.search_codes(spark, str(tmp_path / "c"), queries, 5, probes=6, metadata=["title"]).collect()
    got = {(r.category, r.query_id, r.id) for r in found}
    assert len(got & exact) >= 0.9 * len(exact) and all(r.title in (f"t{r.id}", "s") for r in found)
    assert all(r.distance == pytest.approx(((vectors[r.query_id] - vectors[r.id]) ** 2).sum()) for r in found if r.id < 9_000)
    every = codes.search_codes(spark, str(tmp_path / "c"), queries, 5, probes=48, rerank=1_000)
    assert {(r.category, r.query_id, r.id) for r in every.collect()} == exact
    with pytest.raises(ValueError):
        codes.build_code_table(base.filter("false"), str(tmp_path / "none"))
