"""What must hold beyond the sizes of the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourflow.llm import toxicity
from contourflow.operators import clustering, contact
from contourflow.plans import iterate


def _greedy_ward(x, k):
    label, n = np.arange(len(x)), len(x)
    while n > k:
        kinds = np.unique(label)
        center, size = np.array([x[label == c].mean(axis=0) for c in kinds]), np.array([(label == c).sum() for c in kinds])
        d = ((center[:, None] - center[None]) ** 2).sum(axis=2) * (size[:, None] * size / (size[:, None] + size))
        np.fill_diagonal(d, np.inf)
        i, j = sorted(divmod(int(d.argmin()), n))
        label[label == kinds[j]] = kinds[i]
        n -= 1
    return np.unique(label, return_inverse=True)[1]


@pytest.mark.parametrize(("n", "k"), [(60, 4), (61, 1), (5, 5), (3, 9), (0, 2)])
def test_ward_chain_is_greedy(n, k):
    x = np.random.default_rng(n).normal(size=(n, 3))
    assert clustering.ward(x, k).tolist() == _greedy_ward(x, k).tolist()
    twice = np.repeat(x, 2, axis=0)
    assert clustering.ward(twice, k).tolist() == _greedy_ward(twice, k).tolist()


def test_spectral_by_blocks_is_dense(spark):
    x = np.random.default_rng(3).normal(size=(300, 4)) * 0.3
    want = clustering.spectral(np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2)), 4)
    assert clustering.spectral_by_blocks(spark, x, 4).tolist() == want.tolist()


@pytest.mark.parametrize("method", ["agglomerative", "spectral"])
def test_clusters_of_over_5000_points(spark, method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (2600, 2)), rng.normal(5, 0.1, (2501, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_index long, f1 double, f2 double")
    got = clustering.relabel(clustering.fit_predict(df, ["f1", "f2"], method, 2), ["f1", "f2"]).orderBy("point_index").toPandas()
    assert got["Cluster"].tolist() == [0] * 2600 + [1] * 2501


def _visited(n, edges):
    """Regions by a traversal from the smallest point not yet visited, along the edges."""
    out = [-1] * n
    for start in range(n):
        stack = [start] if out[start] < 0 else []
        while stack:
            i = stack.pop()
            out[i] = out[start] if out[start] >= 0 else max(out) + 1
            stack += [b for a, b in edges if a == i and out[b] < 0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_regions_follow_directed_edges(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (70, 2))]
    edges += [(b, a) for a, b in edges[:30]]
    points = spark.range(60).withColumnRenamed("id", "point_index")
    e = spark.createDataFrame([(a, 0, b) for a, b in edges] + [(0, 1, -1)], "point_index long, direction int, neighbour long")
    got = contact.regions(points, e).orderBy("point_index").toPandas()
    assert got["region"].tolist() == _visited(60, edges)


def test_regions_beyond_the_grid(spark):
    """A point beyond the last plane is nobody's neighbour, although it has neighbours."""
    points = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 7), (3, 0, 0, 4)], "point_index long, ix int, iy int, iz int")
    got = contact.regions(points, contact.neighbour_edges(points, (3, 3, 6))).orderBy("point_index").toPandas()
    assert got["region"].tolist() == [0, 0, 1, 2]


def test_regions_broadcast_no_points(spark):
    """Points take little room in their file and much in a broadcast, which the driver would have to hold."""
    cells = spark.range(40_000).withColumnRenamed("id", "point_index").where("point_index div 400 % 2 = 0")  # every other plane
    points = iterate.settle(cells.selectExpr("*", "int(point_index % 20) AS ix", "int(point_index div 20 % 20) AS iy", "int(point_index div 400) AS iz"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100k")
    try:
        got = contact.regions(points, contact.neighbour_edges(points, (20, 20, 100))).toPandas()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 20_000 and (got["region"] == got["point_index"] // 800).all()


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    toxic = F.col("doc_id") % 10 == 0
    docs = spark.range(12_500).withColumnRenamed("id", "doc_id")
    docs = docs.withColumn("text", F.concat(F.when(toxic, "you fool ").otherwise("fine day "), "doc_id"))
    seen, pairs = [], toxicity._pairs
    monkeypatch.setattr(toxicity, "_pairs", lambda picked: seen.append(picked.count()) or pairs(picked))
    toxicity.with_toxicity(docs, docs.select("doc_id", toxic.cast("int").alias("toxic")))
    assert seen == [docs.where(~toxicity.held_out(F.col("doc_id"))).count()]
