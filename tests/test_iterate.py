"""Iterative plans: size estimates, limits and trees over several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourflow.operators.graph import spanning_tree
from contourflow.plans import iterate


def test_components_of_a_long_shuffled_chain(spark, monkeypatch):
    """Thirty rounds and more on a chain whose edges tasks cannot contract; no round's plan may grow."""
    monkeypatch.setattr(iterate, "_contracted", lambda batches: batches)
    rng = np.random.default_rng(0)
    name = rng.permutation(600).tolist()
    edges = spark.createDataFrame([(name[i], name[i + 1]) for i in range(599) if i != 250], "src long, dst long")
    got = iterate.components(spark.range(600).withColumnRenamed("id", "node"), edges).toPandas().set_index("node")["root"]
    assert set(got[name[:251]]) == {min(name[:251])} and set(got[name[251:]]) == {min(name[251:])}


def test_contracted_edges_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(iterate, "MOST_EDGES", 7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20], "src long, dst long").repartition(3)
    got = iterate.components(spark.range(65).withColumnRenamed("id", "node"), edges).toPandas().set_index("node")["root"]
    assert all(got[i] == (1 if 0 < i <= 20 else 21 if 20 < i <= 40 else 41 if 40 < i <= 60 else i) for i in range(65))
    none = iterate.components(spark.range(3).withColumnRenamed("id", "node"), edges.limit(0))
    assert sorted(map(tuple, none.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_settled_frames_forget_their_estimates(spark):
    df = spark.range(10).withColumn("v", F.lit(1))
    for _ in range(6):
        df = iterate.settle(df.join(df.withColumnRenamed("v", "w"), "id").select("id", "v"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_a_round_limit_is_an_error(spark):
    with pytest.raises(RuntimeError):
        iterate.until_stable(spark.range(1), lambda d: d.select((F.col("id") + 1).alias("id")), lambda d: tuple(d.first()), 3)


@pytest.mark.parametrize("block_rows", [1000, 12, 5])
def test_spanning_tree_against_kruskal(spark, block_rows):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 5, (40, 3)).astype(float)  # many ties and equal points
    pairs = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), i, j) for i in range(40) for j in range(i + 1, 40))
    label, want = list(range(40)), []
    for d, i, j in pairs:
        if label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
            want.append((i, j, d))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_index long, v array<double>")
    assert sorted(map(tuple, spanning_tree(rows, "v", block_rows=block_rows).collect())) == sorted(want)
    assert spanning_tree(rows.limit(1), "v").count() == 0 and spanning_tree(rows.limit(0), "v").count() == 0
