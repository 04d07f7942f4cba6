"""Annotations, metadata, global registries, radii, and saved tables."""

import pytest

from contourflow.operators import collection
from contourflow.sources import store


def test_annotations(spark):
    points = spark.createDataFrame([(0, 1.0), (1, 2.0)], "point_index long, x double")
    values = spark.createDataFrame([(1, 5), (0, 4)], "point_index long, v int")
    got, features = collection.annotate(points, values, "v", ["f1"])
    assert sorted(map(tuple, got.collect())) == [(0, 1.0, 4.0), (1, 2.0, 5.0)] and features == ["f1", "v"]
    assert collection.annotate(got, values, "v", features, as_feature=False)[1] == ["f1"]
    for bad, name in ((values.limit(1), "v"), (values.union(values), "v"), (points, "x")):
        with pytest.raises(ValueError):
            collection.annotate(points, bad, name)
    assert collection.contact_column(points, values, "v", ["point_index"]).count() == 2
    with pytest.raises(ValueError):
        collection.contact_column(points, values, "w", ["point_index"])


def test_metadata_keeps_what_it_does_not_know(spark):
    points = spark.createDataFrame([(0, 0, "a"), (1, 0, "b")], "map_index int, point_index long, folder string")
    meta = spark.createDataFrame([(1, None, 7.0)], "map_index int, folder string, t double")
    got = collection.attach_metadata(points, meta).orderBy("map_index").select("map_index", "folder", "t")
    assert [tuple(r) for r in got.collect()] == [(0, "a", None), (1, None, 7.0)]


def test_global_registry(spark):
    points = spark.createDataFrame([(g, g // 3, g % 3) for g in range(6)], "global_point_index long, map_index int, point_index long")
    registry = spark.createDataFrame([(0, 1, "centroid", 1, "completed"), (1, 1, "archetype", 1, "completed")], "map_index int, point_index long, kind string, iteration int, label_status string")
    chosen = spark.createDataFrame([(4, 0.5), (5, 0.25)], "global_point_index long, score double")
    got = collection.register_global(registry, points, chosen, "archetype", 2)
    rows = sorted((r.map_index, r.point_index, r.kind, r.iteration, r.score) for r in got.collect())
    assert rows == [(0, 1, "centroid", 1, None), (1, 1, "archetype", 2, 0.5), (1, 2, "archetype", 2, 0.25)]
    assert sorted(r[0] for r in collection.global_ids(got, points).collect()) == [1, 4, 5]
    fresh = collection.register_global(registry, points, chosen.limit(0), "archetype", replace_kind=True)
    assert [r.kind for r in fresh.collect()] == ["centroid"]
    with pytest.raises(ValueError):
        collection.register_global(registry, points, spark.createDataFrame([(9,)], "global_point_index long"), "archetype")


def test_radii(spark):
    table = spark.createDataFrame([("H", 1.5, 1.25, 3.0, 2.5)], "symbol string, pauling double, bondi double, uff double, muff double")
    assert [collection.radii_of(table, m).first().radius for m in ("pauling", "bondi", "uff", "muff")] == [1.5, 1.25, 1.5, 1.25]
    with pytest.raises(ValueError):
        collection.radii_of(table, "other")


def test_saved_tables(spark, tmp_path):
    folder = str(tmp_path / "maps")
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder)
    points = spark.createDataFrame([(0, 0, 1.5), (1, 0, None), (12, 3, 2.5)], "map_index int, point_index long, x double")
    names = spark.createDataFrame([("a",)], "name string")
    store.save(spark, folder, {"points": points.limit(0)})
    assert store.load(spark, folder)[0]["points"].count() == 0
    store.save(spark, folder, {"points": points, "names": names}, {"features": ["x"]})
    tables, settings = store.load(spark, folder)
    assert settings == {"features": ["x"]} and tables["points"].dtypes == points.dtypes
    assert sorted(map(str, tables["points"].collect())) == sorted(map(str, points.collect())) and tables["names"].first()[0] == "a"
    assert [r[0] for r in store.pending(points, points.where("map_index < 5")).collect()] == [12]
    assert store.pending(points, None).count() == 3


def test_special_points_are_selected_and_registered(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1), (1, 0.0, 0.0, 1.0, 10.0, 0.0, 0.1), (2, 0.0, 0.0, 2.0, 9.0, 0.0, 0.9), (3, 0.0, 0.0, 3.0, 0.0, 10.0, 0.1)]
    points = spark.createDataFrame(rows, "point_index long, x double, y double, z double, f1 double, f2 double, u double")
    registry = spark.createDataFrame([(0, "centroid", 1, "completed")], "point_index long, kind string, iteration int, label_status string")
    got = collection.select_special_points(registry, points, 2, iteration=2, features=["f1", "f2"])
    new = sorted((r.selection_rank, r.point_index, r.iteration, r.label_status) for r in got.where("kind = 'adaptive'").collect())
    assert {p for _, p, _, _ in new} == {1, 3} and [(a, c, e) for a, _, c, e in new] == [(0, 2, "unlabeled"), (1, 2, "unlabeled")]
    unsure = collection.select_special_points(registry, points, 1, feature_weight=0.0, uncertainty="u", uncertainty_weight=1.0)
    assert [r.point_index for r in unsure.where("kind = 'adaptive'").collect()] == [2]
    with pytest.raises(ValueError):
        collection.select_special_points(registry, points, 4, features=["f1"])
    with pytest.raises(ValueError):
        collection.select_special_points(registry, points, 1, energy_weight=1.0)


def test_archetypes_propagate_along_a_chain(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(9)], "point_index long, x double")
    edges = spark.createDataFrame(
        [(i, i + 1, 1.0, 0.0, 1.0, 1.0, 1.0) for i in range(7)],
        "source long, target long, realspace_component double, feature_component double, directional_factor double, node_factor double, weight double",
    )
    got = collection.propagate_archetypes(edges, nodes, [7, 0], mode="shortest_path").orderBy("point_index").collect()
    assert [r.assigned_archetype_index for r in got] == [0, 0, 0, 0, 7, 7, 7, 7, -1]
    assert [r.assigned_archetype_rank for r in got] == [1, 1, 1, 1, 0, 0, 0, 0, -1]
    assert [r.is_ambiguous for r in got] == [False] * 8 + [True]
    assert all(abs(r.archetype_score_0 + r.archetype_score_1 - 1) < 1e-12 for r in got[:8]) and got[8].archetype_score_0 == 0
    for bad in ([], [1, 1], [99]):
        with pytest.raises(ValueError):
            collection.propagate_archetypes(edges, nodes, bad)
