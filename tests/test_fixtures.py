"""Small hand-made inputs with known results."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contourflow import bindings as B
from contourflow.functions import geometry
from contourflow.operators import clustering, contact, descriptors, fields, graph, learning, projection, selection, stationary, tables
from contourflow.plans import iterate
from contourflow.sources import outputs, structures
from contourflow.streaming import results


def test_layers_by_patch_distance():
    size = np.array([10, 12, 8, 9, 11, 10.0])
    mean = np.array([-0.22, -0.20, -0.02, 0, 0.21, 0.24])
    for n in (3, "auto"):
        assert contact.layer_labels(mean, size, n).tolist() == [1, 1, 0, 0, 2, 2]


def test_realspace_weights(spark):
    n = spark.createDataFrame([(i, float(i), 0.0, 0.0, p) for i, p in enumerate((2.0, 1.0, 2.0))], "point_index long, x double, y double, z double, probability double")
    near = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "point_index long, neighbour long")
    e = graph.build_graph(n, near, "realspace", realspace_weight=2.0).orderBy("source").collect()
    assert [(r["source"], r["target"]) for r in e] == [(0, 1), (1, 2)]
    assert all(abs(r["weight"] - math.sqrt(0.5) * 2) < 1e-12 for r in e)


@pytest.mark.parametrize("mode", ["shortest_path", "watershed", "region_grow"])
def test_chain_propagation(spark, mode):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "source long, target long, weight double")
    seeds = spark.createDataFrame([(i, 0) for i in (0, 1, 2)] + [(i, 1) for i in (5, 6, 7)], "node long, label long")
    nodes = spark.range(8).withColumnRenamed("id", "node")
    got = graph.assign(nodes, graph.propagation_scores(e, seeds, mode)).orderBy("node").collect()
    assert [r["label"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert not any(r["is_ambiguous"] for r in got)


def test_cosine_surface(spark):
    rows = [(i, j, 2 - math.cos(2 * math.pi * i / 8) - math.cos(2 * math.pi * j / 8)) for i in range(8) for j in range(8)]
    g = spark.createDataFrame(rows, "ix int, iy int, e double")
    got = stationary.stationary_points(g, "e", 8, 8, 1.0, 1.0).collect()
    found = {(r["type"], round(r["x"]) % 8, round(r["y"]) % 8) for r in got}
    assert found == {("minimum", 0, 0), ("maximum", 4, 4), ("saddle_1", 0, 4), ("saddle_1", 4, 0)}


def test_weighted_match(spark):
    ref = spark.createDataFrame([("minimum", 0.0, 0.0, 0.0), ("saddle_1", 1.0, 0.0, 0.05), ("minimum", 4.0, 0.0, 0.8), ("maximum", 2.0, 0.0, 1.0)], "type string, x double, y double, value double")
    pred = spark.createDataFrame([("minimum", 0.1, 0.0, 0.02), ("saddle_1", 1.2, 0.0, 0.0), ("maximum", 2.0, 0.0, 1.1)], "type string, x double, y double, value double")
    _, s = stationary.compare(ref, pred, xy_scale=0.5, energy_scale=0.05, weight_scale=0.1, max_xy=0.4, max_energy=0.1)
    assert (s["n_reference"], s["n_predicted"], s["n_matched"], s["n_missed"]) == (3, 2, 2, 1)
    assert s["weighted_recall"] > 0.99 and len(s) == 20


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in stationary.assignment(c))
        small, big = (c, m) if n <= m else (c.T, n)
        assert abs(got - min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))) < 1e-12


def test_parity(spark):
    df = spark.createDataFrame([(0.0, 0.1), (1.0, 0.8), (2.0, 2.3), (float("nan"), 1.0)], "r double, p double")
    m = tables.parity_metrics(df, "r", "p").first()
    assert m["n"] == 3 and abs(m["mae"] - 0.2) < 1e-9 and abs(m["mean_error"] - 0.2 / 3) < 1e-9
    assert abs(m["rmse"] - math.sqrt(0.14 / 3)) < 1e-9 and abs(m["median_abs_error"] - 0.2) < 1e-9


def _step(energy: float, force: float, unit: str, atoms: list[tuple]) -> list[str]:
    """What a program writes for one ionic step."""
    out = [f"!    total energy = {energy:.4f} Ry", f"  Total force = {force:.6f}   Total SCF correction = 0.000021", "  Forces acting on atoms (cartesian axes, Ry/au):", ""]
    out += [f"  atom {i + 1} type {i % 2 + 1} force = {0.01 * i:.8f} {-0.02 * i:.8f} {force / (i + 1):.8f}" for i in range(len(atoms))]
    return [*out, "", f"ATOMIC_POSITIONS ({unit})", *(f"{s} {x:.5f} {y:.5f} {z:.5f}" for s, x, y, z in atoms), ""]


ATOMS = [("Pt", 0.0, 0.0, 0.125), ("O", 0.25, 0.5, 0.25), ("H", 0.5, 0.25, 0.375)]
LOG = "\n".join(
    ["lattice parameter (alat) = 8.5000 a.u.", "CELL_PARAMETERS (angstrom)", "4.0 0.0 0.0", "1.0 4.0 0.0", "0.0 0.0 16.0", "iteration # 1 ecut= 30.00 Ry", "total energy = -87.1250 Ry", "estimated scf accuracy < 3.5E-07 Ry"]
    + _step(-87.25, 0.09, "crystal", ATOMS) + _step(-87.5, 0.03, "bohr", ATOMS) + _step(-87.75, 0.01, "alat", ATOMS[::-1]) + ["bfgs converged in 3 scf cycles and 2 bfgs steps"]
)


def test_output_log(spark):
    rows = outputs.marked(outputs.lines(spark.createDataFrame([("a", LOG), ("b", None)], "job string, content string"))).cache()
    s = outputs.summaries(rows).first()
    assert s["energy_history"] == [-87.25, -87.5, -87.75] and s["ionic_steps"] == 3 and s["relax_converged"] and s["last_force"] == 0.01
    assert outputs.scf_at(rows, 1).first()["scf_energy"] == -87.125 and outputs.scf_below(rows, 1e-6).first()["scf_accuracy"] == 3.5e-07
    bohr = 0.529177210903
    place = {b["block"]: (b["x"], b["y"], b["z"]) for b in outputs.last_atom_history(rows).collect()}
    np.testing.assert_allclose(place[1], (0.5 * 4 + 0.25, 0.25 * 4, 0.375 * 16))
    np.testing.assert_allclose(place[2], (0.5 * bohr, 0.25 * bohr, 0.375 * bohr))
    np.testing.assert_allclose(place[3], (0, 0, 0.125 * 8.5 * bohr))
    labelled = {b["block"]: b["z"] for b in outputs.last_atom_history(rows, label="h").collect()}
    np.testing.assert_allclose([labelled[b] for b in (1, 2, 3)], [6, 0.375 * bohr, 0.375 * 8.5 * bohr])
    assert outputs.last_atom_history(rows, label="Xe").count() == 0
    e = outputs.energies_with_geometry(rows).orderBy("step").collect()
    assert e[0]["z"] is None and e[1]["z"] == 6.0
    forces = {f["block"]: f["forces"] for f in outputs.force_blocks(rows).collect()}
    assert [f["fz"] for f in forces[1]] == [0.09, 0.045, 0.03] and forces[3][2]["fy"] == -0.04
    deck = outputs.marked(outputs.lines(spark.createDataFrame([("a", "&system\n celldm(1) = 8.5,\n/\natomic_positions {alat}\nH 0 0 2")], "job string, content string")))
    assert abs(outputs.last_atom_history(deck).first()["z"] - 2 * 8.5 * bohr) < 1e-12
    tries = spark.createDataFrame([("a", 0, "nothing"), ("a", 1, LOG), ("a", 2, "iteration # 1")], "job string, attempt int, content string")
    lines = tries.select("job", "attempt", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    assert outputs.pick_attempt(outputs.attempt_summaries(lines)).first()["attempt"] == 1


def test_layers_on_a_line_against_all_cuts():
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (6, 2), (9, 4), (12, 3)):
        v, w = rng.normal(size=n).round(1), rng.integers(1, 9, n).astype(float)
        cost = lambda lab: sum((w[lab == c] * (v[lab == c] - np.average(v[lab == c], weights=w[lab == c])) ** 2).sum() for c in np.unique(lab))  # noqa: E731, B023
        got = contact.kmeans_1d(v, w, k)
        order = np.argsort(v, kind="stable")
        least = min(cost(np.searchsorted(cuts, np.argsort(order), side="right")) for cuts in itertools.combinations(range(1, n), min(k, n) - 1))
        assert abs(cost(got) - least) < 1e-9 and len(np.unique(got)) == min(k, n) and (np.diff(got[order]) >= 0).all()


def test_diatomic_fit(spark):
    h = spark.createDataFrame([("a", r, 18 * (r - 0.74) ** 2) for r in (0.80, 0.74, 0.70, 0.76)], "job string, r double, energy double")
    f = outputs.diatomic_fit(h).first()
    assert abs(f["r_eq"] - 0.74) < 1e-6 and abs(f["curvature"] - 36) < 1e-6 and abs(f["wavenumber"] - 4406) < 5 and abs(f["zero_point"] - 0.273) < 1e-3


def test_history_and_adsorption(spark):
    df = spark.createDataFrame([(7, [-1.0, -1.2, -1.3], [1.5, 1.4, 1.3])], "point_index long, E_bfgs_steps_Ry array<double>, z_H_bfgs_steps_A array<double>")
    rows = learning.relax_steps(df).orderBy("bfgs_step").collect()
    assert [r["distance"] for r in rows] == [1.5, 1.4, 1.3]
    res = spark.createDataFrame([(0, -15.0)], "map_index long, E_bfgs_final_Ry double")
    ref = spark.createDataFrame([("clean_slab", 0, -10.0), ("H2", None, -6.0)], "name string, map_index long, value double")
    assert outputs.adsorption_energy(res, ref).first()["E_ads_Ry"] == -2.0


def test_selections(spark):
    f = np.array([[0, 0], [10, 0], [9, 0], [0, 10.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(f)], "point_index long, f1 double, f2 double")
    got = selection.greedy_select(df, 2, ["f1", "f2"], space=(), seeds=df.where("point_index = 0"))
    assert {g[0] for g in got} == {1, 3}
    assert [i for i, _ in selection.pivoted_cholesky(np.array([[0.0], [1.0], [10.0]]), 2, gamma=0.1)] == [0, 2]
    assert [i for i, _ in selection.pivoted_qr(np.array([[1, 0], [0, 1], [0.9, 0.1]]), 2)] == [0, 1]


def test_descriptor_arrays_match_sql_sums(spark):
    sf = "/root/testdata/sf0.001"
    p, a = B.points(spark, sf).where("point_index < 60"), B.atoms(spark, sf)
    one = descriptors.descriptor_arrays(p, a, B.BOX, 3.0, 4, 3).toPandas().set_index("point_index")
    pairs = descriptors.neighbour_pairs(p, a, B.BOX, 3.0)
    two = descriptors.chebyshev_radial(pairs, range(4), 3.0).toPandas().set_index("point_index")
    three = descriptors.chebyshev_angular(pairs, range(3), 3.0).toPandas().set_index("point_index")
    for i, row in two.iterrows():
        np.testing.assert_allclose(one.loc[i].radial, [row[f"ACSF_RS_r3.0_{n:03d}"] for n in range(4)], atol=1e-9)
    for i, row in three.iterrows():
        np.testing.assert_allclose(one.loc[i].angular, [row[f"ACSF_AS_r3.0_{n:03d}"] for n in range(3)], atol=1e-9)


def test_many_atoms_take_cells(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    p, a = B.points(spark, sf).where("point_index < 200"), B.atoms(spark, sf)
    want = {tuple(r) for r in descriptors.neighbour_pairs(p, a, B.BOX, 3.0).select("point_index", "atom_index").collect()}
    monkeypatch.setattr(descriptors, "MOST_BROADCAST_ATOMS", 3)
    assert {tuple(r) for r in descriptors.neighbour_pairs(p, a, B.BOX, 3.0).select("point_index", "atom_index").collect()} == want


def test_structures(spark, tmp_path):
    (tmp_path / "set_3").mkdir()
    (tmp_path / "set_3" / "a.xyz").write_text('1\nLattice="5 0 0 0 5 0 0 0 5" Origin="0 0 1"\nH 1 2 3\n')
    files = structures.find_files(spark, str(tmp_path / "set_3"), "*.xyz")
    assert files.first()["source_folder_number"] == 3.0
    atom = structures.read_atoms(files, units="angstrom").first()
    assert (atom["symbol"], atom["ax"], atom["origin"][2]) == ("H", 1.0, 1.0)
    cells = geometry.grid_cells(spark, (2, 2, 3), np.eye(3)).withColumn("value", F.col("cell_id").cast("double"))
    structures.write_cube(cells, "value", (2, 2, 3), np.eye(3).tolist(), (0, 0, 0), [("H", 0.0, 0.0, 0.0)], str(tmp_path / "cube"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "cube")).collect())
    assert structures.parse_cube(text, "angstrom")["values"] == [float(i) for i in range(12)]


def test_geometry():
    assert geometry.grid_scalars(np.eye(3) * 10, 300) == tuple([geometry.next_smooth(int(math.sqrt(300) / geometry.BOHR * 10 / math.pi))] * 3)
    assert geometry.next_smooth(7) == 8 and geometry.is_smooth(45)
    assert abs(fields.charge_volume(0, 2.0, 0.01) - 4 * math.pi / 3 * 8) < 0.01


def test_minimum_image_general_cell(spark):
    cell = np.array([[4, 0, 0], [1, 4, 0], [0, 0, 5.0]])
    rng = np.random.default_rng(1)
    v = rng.uniform(-9, 9, (20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "i int, x double, y double, z double")
    got = df.select("i", geometry.minimum_image([F.col(c) for c in "xyz"], cell)["r"].alias("r")).orderBy("i").toPandas()
    frac = v @ np.linalg.inv(cell)
    base = (frac - np.floor(frac)) @ cell
    want = np.min([np.linalg.norm(base - np.array(s) @ cell, axis=1) for s in np.ndindex(2, 2, 2)], axis=0)
    np.testing.assert_allclose(got["r"], want, atol=1e-9)


def test_erfc_approximation(spark):
    from contourflow.functions.radial import erfc, erfc_exact

    x = spark.createDataFrame([(float(v),) for v in np.linspace(-3, 3, 25)], "x double").select("x", erfc(F.col("x")).alias("a"), erfc_exact("x").alias("b")).toPandas()
    assert (x["a"] - x["b"]).abs().max() < 2e-7 and abs(x["b"].iloc[0] - math.erfc(-3)) < 1e-12


def test_components_and_tree(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "src long, dst long")
    got = dict(map(tuple, iterate.components(nodes, edges).collect()))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    pts = spark.createDataFrame([(i, [v]) for i, v in enumerate((0.0, 0.1, 5.0, 5.1))], "point_index long, v array<double>")
    tree = {(r["source"], r["target"]) for r in graph.spanning_tree(pts, "v").collect()}
    assert tree == {(0, 1), (1, 2), (2, 3)}


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (15, 2)), rng.normal(5, 0.1, (15, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_index long, f1 double, f2 double")
    for m in ("kmeans", "agglomerative", "spectral"):
        got = clustering.relabel(clustering.fit_predict(df, ["f1", "f2"], m, 2), ["f1", "f2"]).orderBy("point_index").toPandas()
        assert got["Cluster"].tolist() == [0] * 15 + [1] * 15, m
    with pytest.raises(ValueError):
        clustering.fit_predict(df, ["f1"], "kmeans", 2, edges=df)
    p = clustering.PCA(df, ["f1", "f2"])
    assert abs(p.cumulative[-1] - 1) < 1e-9 and p.explained_variance_ratio[0] > 0.99


def test_gaussian_process():
    x = np.linspace(0, 3, 12)[:, None]
    y = np.sin(2 * x[:, 0])
    gp = learning.GaussianProcess(["distance"], "y", starts=[np.array([0.5]), np.array([1.0])]).fit_arrays(x, y)
    m, s = gp.predict_arrays(x + 0.1)
    assert np.abs(m - np.sin(2 * x[:, 0] + 0.2)).max() < 0.1 and (s >= 0).all()
    assert np.abs(gp.leave_one_out() - y).mean() < 0.2


def test_registry(spark):
    reg = spark.createDataFrame([(1, "a", "unlabeled"), (2, "a", "completed"), (1, "b", "failed")], "point_index long, kind string, label_status string")
    new = spark.createDataFrame([(1, "a", "completed"), (3, "a", "unlabeled")], "point_index long, kind string, label_status string")
    got = {tuple(r) for r in tables.upsert(reg, new, ["point_index", "kind"]).select("point_index", "kind", "label_status").collect()}
    assert got == {(1, "a", "completed"), (2, "a", "completed"), (1, "b", "failed"), (3, "a", "unlabeled")}
    with pytest.raises(ValueError):
        tables.registry_frame(reg, status="odd")


def test_projection_duplicates(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "ix int, iy int, e double")
    with pytest.raises(Exception, match="repeated cell"):
        projection.projection_grid(df, "e", ("ix", "iy"), [0]).collect()


def test_streamed_outputs(spark, tmp_path):
    for job, text in (("qe_job_1", LOG), ("qe_job_2", "nothing")):
        (tmp_path / "in" / job).mkdir(parents=True)
        (tmp_path / "in" / job / "espresso.pwo").write_text(text)
    seen: list[pd.DataFrame] = []
    q = results.collect(results.last_energies(results.watch_outputs(spark, str(tmp_path / "in"))), lambda df, _: seen.append(df.toPandas()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = pd.concat(seen).set_index("job")
    assert got.loc["qe_job_1"].energy == -87.75 and got.loc["qe_job_2"].label_status == "failed"


@pytest.mark.parametrize("method", ["pivoted_qr", "pivoted_cholesky"])
def test_pivoting_reads_every_row(spark, monkeypatch, method):
    x = np.random.default_rng(4).normal(size=(5050, 3))
    x[5040] *= 50
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "point_index long, f0 double, f1 double, f2 double")
    got = selection.pivoted_rows(df.repartition(3), "point_index", ["f0", "f1", "f2"], 3, method)
    want = getattr(selection, method)(x, 3)
    assert [i for i, _ in got] == [i for i, _ in want] and 5040 in [i for i, _ in got]
    assert np.allclose([s for _, s in got], [s for _, s in want])


def test_paths_that_do_not_settle_raise(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "source long, target long, weight double")
    seeds = spark.createDataFrame([(0, 1)], "node long, label int")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(e, seeds, most=3)
    assert graph.shortest_paths(e, seeds).count() == 7
