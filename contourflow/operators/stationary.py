"""Stationary points of a regular two-dimensional map, and their comparison between maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stencil(grid: DataFrame, value: str, nx: int, ny: int, periodic: tuple[bool, bool] = (True, True), groups: Sequence[str] = ()) -> DataFrame:
    """``groups, ix, iy`` with the values of the 3 x 3 patch as ``z00 ... z22`` (row: ix - 1 ... ix + 1).

    Every cell sends its value to its nine neighbours, so the patch is one grouped aggregation. Across an
    edge that is not periodic values are missing.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = grid.select(*groups, F.col("ix"), F.col("iy"), F.col(value).alias("z"), F.explode(steps).alias("o"))
    tx, ty = F.col("ix") - F.col("o.i"), F.col("iy") - F.col("o.j")
    if not periodic[0]:
        sent = sent.where(tx.between(0, nx - 1))
    if not periodic[1]:
        sent = sent.where(ty.between(0, ny - 1))
    sent = sent.select(*groups, F.pmod(tx, F.lit(nx)).alias("ix"), F.pmod(ty, F.lit(ny)).alias("iy"), F.col("o.i").alias("i"), F.col("o.j").alias("j"), "z")
    cells = [F.max(F.when((F.col("i") == i - 1) & (F.col("j") == j - 1), F.col("z"))).alias(f"z{i}{j}") for i in range(3) for j in range(3)]
    return sent.groupBy(*groups, "ix", "iy").agg(*cells).where("z11 is not null")


def derivatives(patches: DataFrame, dx: float, dy: float) -> DataFrame:
    """Central differences: ``gx, gy, gnorm, hxx, hyy, hxy``; null where a neighbour is missing."""
    z = F.col
    return patches.withColumns({
        "gx": (z("z21") - z("z01")) / (2 * dx),
        "gy": (z("z12") - z("z10")) / (2 * dy),
        "hxx": (z("z21") - 2 * z("z11") + z("z01")) / (dx * dx),
        "hyy": (z("z12") - 2 * z("z11") + z("z10")) / (dy * dy),
        "hxy": (z("z22") - z("z20") - z("z02") + z("z00")) / (4 * dx * dy),
    }).withColumn("gnorm", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def candidates(points: DataFrame, nx: int, ny: int, periodic: tuple[bool, bool] = (True, True), gradient_tolerance: float | None = None, value_extrema: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """Cells with the least gradient of their 3 x 3 patch, up to the tolerance (its 10 % quantile by default), or an extremal value."""
    if gradient_tolerance is None:
        gradient_tolerance = points.agg(F.percentile("gnorm", 0.1)).first()[0] or 0.0
    around = stencil(points.select(*groups, "ix", "iy", "gnorm"), "gnorm", nx, ny, periodic, groups)
    names = [f"z{i}{j}" for i in range(3) for j in range(3)]
    least = around.select(*groups, "ix", "iy", F.least(*names).alias("_least"))
    rows = points.join(least, [*groups, "ix", "iy"])
    by_gradient = (F.col("gnorm") <= F.col("_least")) & (F.col("gnorm") <= gradient_tolerance)
    extremal = (F.col("z11") <= F.least(*names)) | (F.col("z11") >= F.greatest(*names)) if value_extrema else F.lit(False)
    return rows.where(by_gradient | extremal).drop("_least")


def quadratic(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """Least-squares quadratic of each full 3 x 3 patch: ``c0 ... c5`` (value, x, y, xx/2, xy, yy/2 derivatives over
    offsets), the Newton step ``sx, sy``, the value there and the eigenvalues ``e1 <= e2`` of its Hessian."""
    cell = {(i, j): F.col(f"z{i + 1}{j + 1}") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    total = lambda w: sum((cell[k] * float(w(*k)) for k in cell), F.lit(0.0))
    out = points.withColumns({
        "c1": total(lambda i, j: i) / (6 * dx),
        "c2": total(lambda i, j: j) / (6 * dy),
        "c3": total(lambda i, j: i * i - 2 / 3) / (2 * dx * dx),
        "c4": total(lambda i, j: i * j) / (4 * dx * dy),
        "c5": total(lambda i, j: j * j - 2 / 3) / (2 * dy * dy),
    }).withColumn("c0", total(lambda i, j: 1 / 9) - 2 / 3 * (F.col("c3") * dx * dx + F.col("c5") * dy * dy))
    a, b, d = 2 * F.col("c3"), F.col("c4"), 2 * F.col("c5")
    det = a * d - b * b
    ok = F.abs(det) > 1e-300
    sx = F.when(ok, (b * F.col("c2") - d * F.col("c1")) / det)
    sy = F.when(ok, (b * F.col("c1") - a * F.col("c2")) / det)
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    out = out.withColumns({"sx": sx, "sy": sy, "e1": (a + d) / 2 - root, "e2": (a + d) / 2 + root})
    s, t = F.col("sx"), F.col("sy")
    return out.withColumn("value", F.col("c0") + F.col("c1") * s + F.col("c2") * t + F.col("c3") * s * s + F.col("c4") * s * t + F.col("c5") * t * t)


def _apart(a: np.ndarray, b: np.ndarray, periods: Sequence[float | None]) -> np.ndarray:
    d = a - b
    for k, p in enumerate(periods):
        if p:
            d[..., k] -= p * np.round(d[..., k] / p)
    return d


def stationary_points(grid: DataFrame, value: str, nx: int, ny: int, dx: float, dy: float, periodic: tuple[bool, bool] = (True, True), gradient_tolerance: float | None = None, curvature_tolerance: float = 1e-8, merge: float | None = None, value_extrema: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, type, x, y, value``: minima, maxima and first-order saddles.

    Candidates whose Newton step stays within their patch are classified by the signs of the Hessian's
    eigenvalues; of those of one type nearer than ``merge`` (one cell by default) the one with the least
    gradient stays. Only candidates, few per map, are merged in one task per map.
    """
    points = derivatives(stencil(grid, value, nx, ny, periodic, groups), dx, dy)
    found = quadratic(candidates(points, nx, ny, periodic, gradient_tolerance, value_extrema, groups), dx, dy)
    found = found.where((F.abs("sx") <= dx) & (F.abs("sy") <= dy))
    flat = curvature_tolerance
    kind = (
        F.when((F.col("e1") > flat) & (F.col("e2") > flat), "minimum")
        .when((F.col("e1") < -flat) & (F.col("e2") < -flat), "maximum")
        .when((F.col("e1") < -flat) & (F.col("e2") > flat), "saddle_1")
    )
    wrap = lambda c, n, p: F.when(F.lit(p), c - n * F.floor(c / n)).otherwise(c)
    rows = found.select(
        *groups, kind.alias("type"), wrap(F.col("ix") * dx + F.col("sx"), nx * dx, periodic[0]).alias("x"),
        wrap(F.col("iy") * dy + F.col("sy"), ny * dy, periodic[1]).alias("y"), "value", "gnorm",
    ).where("type is not null")
    near = max(dx, dy) if merge is None else merge
    periods = [nx * dx if periodic[0] else None, ny * dy if periodic[1] else None]

    def dedupe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gnorm", "x", "y"])
        kept: list = []
        for r in pdf.itertuples(index=False):
            at = np.array([[r.x, r.y]])
            if not kept or (np.linalg.norm(_apart(at, np.array([[k.x, k.y] for k in kept]), periods), axis=1) >= near).all():
                kept.append(r)
        return pd.DataFrame(kept, columns=pdf.columns).drop(columns="gnorm")

    schema = ", ".join(f"`{g}` {t}" for g, t in rows.drop("gnorm").dtypes)
    return rows.groupBy(*groups, "type").applyInPandas(dedupe, schema)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of the assignment with the least total cost: shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = owner[j0]
            reduced = c[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(done[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def compare(reference: DataFrame, predicted: DataFrame, types: Sequence[str] = ("minimum", "saddle_1"), axes: Sequence[str] = ("x", "y"), energy: str = "value", periods: Sequence[float | None] = (None, None), xy_scale: float = 1.0, energy_scale: float = 0.05, weight_scale: float = 0.1, max_xy: float | None = None, max_energy: float | None = 0.25, beta: float = 1.0, type_weights: dict[str, float] | None = None) -> tuple[pd.DataFrame, dict]:
    """Optimal one-to-one matching of stationary points per type, and its summary.

    Cost is the root of squared scaled distance plus ``beta`` times squared scaled energy difference;
    pairs beyond a tolerance cost 1e12 more and come out as ``outside_tolerance``. Reference points weigh
    exp(-(E - min E) / weight_scale) times their type's weight. Both tables are small, one row per
    stationary point, and are matched on the driver.
    """
    tw = type_weights or {}
    ref = reference.where(F.col("type").isin(list(types))).toPandas().reset_index(drop=True)
    pred = predicted.where(F.col("type").isin(list(types))).toPandas().reset_index(drop=True)
    weights = np.zeros(len(ref))
    if len(ref):
        weights = np.exp(-(ref[energy] - ref[energy].min()) / weight_scale).to_numpy() * np.array([tw.get(t, 1.0) for t in ref["type"]])
        weights = weights / weights.sum() if weights.sum() > 0 else weights
    rows = []
    for t in types:
        r, p = ref.index[ref["type"] == t].to_numpy(), pred.index[pred["type"] == t].to_numpy()
        used_r, used_p = set(), set()
        if len(r) and len(p):
            d = _apart(pred.loc[p, list(axes)].to_numpy(float)[None] - 0.0, ref.loc[r, list(axes)].to_numpy(float)[:, None], periods)
            dxy = np.linalg.norm(d, axis=2)
            de = pred.loc[p, energy].to_numpy(float)[None] - ref.loc[r, energy].to_numpy(float)[:, None]
            cost = np.sqrt((dxy / xy_scale) ** 2 + beta * (de / energy_scale) ** 2)
            bad = np.zeros_like(cost, bool)
            if max_xy is not None:
                bad |= dxy > max_xy
            if max_energy is not None:
                bad |= np.abs(de) > max_energy
            for i, j in assignment(cost + 1e12 * bad):
                used_r.add(r[i])
                used_p.add(p[j])
                rows.append({"type": t, "status": "outside_tolerance" if bad[i, j] else "matched", "reference_index": int(r[i]), "predicted_index": int(p[j]), "dxy": dxy[i, j], "delta_x": d[i, j, 0], "delta_y": d[i, j, 1], "delta_energy": de[i, j], "cost": cost[i, j], "weight": weights[r[i]]})
        rows += [{"type": t, "status": "missed", "reference_index": int(i), "weight": weights[i]} for i in r if i not in used_r]
        rows += [{"type": t, "status": "extra", "predicted_index": int(j), "weight": 0.0} for j in p if j not in used_p]
    table = pd.DataFrame(rows, columns=["type", "status", "reference_index", "predicted_index", "dxy", "delta_x", "delta_y", "delta_energy", "cost", "weight"])
    hit = table[table["status"] == "matched"]
    n = len(hit)
    w = hit["weight"].to_numpy(float)
    mean = lambda c, f=np.abs: float(np.mean(f(hit[c].to_numpy(float)))) if n else float("nan")
    rms = lambda c: float(np.sqrt(np.mean(hit[c].to_numpy(float) ** 2))) if n else float("nan")
    weighted = lambda c: float(np.average(np.abs(hit[c].to_numpy(float)), weights=w)) if n and w.sum() > 0 else float("nan")
    recall, precision = (n / len(ref) if len(ref) else float("nan")), (n / len(pred) if len(pred) else float("nan"))
    summary = {
        "n_reference": len(ref), "n_predicted": len(pred), "n_matched": n, "n_missed": len(ref) - n, "n_extra": len(pred) - n,
        "recall": recall, "precision": precision, "f1": 2 * recall * precision / (recall + precision) if n else 0.0,
        "weighted_recall": float(w.sum()), "mean_dxy": mean("dxy"), "rms_dxy": rms("dxy"), "max_dxy": float(hit["dxy"].max()) if n else float("nan"),
        "weighted_dxy": weighted("dxy"), "mean_abs_energy": mean("delta_energy"), "rms_energy": rms("delta_energy"),
        "weighted_abs_energy": weighted("delta_energy"), "mean_energy": mean("delta_energy", lambda x: x), "mean_cost": mean("cost"), "weighted_cost": weighted("cost"),
        "n_outside_tolerance": int((table["status"] == "outside_tolerance").sum()),
    }
    return table, summary
