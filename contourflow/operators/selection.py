"""Selecting diverse or informative points: greedy, pivoted and archetype selections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .tables import normalize


def energy_component(df: DataFrame, energy: str, mode: str = "global_minimum", gradient: Column | None = None, curvatures: Sequence[str] = (), orders: Sequence[int] = (0,), gradient_tolerance: float = 1e-6, curvature_tolerance: float = 1e-8) -> DataFrame:
    """Adds ``energy_component`` in [0, 1], highest where the energy is lowest.

    ``stationary`` only scores points with a vanishing gradient whose number of negative curvatures is in
    ``orders`` and whose curvatures all exceed the tolerance: half to one among them.
    """
    if mode == "global_minimum":
        return normalize(df.withColumn("_e", -F.col(energy)), "_e", "energy_component").drop("_e")
    clear = gradient <= gradient_tolerance
    for c in curvatures:
        clear = clear & (F.abs(c) > curvature_tolerance)
    negative = sum((F.when(F.col(c) < -curvature_tolerance, 1).otherwise(0) for c in curvatures), F.lit(0))
    ok = clear & negative.isin(list(orders))
    rows = normalize(df.withColumn("_e", F.when(ok, -F.col(energy))), "_e", "_n", constant=1.0)
    return rows.withColumn("energy_component", F.when(F.col("_e").isNull(), 0.0).otherwise(0.5 + 0.5 * F.col("_n"))).drop("_e", "_n")


def greedy_select(
    df: DataFrame, n: int, features: Sequence[str] = (), space: Sequence[str] = ("x", "y", "z"), key: str = "point_index", seeds: DataFrame | None = None,
    real_weight: float = 0.0, feature_weight: float = 1.0, extra: Sequence[tuple[str, float]] = (), scale: bool = True,
) -> list[tuple[int, float]]:
    """``(key, score)`` of ``n`` points, greedily by the weighted sum of min-max normalised components.

    Components are the least distances, in space and in scaled features, to the seeds and the points chosen
    so far, and further columns; each is normalised over the remaining candidates in every round. Seeds are
    no candidates. The lowest key of equal scores is chosen. Distances are kept as columns and updated by
    the last choice, so a round is one aggregation and one top-1.
    """
    rows = df
    if scale and features:
        s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
        rows = rows.withColumns({f"_f_{c}": (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in features})
    else:
        rows = rows.withColumns({f"_f_{c}": F.col(c).cast("double") for c in features})
    spaces = [(real_weight, list(space), "_dr"), (feature_weight, [f"_f_{c}" for c in features], "_df")]
    spaces = [(w, cols, d) for w, cols, d in spaces if w and cols]
    known = [r for r in seeds.select(key).distinct().join(rows, key).collect()] if seeds is not None else []
    cand = rows.join(seeds.select(key).distinct(), key, "left_anti") if seeds is not None else rows

    def apart(cols: list[str], r) -> Column:
        return F.sqrt(sum(((F.col(c) - float(r[c])) ** 2 for c in cols), F.lit(0.0)))

    for _, cols, d in spaces:
        near = F.least(*[apart(cols, r) for r in known]) if len(known) > 1 else apart(cols, known[0]) if known else F.lit(0.0)
        cand = cand.withColumn(d, near)
    cand = settle(cand.select(key, *dict.fromkeys([*sum((c for _, c, _ in spaces), []), *[d for _, _, d in spaces], *[c for c, _ in extra]])))
    parts = [(d, w) for w, _, d in spaces] + [(c, w) for c, w in extra if w]
    chosen: list[tuple[int, float]] = []
    for step in range(n):
        ends = cand.agg(*[F.min(c).alias(f"lo{i}") for i, (c, _) in enumerate(parts)], *[F.max(c).alias(f"hi{i}") for i, (c, _) in enumerate(parts)]).first()
        score = F.lit(0.0)
        for i, (c, w) in enumerate(parts):
            lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
            if lo is not None and abs(hi - lo) > 1e-8 + 1e-5 * abs(lo):
                score = score + w * (F.col(c) - lo) / (hi - lo)
        best = cand.select("*", score.alias("_score")).orderBy(F.desc("_score"), F.asc(key)).limit(1).collect()
        if not best:
            raise ValueError("there are too few candidates")
        r = best[0]
        chosen.append((r[key], r["_score"]))
        cand = cand.where(F.col(key) != r[key])
        for _, cols, d in spaces:
            first = step == 0 and not known
            cand = cand.withColumn(d, apart(cols, r) if first else F.least(F.col(d), apart(cols, r)))
        if (step + 1) % 8 == 0:
            cand = settle(cand)
    return chosen


def pivoted_qr(x: np.ndarray, n: int, seeds: np.ndarray | None = None) -> list[tuple[int, float]]:
    """Rows chosen by column-pivoted QR of the transposed features, after the seeds' span is projected out."""
    r = np.array(x, float)
    if seeds is not None and len(seeds):
        q, s, _ = np.linalg.svd(np.asarray(seeds, float).T, full_matrices=False)
        q = q[:, s > 1e-12 * max(1.0, s.max(initial=0))]
        r = r - r @ q @ q.T
    out = []
    free = np.ones(len(r), bool)
    for _ in range(min(n, len(r))):
        norms = np.where(free, np.einsum("ij,ij->i", r, r), -1.0)
        i = int(norms.argmax())
        out.append((i, float(np.sqrt(max(norms[i], 0.0)))))
        free[i] = False
        if norms[i] > 0:
            u = r[i] / np.sqrt(norms[i])
            r = r - np.outer(r @ u, u)
    return out


def rbf_gamma(x: np.ndarray, gamma: float | str) -> float:
    """A number, ``median`` (one over the median positive squared distance of up to 1000 rows) or ``scale`` (one over the features)."""
    if not isinstance(gamma, str):
        return float(gamma)
    if gamma != "median":
        return 1.0 / x.shape[1]
    rows = x if len(x) <= 1000 else x[np.linspace(0, len(x) - 1, 1000).astype(int)]
    d = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    d = d[np.triu_indices(len(rows), 1)]
    d = d[d > 0]
    return 1.0 / float(np.median(d)) if len(d) else 1.0


def pivoted_cholesky(x: np.ndarray, n: int, seeds: np.ndarray | None = None, gamma: float | str = "median", tolerance: float = 1e-12) -> list[tuple[int, float]]:
    """Rows chosen by pivoted Cholesky factorisation of their RBF kernel; seeds lower the residual by their greatest squared kernel."""
    x = np.asarray(x, float)
    g = rbf_gamma(x, gamma)
    kernel = lambda a: np.exp(-g * ((x - a) ** 2).sum(axis=1))
    residual = np.ones(len(x))
    if seeds is not None and len(seeds):
        residual -= np.max([kernel(s) ** 2 for s in np.asarray(seeds, float)], axis=0)
    columns, out = [], []
    free = np.ones(len(x), bool)
    for _ in range(min(n, len(x))):
        i = int(np.where(free, residual, -np.inf).argmax())
        out.append((i, float(residual[i])))
        free[i] = False
        column = kernel(x[i]) - sum((c * c[i] for c in columns), np.zeros(len(x)))
        column /= np.sqrt(max(residual[i], tolerance))
        columns.append(column)
        residual = np.maximum(residual - column**2, 0.0)
    return out


def pivoted_rows(df: DataFrame, node: str, features: Sequence[str], n: int, method: str = "pivoted_qr", gamma: float | str = "median", tolerance: float = 1e-12) -> list[tuple[int, float]]:
    """:func:`pivoted_qr` or :func:`pivoted_cholesky` over all rows of a table of any length, as (node, score).

    A round is one pass: every row's residual follows from the rows picked so far, and only the best row of a
    task leaves it (of equal ones the least node). Residuals of QR that are rounding alone count as zero.
    """
    if method not in ("pivoted_qr", "pivoted_cholesky"):
        raise ValueError(f"unknown method: {method}")
    qr = method == "pivoted_qr"
    rows = settle(df.select(F.col(node).cast("long").alias("node"), *[F.col(c).cast("double").alias(c) for c in features]))
    g = 0.0
    if not qr:
        size = rows.count()
        at = set(np.linspace(0, max(size - 1, 0), min(size, 1000)).astype(int).tolist())
        some = rows.orderBy("node").rdd.zipWithIndex().filter(lambda x: x[1] in at).map(lambda x: tuple(x[0])[1:]).collect()
        g = rbf_gamma(np.array(some, float).reshape(-1, len(features)), gamma)
    # QR: the directions taken out; Cholesky: picked rows, their columns' values at the picked rows, and pivots
    taken: list[tuple] = []

    def residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if qr:
            r = x.copy()
            for (u,) in taken:
                r -= (r * u).sum(axis=1)[:, None] * u
            norms, whole = (r * r).sum(axis=1), (x * x).sum(axis=1)
            return np.where(norms > 1e-24 * whole, norms, 0.0), r
        left, columns = np.ones(len(x)), np.zeros((len(x), len(taken)))
        for k, (row, values, pivot) in enumerate(taken):
            c = np.exp(-g * ((x - row) ** 2).sum(axis=1)) - (columns[:, :k] * values).sum(axis=1)
            columns[:, k] = c / np.sqrt(max(pivot, tolerance))
            left = np.maximum(left - columns[:, k] ** 2, 0.0)
        return left, columns

    out: list[tuple[int, float]] = []
    for _ in range(n):
        gone = np.array([i for i, _ in out], np.int64)

        def best(batches: Iterator[pa.RecordBatch], gone: np.ndarray = gone) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                node = batch.column(0).to_numpy()
                free = ~np.isin(node, gone)
                if not free.any():
                    continue
                x = np.column_stack([c.to_numpy() for c in batch.columns[1:]])[free]
                score, node = residuals(x)[0], node[free]
                i = np.lexsort((node, -score))[0]
                if top is None or (-score[i], node[i]) < (-top[1], top[0]):
                    top = int(node[i]), float(score[i]), x[i].tolist()
            if top is not None:
                yield pa.RecordBatch.from_pydict({"node": [top[0]], "score": [top[1]], "x": [top[2]]})

        found = rows.mapInArrow(best, "node long, score double, x array<double>").orderBy(F.desc("score"), "node").first()
        if found is None:
            break
        x = np.array([found["x"]], float)
        out.append((found["node"], float(np.sqrt(found["score"])) if qr else found["score"]))
        rest = residuals(x)[1][0]
        if not qr:
            taken.append((x[0], rest, found["score"]))
        elif found["score"] > 0:
            taken.append((rest / np.sqrt(found["score"]),))
    return out


def archetype_candidates(df: DataFrame, features: Sequence[str], probability: str = "probability", quantile: float | None = 0.75, least: float | None = None, scale: bool = True) -> DataFrame:
    """Points above the probability threshold with ``extremeness`` (distance to their centroid), both components normalised to ``p, e``."""
    if least is None and quantile is not None:
        least = df.agg(F.percentile(probability, quantile)).first()[0]
    rows = df if least is None else df.where(F.col(probability) >= least)
    s = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaled = {f"_f_{c}": (F.col(c) - s[f"m_{c}"]) / ((s[f"s_{c}"] or 1.0) if scale else 1.0) for c in features}
    rows = rows.withColumns(scaled).withColumn("extremeness", F.sqrt(sum((F.col(f"_f_{c}") ** 2 for c in features), F.lit(0.0))))
    return normalize(normalize(rows, probability, "p", constant=1.0), "extremeness", "e", constant=1.0)


def select_archetypes(candidates: DataFrame, n: int, features: Sequence[str], key: str = "point_index", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, float]]:
    """Greedy choice by probability, extremeness and diversity; the first round's diversity is the extremeness."""
    wp, we, wd = weights
    cols = [f"_f_{c}" for c in features]
    rows = settle(candidates.select(key, "p", "e", *cols).withColumn("d", F.col("e")))
    chosen: list[tuple[int, float]] = []
    for step in range(n):
        scored = rows if step == 0 else normalize(rows, "d", "dn", constant=1.0)
        score = wp * F.col("p") + we * F.col("e") + wd * F.col("d" if step == 0 else "dn")
        best = scored.select("*", score.alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(1).collect()
        if not best:
            raise ValueError("there are too few candidates")
        r = best[0]
        chosen.append((r[key], r["score"]))
        apart = F.sqrt(sum(((F.col(c) - float(r[c])) ** 2 for c in cols), F.lit(0.0)))
        rows = rows.where(F.col(key) != r[key]).withColumn("d", apart if step == 0 else F.least("d", apart))
        if (step + 1) % 8 == 0:
            rows = settle(rows)
    return chosen
