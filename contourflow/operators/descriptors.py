"""Local-symmetry descriptors: sums over the atoms within a cutoff of each point."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import orthogonal_displacement
from ..functions.radial import chebyshev, cutoff

KEYS = ("map_index", "point_index")
#: Atoms of a system up to which they are broadcast; beyond, points and atoms meet by cells of the cutoff's size.
MOST_BROADCAST_ATOMS = 20_000


def neighbour_pairs(
    points: DataFrame, atoms: DataFrame, box: tuple[float, float, float], radius: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, atom_index, symbol, dx, dy, dz, r`` of all points and atoms within ``radius``, nearest image only.

    Few atoms are broadcast after their number is counted. Many are dealt to cells as wide as the radius
    and each point looks into the 27 cells around its own, periodically, so the join is an equi-join.
    """
    p = points.select(*keys, "x", "y", "z")
    if atoms.limit(MOST_BROADCAST_ATOMS + 1).count() <= MOST_BROADCAST_ATOMS:
        both = p.crossJoin(F.broadcast(atoms))
    else:
        cells = [max(1, int(length // radius)) for length in box]

        def cell(c: Column, k: int) -> Column:
            return F.least(F.floor((c - box[k] * F.floor(c / box[k])) / (box[k] / cells[k])), F.lit(cells[k] - 1)).cast("int")

        around = [sorted({(d + n) % n for d in (-1, 0, 1)}) for n in cells]
        near = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(o)]) for o in _product(around)])
        left = p.select("*", *[cell(F.col(c), k).alias(f"c{k}") for k, c in enumerate("xyz")]).withColumn("o", F.explode(near))
        left = left.select(*keys, "x", "y", "z", *[F.pmod(F.col(f"c{k}") + F.col(f"o.d{k}"), F.lit(cells[k])).alias(f"c{k}") for k in range(3)])
        right = atoms.select("*", *[cell(F.col(c), k).alias(f"c{k}") for k, c in enumerate(("ax", "ay", "az"))])
        both = left.join(right, ["c0", "c1", "c2"])
    d = orthogonal_displacement([F.col(c) for c in "xyz"], [F.col(c) for c in ("ax", "ay", "az")], box)
    moved = both.select(*keys, "atom_index", "symbol", *[c.alias(n) for c, n in zip(d, ("dx", "dy", "dz"), strict=True)])
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return moved.withColumn("r", r).where(F.col("r") <= radius)


def _product(lists: list[list[int]]) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for values in lists:
        out = [(*o, v) for o in out for v in values]
    return out


def _sums(pairs: DataFrame, terms: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in terms.items()])


def g1(pairs: DataFrame, elements: Sequence[str], radius: float, kind: str = "cos", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per element the sum of the cutoff function."""
    fc = cutoff(kind, radius, F.col("r"))
    return _sums(pairs, {f"BP-G1_{e}_r{radius}": F.when(F.col("symbol") == e, fc).otherwise(0.0) for e in sorted(elements)}, keys)


def g2(pairs: DataFrame, elements: Sequence[str], radius: float, etas: Sequence[float], shifts: Sequence[float], kind: str = "cos", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per (eta, shift) pair and element the sum of shifted Gaussians."""
    r, fc, terms = F.col("r"), cutoff(kind, radius, F.col("r")), {}
    for eta, rs in zip(etas, shifts, strict=True):
        for e in sorted(elements):
            value = F.exp(-eta * (r - rs) * (r - rs)) * fc
            terms[f"BP-G2_{e}_r{radius}_eta{eta:.2f}_rs{rs:.2f}"] = F.when(F.col("symbol") == e, value).otherwise(0.0)
    return _sums(pairs, terms, keys)


def g3(pairs: DataFrame, elements: Sequence[str], radius: float, kappas: Sequence[float], kind: str = "cos", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per kappa and element the sum of damped cosines."""
    fc = cutoff(kind, radius, F.col("r"))
    terms = {
        f"BP-G3_{e}_r{radius}_kappa{k}": F.when(F.col("symbol") == e, F.cos(k * F.col("r")) * fc).otherwise(0.0)
        for k in kappas
        for e in sorted(elements)
    }
    return _sums(pairs, terms, keys)


def atom_pairs(pairs: DataFrame, same: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two neighbours j <= k (or j < k) of each point, with the angle's cosine and the distance between them.

    Neighbours of a point are gathered in one array (bounded by the atoms within the cutoff) and combined
    in place, so each point's rows are shuffled once.
    """
    gathered = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("atom_index", "symbol", "dx", "dy", "dz", "r"))).alias("n"))
    j = gathered.select(*keys, "n", F.posexplode("n").alias("pj", "j"))
    k = j.select(*keys, "j", F.explode(F.slice("n", F.col("pj") + (1 if same else 2), F.size("n"))).alias("k"))
    dot = F.col("j.dx") * F.col("k.dx") + F.col("j.dy") * F.col("k.dy") + F.col("j.dz") * F.col("k.dz")
    d = [F.col(f"j.{c}") - F.col(f"k.{c}") for c in ("dx", "dy", "dz")]
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (F.col("j.r") * F.col("k.r"))))
    return k.select(
        *keys,
        F.col("j.symbol").alias("sj"),
        F.col("k.symbol").alias("sk"),
        F.col("j.r").alias("rij"),
        F.col("k.r").alias("rik"),
        F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("rjk"),
        cosine.alias("cosine"),
    )


def angular(
    pairs: DataFrame, elements: Sequence[str], radius: float, zetas: Sequence[int], etas: Sequence[float], lambdas: Sequence[float],
    with_jk: bool, kind: str = "cos", keys: Sequence[str] = KEYS,
) -> DataFrame:
    """G4 (``with_jk``) and G5: angular sums over atom pairs j <= k, self-pairs included, per element pair."""
    two = atom_pairs(pairs, same=True, keys=keys)
    rij, rik, rjk = F.col("rij"), F.col("rik"), F.col("rjk")
    fc = cutoff(kind, radius, rij) * cutoff(kind, radius, rik)
    square = rij * rij + rik * rik
    if with_jk:
        fc, square = fc * cutoff(kind, radius, rjk), square + rjk * rjk
    name = "G4" if with_jk else "G5"
    terms = {}
    for zeta in zetas:
        for eta in etas:
            for lam in lambdas:
                value = 2.0 ** (1 - zeta) * F.pow(1.0 + lam * F.col("cosine"), F.lit(float(zeta))) * F.exp(-eta * square) * fc
                for a, b in combinations_with_replacement(sorted(elements), 2):
                    match = (F.least("sj", "sk") == a) & (F.greatest("sj", "sk") == b)
                    terms[f"BP-{name}_{a}_{b}_r{radius}_l{lam}_z{zeta}_eta{eta:.2f}"] = F.when(match, value).otherwise(0.0)
    return _sums(two, terms, keys)


def radial_basis(order: int, radius: float, r: Column, kind: str = "cos") -> Column:
    """One term of the radial Chebyshev descriptor, zero where the cutoff function is at most 1e-6."""
    fc = cutoff(kind, radius, r)
    k = 2.0 if order == 0 else 1.0
    q = r / radius
    value = k / (2 * math.pi) / F.sqrt(q - q * q) / 4.0 * radius * chebyshev(order, 2.0 * q - 1.0) * fc
    return F.when(fc > 1e-6, value).otherwise(0.0)


def element_weights(elements: Sequence[str]) -> dict[str, int]:
    """Weights -n..n for the compositional descriptors; an even count skips zero, a single element has zero."""
    names = sorted(elements)
    half = len(names) // 2
    values = [w for w in range(-half, half + 1) if w or len(names) % 2]
    return dict(zip(names, values, strict=False))


def chebyshev_radial(pairs: DataFrame, orders: Sequence[int], radius: float, kind: str = "cos", weights: dict[str, int] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Structural (or with ``weights`` compositional) radial Chebyshev descriptors as conditional sums."""
    w = F.lit(1.0) if weights is None else F.coalesce(*[F.when(F.col("symbol") == e, F.lit(float(v))) for e, v in weights.items()], F.lit(0.0))
    tag = "S" if weights is None else "C"
    return _sums(pairs, {f"ACSF_R{tag}_r{radius}_{n:03d}": radial_basis(n, radius, F.col("r"), kind) * w for n in orders}, keys)


def chebyshev_angular(pairs: DataFrame, orders: Sequence[int], radius: float, kind: str = "cos", weights: dict[str, int] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angular Chebyshev descriptors over atom pairs j < k."""
    two = atom_pairs(pairs.where(cutoff(kind, radius, F.col("r")) > 1e-6), same=False, keys=keys)
    fc = cutoff(kind, radius, F.col("rij")) * cutoff(kind, radius, F.col("rik"))
    t = 2.0 * F.acos("cosine") / math.pi - 1.0
    w, tag = F.lit(1.0), "S"
    if weights is not None:
        of = lambda c: F.coalesce(*[F.when(F.col(c) == e, F.lit(float(v))) for e, v in weights.items()], F.lit(0.0))
        w, tag = of("sj") * of("sk"), "C"
    return _sums(two, {f"ACSF_A{tag}_r{radius}_{n:03d}": chebyshev(n, t) * fc * w for n in orders}, keys)


def descriptor_arrays(
    points: DataFrame, atoms: DataFrame, box: tuple[float, float, float], radius: float, radial: int, angular_order: int = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, radial, angular``: all orders below the given ones in one array each, by Chebyshev recurrence.

    For high orders: the atoms of the system (at most ``MOST_BROADCAST_ATOMS``, checked) travel with the
    task and each batch of points is one matrix product, without a shuffle.
    """
    rows = atoms.select("ax", "ay", "az").limit(MOST_BROADCAST_ATOMS + 1).toPandas().to_numpy(float)
    if len(rows) > MOST_BROADCAST_ATOMS:
        raise ValueError("too many atoms to broadcast; use chebyshev_radial over neighbour_pairs")
    edge = np.array(box)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            at = np.column_stack([batch.column(len(keys) + k).to_numpy() for k in range(3)]) if n else np.empty((0, 3))
            out_r, out_a = np.zeros((n, radial)), np.zeros((n, angular_order))
            for s in range(0, n, 256):
                d = at[s : s + 256, None, :] - rows[None]
                d -= edge * np.floor(d / edge + 0.5)
                r = np.sqrt((d * d).sum(axis=2))
                fc = np.where(r <= radius, 0.5 * (np.cos(np.pi * r / radius) + 1), 0.0)
                use = fc > 1e-6
                q = np.where(use, r / radius, 0.5)
                base = np.where(use, radius / (8 * np.pi) / np.sqrt(q - q * q) * fc, 0.0)
                before, now = np.ones_like(q), 2 * q - 1
                for k in range(radial):
                    out_r[s : s + 256, k] = (base * before).sum(axis=1) * (2 if k == 0 else 1)
                    before, now = now, 2 * (2 * q - 1) * now - before
                if angular_order:
                    for i in range(len(d)):
                        j = np.flatnonzero(use[i])
                        if len(j) < 2:
                            continue
                        u = d[i, j] / r[i, j, None]
                        a, b = np.triu_indices(len(j), 1)
                        t = 2 * np.arccos(np.clip((u[a] * u[b]).sum(axis=1), -1, 1)) / np.pi - 1
                        w = fc[i, j[a]] * fc[i, j[b]]
                        before, now = np.ones_like(t), t
                        for k in range(angular_order):
                            out_a[s + i, k] = (w * before).sum()
                            before, now = now, 2 * t * now - before
            lists = [pa.array(list(o), pa.list_(pa.float64())) for o in (out_r, out_a)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], [*keys, "radial", "angular"])

    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", radial array<double>, angular array<double>"
    return points.select(*keys, *[F.col(c).cast("double").alias(c) for c in "xyz"]).mapInArrow(run, schema)
