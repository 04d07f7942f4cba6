"""Scalar fields on grids and the interface functions built from complementary error functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.radial import erfc, erfc_exact

ROOT_PI = math.sqrt(math.pi)


def integral(cells: DataFrame, value: str, volume: float, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of the field times the volume of a cell."""
    return cells.groupBy(*groups).agg((F.sum(value) * F.lit(float(volume)) / F.count("*")).alias("integral"))


def planar_average(cells: DataFrame, value: str, axis: str, groups: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*groups, axis).agg(F.avg(value).alias(value))


def line_cut(cells: DataFrame, value: str, axis: int, center: Sequence[float], steps: Sequence[float], shape: Sequence[int]) -> DataFrame:
    """Values along an axis through ``center``; the other indices are rounded half-even and wrapped."""
    names = ("ix", "iy", "iz")
    for k, name in enumerate(names):
        if k != axis:
            cells = cells.where(F.col(name) == round(center[k] / steps[k]) % shape[k])
    return cells.select(names[axis], value)


def plane_cut(cells: DataFrame, value: str, axis: int, center: Sequence[float], steps: Sequence[float], shape: Sequence[int]) -> DataFrame:
    """The slice normal to ``axis`` through ``center``."""
    names = ("ix", "iy", "iz")
    return cells.where(F.col(names[axis]) == round(center[axis] / steps[axis]) % shape[axis]).select(*[n for k, n in enumerate(names) if k != axis], value)


def modulus(x: str, y: str, z: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def charge_volume(dim: int, width: float, spread: float, cell_volume: float = 1.0, height: float = 1.0, area: float = 1.0) -> float:
    """Integral of the kind-4 complement: sphere, cylinder of ``height`` or slab of ``area`` with a diffuse edge."""
    if width < 1e-10 or spread < 1e-10:
        raise ValueError("width and spread must be positive")
    a = width / spread
    erf, e = math.erf(a), math.exp(-a * a)
    if dim == 0:
        return 4 * math.pi / 3 * width**3 * ((1 + 1.5 / a**2) * (1 + erf) / 2 + (1 + 1 / a**2) * e / (2 * a * ROOT_PI)) if a else 0.0
    if dim == 1:
        return math.pi * width**2 * height * ((1 + 0.5 / a**2) * (1 + erf) / 2 + e / (2 * a * ROOT_PI))
    return 2 * area * width


def error_density(distance: Column, width: Column | float, spread: float, kind: int, volume: float = 1.0, normal: float = 1.0, exact: bool = False) -> Column:
    """Kind 2: erfc scaled to a charge; 3: half of it; 4: one minus half of it. ``exact`` runs over Arrow batches."""
    if abs(spread) < 1e-10 or kind not in (2, 3, 4):
        raise ValueError("spread must not vanish and kind be 2, 3 or 4")
    a = (distance - width) / spread
    e = erfc_exact(a) if exact else erfc(a)
    return {2: e * volume / (2 * normal), 3: 0.5 * volume * e, 4: volume * (1.0 - 0.5 * e)}[kind]


def error_gradient(component: Column, distance: Column, width: Column | float, spread: float, kind: int, volume: float = 1.0) -> Column:
    """One component of the gradient of :func:`error_density`; zero at the centre."""
    a = (distance - width) / spread
    sign = 1.0 if kind == 4 else -1.0
    value = sign * volume * F.exp(-(a * a)) * component / (distance * ROOT_PI * spread)
    return F.when(distance <= 1e-10, 0.0).otherwise(value)


def error_laplacian(distance: Column, width: float, spread: float, kind: int, dim: int = 0, volume: float = 1.0) -> Column:
    """Laplacian in closed form: the radial second derivative plus (2 - dim) times the first over the distance."""
    a = (distance - width) / spread
    sign = 1.0 if kind == 4 else -1.0
    first = sign * volume * F.exp(-(a * a)) / (ROOT_PI * spread)
    return F.when(distance <= 1e-10, 0.0).otherwise(first * (float(2 - dim) / distance - 2.0 * a / spread))


def error_hessian(v: Sequence[Column], distance: Column, width: float, spread: float, kind: int, volume: float = 1.0) -> Column:
    """Nine second derivatives in row order for a point-centred function."""
    a = (distance - width) / spread
    sign = 1.0 if kind == 4 else -1.0
    first = sign * volume * F.exp(-(a * a)) / (ROOT_PI * spread)
    out = []
    for i in range(3):
        for j in range(3):
            uu = v[i] * v[j] / (distance * distance)
            delta = 1.0 if i == j else 0.0
            out.append(F.when(distance <= 1e-10, 0.0).otherwise(first * ((delta - uu) / distance - 2.0 * a / spread * uu)))
    return F.array(*out)


def summed(fields: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The sum of several functions' fields, cell by cell."""
    return fields.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def system_boundary(cells: DataFrame, displacement: Sequence[Column], width: float, spread: float, exact: bool = False) -> DataFrame:
    """``switch, gx, gy, gz`` of one diffuse function around the system's centre."""
    r = F.sqrt(sum((d * d for d in displacement), F.lit(0.0)))
    out = cells.withColumn("switch", error_density(r, width, spread, 3, exact=exact))
    for d, n in zip(displacement, ("gx", "gy", "gz"), strict=True):
        out = out.withColumn(n, error_gradient(d, r, width, spread, 3))
    return out


def ionic_boundary(cells: DataFrame, atoms: DataFrame, box: tuple[float, float, float], alpha: float, softness: float, keys: Sequence[str], density: Callable[..., Column] = error_density) -> DataFrame:
    """``keys, switch, gx, gy, gz``: one minus the product of the atoms' soft spheres, and its gradient.

    ``atoms`` has ``ax, ay, az, radius`` and is broadcast (one structure's atoms). The product is summed in
    logarithms; a factor below 1e-60 makes it zero, and its own gradient drops out.
    """
    from ..functions.geometry import orthogonal_displacement

    d = orthogonal_displacement([F.col(c) for c in "xyz"], [F.col(c) for c in ("ax", "ay", "az")], box)
    r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    w = alpha * F.col("radius")
    met = cells.select(*keys, "x", "y", "z").crossJoin(F.broadcast(atoms.select("ax", "ay", "az", "radius")))
    met = met.select(*keys, density(r, w, softness, 4).alias("f"), *[error_gradient(c, r, w, softness, 4).alias(n) for c, n in zip(d, ("hx", "hy", "hz"), strict=True)])
    live = F.abs("f") > 1e-60
    total = F.when(F.min(F.abs("f")) > 1e-60, F.exp(F.sum(F.when(live, F.log(F.abs("f")))))).otherwise(0.0)
    parts = [F.sum(F.when(live, F.col(h) / F.col("f")).otherwise(0.0)).alias(h) for h in ("hx", "hy", "hz")]
    out = met.groupBy(*keys).agg(total.alias("s"), *parts)
    return out.select(*keys, (1.0 - F.col("s")).alias("switch"), *[(-F.col(h) * F.col("s")).alias(g) for h, g in (("hx", "gx"), ("hy", "gy"), ("hz", "gz"))])


def one_sided(cells: DataFrame, axis: str, center: float, side: float) -> DataFrame:
    """Zeroes switch and gradient on the wrong side of the centre."""
    keep = (F.col(axis) - center) * F.lit(float(side)) >= 0
    for c in ("switch", "gx", "gy", "gz"):
        cells = cells.withColumn(c, F.when(keep, F.col(c)).otherwise(0.0))
    return cells
